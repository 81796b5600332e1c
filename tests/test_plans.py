import random

import numpy as np

from locusframe import pipeline
from locusframe.params import Params
from locusframe.plans import tracks


def test_prediction_queries_take_production_parameters():
    assert tracks.PARAMS == Params()


def test_raw_segments_keep_faint_scores(spark):
    def scorer():
        def score(padded):
            p = np.zeros((7, len(padded) - 800), np.float32)
            p[1], p[3], p[5] = 0.05, 0.05, 0.15
            p[5, : p.shape[1] // 2] = 0.25
            return p

        return score

    df = spark.createDataFrame([(1, "c", "ACGT" * 10, 40)], "contig_ord bigint, contig_id string, seq string, length int")
    got = {(r.track, r.value) for r in pipeline.raw_segments(df, Params(), make_scorer=scorer).collect()}
    assert got == {(t + s, v) for t, v in (("cds", 0.05), ("exon", 0.05), ("inside", 0.25)) for s in "+-"}


def test_records_with_u_are_contigs(spark, tmp_path):
    rows = [(1, "ACGU", 0, "+", "", ""), (2, "acgunr", 0, "+", "", ""), (3, "ACGT", 0, "+", "", "")]
    spark.createDataFrame(rows, "rec_id bigint, seq string, seq_start bigint, strand string, jn_start string, jn_end string").write.parquet(str(tmp_path / "datafile.parquet"))
    assert {r.contig_ord: r.seq for r in tracks._contigs(spark, str(tmp_path)).collect()} == {1: "ACGT", 2: "ACGTNN", 3: "ACGT"}


def chain_by_hand(rows):
    """Loci of (start, last, score, key) rows by the plain rule."""
    out, anchor, number = {}, None, -1
    for s, e, v, k in sorted(rows, key=lambda r: (r[0], -r[2], r[1], r[3])):
        if anchor is None or s > anchor:
            anchor, number = e, number + 1
        out[k] = number
    return out


def strands_by_hand(rows):
    kept = []
    for s, e, st, v, k in sorted(rows, key=lambda r: (r[0], r[1], -r[3], r[4])):
        if kept and kept[-1][2] != st and s < kept[-1][1] and kept[-1][0] < e and v > kept[-1][3]:
            kept[-1] = (s, e, st, v, k)
        else:
            kept.append((s, e, st, v, k))
    return {r[4] for r in kept}


def test_one_contig_over_many_tiles(spark):
    """All rows on one contig, in 16 range tiles: anchors and strands come out as by one walk."""
    from locusframe.operators import intervals

    rng = random.Random(4)
    rows = []
    for k in range(3000):
        s = rng.randrange(20_000)
        rows.append((k, "hot" if k % 50 else "c", s, s + rng.choice([0, 3, 30, 30, 300, 9000]), rng.choice([1, -1]), rng.randrange(9) / 8))
    df = spark.createDataFrame(rows, "k long, g string, s long, e long, st int, v double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        loci = {(r.g, r.k): r.locus_no for r in intervals.anchor_loci(df, ["g"], "s", "e", "v", "k").collect()}
        kept = {r.k for r in intervals.resolve_opposite_strands(df, "g", "s", "e", "st", "v", "k").collect()}
        assert intervals.anchor_loci(df.limit(0), ["g"], "s", "e", "v", "k").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in ("hot", "c"):
        own = [r for r in rows if r[1] == g]
        want = chain_by_hand([(s, e, v, k) for k, _, s, e, _, v in own])
        assert {k: n for (h, k), n in loci.items() if h == g} == want
        assert kept & set(want) == strands_by_hand([(s, e, st, v, k) for k, _, s, e, st, v in own])


def write_records(spark, folder, rows):
    spark.createDataFrame(rows, "rec_id bigint, seq string, seq_start bigint, strand string, jn_start string, jn_end string").write.parquet(str(folder / "datafile.parquet"))


def test_made_scores_stay_in_the_process_that_uses_them(spark, tmp_path):
    """One pass of Python over the records: no table of score matrices, whose batches outgrow an executor."""
    write_records(spark, tmp_path, [(1, "ACGTACGTAC", 0, "+", "2,", "4,")])
    for name in ("o_event_extract", "o_event_cap", "o_percentile", "o_exon_validity", "o_call_score", "o_segments"):
        df = tracks.queries()[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "array<float>" not in df._jdf.queryExecution().analyzed().toString(), name


def test_raw_segments_come_from_one_pass_and_join_tiles(spark):
    """No table of scores or of unjoined runs is written, and tiles cut nothing."""
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGTN") for _ in range(1000))
    df = spark.createDataFrame([(1, "c", seq, 1000)], "contig_ord bigint, contig_id string, seq string, length int")
    whole, cut = (pipeline.raw_segments(df, Params(tile=t)) for t in (10**5, 90))
    assert whole._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert "parquet" not in whole._jdf.queryExecution().analyzed().toString()
    assert sorted(whole.collect()) == sorted(cut.collect()) and whole.count() > 100


def test_calls_of_short_and_long_contigs(spark):
    """Contigs of one tile, scored where they are searched, and those of several give the same calls."""
    rng = random.Random(6)
    rows = [(k, f"c{k}", "".join(rng.choice("ACGT") for _ in range(n)), n) for k, n in enumerate((900, 2000, 2600))]
    df = spark.createDataFrame(rows, "contig_ord bigint, contig_id string, seq string, length int")
    one, mixed = (pipeline.candidate_calls(df, Params(tile=t)) for t in (10**5, 1000))
    assert sorted(map(str, one.collect())) == sorted(map(str, mixed.collect())) and one.count() > 10
