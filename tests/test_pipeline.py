import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe import params, pipeline
from locusframe.functions import seq as Q
from locusframe.operators import genes, tracks
from locusframe.sources import fasta, sinks, tables

PARAMS = params.Params(cds_start_min_score=0.5, cds_end_min_score=0.5, exon_start_min_score=0.3, exon_end_min_score=0.3, dynamic_scoring=False, min_gene_score=0.1, gene_candidates=100, frame_max_ops=1000, tile=700)


def genome(seed=1, n=6):
    rng = random.Random(seed)
    return [(f"c{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(900, 2500)))) for i in range(n)]


def write_fasta(path, records):
    path.write_text("".join(f">{name} note\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for name, s in records))


def test_fasta_cases(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_bytes(b">a one -> two\r\nacgtr\r\nnn\r\n>b\nAC\nGT\n>a again\nTTT\n")
    got = {r.contig_id: r.seq for r in fasta.contigs(fasta.read_fasta(spark, str(path))).collect()}
    assert got == {"a": "TTT", "b": "ACGT"}
    assert fasta.genome_bases(fasta.read_fasta(spark, str(path))) == 14
    assert [r.contig_id for r in fasta.contigs(fasta.read_fasta(spark, str(path)), ("b",)).collect()] == ["b"]
    with pytest.raises(ValueError, match="p, q"):
        fasta.contigs(fasta.read_fasta(spark, str(path)), ("q", "b", "p"))
    (tmp_path / "bad.fa").write_text(">a\nAC-T\n")
    with pytest.raises(Exception, match="invalid letters"):
        fasta.contigs(fasta.read_fasta(spark, str(tmp_path / "bad.fa"))).collect()


def test_flat_files(spark, tmp_path):
    (tmp_path / "x.gb").write_text("LOCUS       X1 9 bp\nVERSION     X1.2\nORIGIN\n        1 acgta cgt\n        9 n\n//\nLOCUS       X2\nORIGIN\n        1 tt\n//\n")
    (tmp_path / "x.embl").write_text("ID   E1; SV 1;\nAC   E1;\nSQ   Sequence 6 BP;\n     acgtaa        6\n//\n")
    assert [(r.contig_id, r.seq) for r in fasta.read_sequences(spark, str(tmp_path / "x.gb")).collect()] == [("X1.2", "ACGTACGTN"), ("X2", "TT")]
    assert [(r.contig_id, r.seq) for r in fasta.read_sequences(spark, str(tmp_path / "x.embl")).collect()] == [("E1", "ACGTAA")]


def test_other_sources(spark, tmp_path):
    (tmp_path / "a.gff").write_text("# c\nc1\ts\tCDS\t1\t9\t.\t+\t0\tID=\"x\";\n")
    assert tables.read_gff(spark, str(tmp_path / "a.gff")).first().attributes == 'ID="x";'
    (tmp_path / "allow").write_text('# c\n"g1"\tx\ng1\ng2\n')
    assert sorted(r.name for r in tables.read_allow_list(spark, str(tmp_path / "allow")).collect()) == ["g1", "g2"]
    (tmp_path / "t.tsv").write_text("g\t0\tc\t+\t1\t90\t20,40,\t10,30,\nshort\tline\n")
    rows = {r.name: r for r in tables.read_splice_table(spark, str(tmp_path / "t.tsv")).collect()}
    assert rows["g"].exon_ends == [20, 40] and rows["g"].reason is None and rows["short"].reason == "invalid_format"
    (tmp_path / "r.txt").write_text("a:b-c:5-9\tACGTA\n")
    assert tuple(tables.read_regions(spark, str(tmp_path / "r.txt")).first()) == ("a:b-c", 5, 9, "ACGTA")


def test_tiles_score_like_whole_sequences(spark):
    from locusframe.operators.scorers import motif_scorer

    df = spark.createDataFrame(genome(), "contig_id string, seq string")
    whole = {(r.contig_id, r.strand): r.p for r in tracks.scored(tracks.sequence_tiles(df, 10**6), motif_scorer).collect()}
    parts = {}
    for r in sorted(tracks.scored(tracks.sequence_tiles(df, 300), motif_scorer).collect(), key=lambda r: r.tile_start):
        have = parts.setdefault((r.contig_id, r.strand), [[] for _ in range(7)])
        for a, b in zip(have, r.p):
            a += b
    assert {k: [list(x) for x in v] for k, v in whole.items()} == parts


def test_prediction_and_files(spark, tmp_path):
    write_fasta(tmp_path / "g.fa", genome())
    contigs = fasta.contigs(fasta.read_sequences(spark, str(tmp_path / "g.fa")))
    found = pipeline.predict(contigs, PARAMS)
    rows = found.transcripts.collect()
    assert rows and found.threshold == 0.1 and found.mean_score > 0
    ids = sorted(r.gene_id for r in found.genes.collect())
    assert ids == [f"GML{i:06d}" for i in range(1, len(ids) + 1)]
    cds = sinks.cds_of(found.transcripts, contigs)
    assert cds.filter(Q.cds_reason("cds", compat=False) != "valid").count() == 0
    for r in rows:
        assert all(a["phase"] == (3 - sum(e["end"] - e["start"] for e in r.exons[:i]) % 3) % 3 for i, a in enumerate(r.exons))
        assert (r.variant == "PRIMARY") == (r.place == 0)
    gff = genes.gff_rows(found.transcripts)
    sinks.write_gff(gff, contigs, str(tmp_path / "out.gff3"), found.mean_score)
    lines = [x for p in (tmp_path / "out.gff3").glob("part-*") for x in p.read_text().splitlines()]
    assert lines[0] == "##gff-version 3.1.26" and lines[1].startswith("##mean-gene-score ")
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert len(body) == gff.count() and body[0][2] == "gene" and all(len(b) == 9 for b in body)
    sinks.write_fasta(cds, str(tmp_path / "p.fa"), "protein")
    with pytest.raises(ValueError):
        sinks.write_fasta(cds, str(tmp_path / "q.fa"), "rna")


def test_layout_changes_nothing(spark):
    df = spark.createDataFrame([(i, n, s, len(s)) for i, (n, s) in enumerate(genome(4))], "contig_ord bigint, contig_id string, seq string, length int")
    a, b = (sorted(map(str, genes.gff_rows(pipeline.predict(df.repartition(k), PARAMS).transcripts).collect())) for k in (1, 5))
    assert a == b and a


def test_segments(spark):
    values = [0.0, 0.2, 0.2, -0.1, 0.0, 0.0, 0.3, 0.3, 0.3, 0.3]
    zero = [0.0] * 10
    rows = [(strand, i, 10, [[max(0.0, v) for v in values[i : i + 3]], [max(0.0, -v) for v in values[i : i + 3]]] + [zero[:3]] * 5) for strand in (1, -1) for i in (0, 3, 6, 9)]
    df = spark.createDataFrame(rows, "strand byte, tile_start long, length long, p array<array<float>>").selectExpr("'c' as contig_id", "*").repartition(3)
    got = sorted((r.track, r.seg_start, r.seg_end, r.value) for r in tracks.segments(df, {"t": (0, 1, 0.1)}).collect())
    assert got == [("t+", 1, 3, 0.2), ("t+", 3, 4, -0.1), ("t+", 6, 10, 0.3), ("t-", 0, 4, 0.3), ("t-", 6, 7, -0.1), ("t-", 7, 9, 0.2)]
    assert tracks.segments(df.limit(0), {"t": (0, 1, 0.1)}).count() == 0


def test_context_of_a_scorer(spark):
    """A scorer that looks as far as its context allows gives in tiles what it gives of the whole sequence."""

    def maker(context):
        def make():
            def score(padded):
                code = np.frombuffer(padded.encode(), np.uint8).astype(np.float64)
                far = np.convolve(code, np.ones(context + 1), "valid")
                return np.stack([far % (7 + i) for i in range(7)])

            return score

        return make

    df = spark.createDataFrame(genome(), "contig_id string, seq string")
    whole = {(r.contig_id, r.strand): r.p for r in tracks.scored(tracks.sequence_tiles(df, 10**6, 2000), maker(2000), 2000).collect()}
    parts = {}
    for r in sorted(tracks.scored(tracks.sequence_tiles(df, 300, 2000), maker(2000), 2000).collect(), key=lambda r: r.tile_start):
        for a, b in zip(parts.setdefault((r.contig_id, r.strand), [[] for _ in range(7)]), r.p):
            a += b
    assert {k: [list(x) for x in v] for k, v in whole.items()} == parts
    with pytest.raises(Exception, match="a scorer gave"):
        tracks.scored(tracks.sequence_tiles(df, 300, 800), maker(2000), 800).count()


def test_strict_protein(spark):
    df = spark.createDataFrame([("TTGAAATAA",)], "s string")
    assert df.select(Q.protein("s")).first()[0] == "MK"
    with pytest.raises(Exception, match="no start codon"):
        df.select(Q.protein(F.lit("AAATAA"))).collect()


def test_options(tmp_path):
    fa = tmp_path / "x.fa.gz"
    fa.write_text(">a\nA\n")
    p = params.parse([str(fa)])
    assert p.output == str(tmp_path / "x.gff3") and p.dynamic_scoring and p.max_intron_size == 400
    assert params.parse([str(fa), "--min-gene-score", "0.7"]).min_gene_score == 0.7
    assert "max_intron_size = 400" in p.to_ini() and '"strand": "both"' in p.to_json()
    for bad in (["--min-exon-size", "9", "--max-exon-size", "3"], ["-m", "a.onnx"], ["-o", str(fa)]):
        with pytest.raises(ValueError):
            params.parse([str(fa), *bad])
    for bad in (["--gene-id-prefix", "a b"], ["--min-gene-score", "2"], ["-c", "0"]):
        with pytest.raises(SystemExit):
            params.parse([str(fa), *bad])


def test_landing_folder(spark, tmp_path):
    from locusframe.streaming import landing

    (tmp_path / "in").mkdir()
    write_fasta(tmp_path / "in" / "g.fa", genome(2, 2))
    landing.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), PARAMS).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_datapoints(spark):
    from locusframe.operators import training

    exon = lambda s, e: {"start": s, "end": e}
    rows = [(1, "ACGTACGTAC", 101, "+", 103, 108, [exon(103, 104), exon(107, 108)]), (2, "ACGTACGTAC", 101, "-", 103, 108, [exon(103, 104), exon(107, 108)])]
    df = spark.createDataFrame(rows, "rec_id bigint, seq string, seq_start bigint, strand string, cds_start bigint, cds_end bigint, exons array<struct<start:bigint,end:bigint>>")
    got = {(r.rec_id, r.tile_no): (list(r.x), list(r.y)) for r in training.datapoints(df, 4, 2).collect()}
    codes = [0, 1, 2, 3, 0, 1, 2, 3, 0, 1]
    back = [3 - c for c in codes[::-1]]
    assert got[1, 0] == (codes[1:7], [3, 2, 6, 6]) and got[1, 1] == (codes[5:10] + [4], [1, 4, 7, 7])
    assert got[2, 0] == (back[1:7], [3, 2, 6, 6]) and got[2, 1] == (back[5:10] + [4], [1, 4, 7, 7])


def test_written_tables_lie_in_the_shared_folder(spark):
    from locusframe.session import checkpoint_folder, write_once

    assert checkpoint_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert write_once(spark.range(5)).inputFiles()[0].split("file:")[-1].lstrip("/").startswith(checkpoint_folder(spark).lstrip("/"))


def test_training_run(spark, tmp_path):
    rng = random.Random(9)
    body = lambda n: "".join(rng.choice(["GCA", "CTC", "GGT", "ACC"]) for _ in range(n))
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    good, no_stop, minus = "ATG" + body(30) + "TAA", "ATG" + body(30), back("ATG" + body(20) + "TGA")
    parts = [body(400), good, body(400), no_stop, "TAG" + body(400), minus, body(500)]
    write_fasta(tmp_path / "g.fa", [("c1", "".join(parts))])
    at = [1 + sum(map(len, parts[:i])) for i in range(len(parts))]
    row = lambda i, strand, text, end=None: f"c1\ts\tCDS\t{at[i]}\t{end or at[i] + len(parts[i]) - 1}\t.\t{strand}\t0\t{text}"
    lines = [row(1, "+", "ID=cds-g1;Parent=x"), row(3, "+", "ID=cds-g2;Parent=x"), row(5, "-", 'gene_id "g3"'), row(1, "+", "ID=cds-p;Parent=x;pseudo=true"), row(6, "+", "ID=cds-far;Parent=x;", at[6] + 1400)]
    lines += ["m\ts\tregion\t1\t9\t.\t+\t.\tgenome=Mitochondrion", "m\ts\tCDS\t1\t9\t.\t+\t0\tID=cds-m;Parent=x"]
    (tmp_path / "a.gff").write_text("##gff-version 3\n" + "\n".join(lines) + "\n")
    text = pipeline.training_run(spark, str(tmp_path / "a.gff"), str(tmp_path / "g.fa"), str(tmp_path / "out"), threshold=0.4)
    rows = {r.name: r for r in spark.read.parquet(str(tmp_path / "out" / "datafile")).collect()}
    assert set(rows) == {"g1", "g2", "g3"} and rows["g2"].extended and not rows["g1"].extended
    assert rows["g2"].exons[-1].end == at[3] + len(no_stop) + 2
    assert "valid\t3" in text and {r.part for r in rows.values()} <= {"train", "test"}
    assert spark.read.text(str(tmp_path / "out" / "splice_table")).count() >= 3
    points = spark.read.parquet(str(tmp_path / "out" / "dataset")).collect()
    assert points and all(len(r.x) == 5800 and len(r.y) == 5000 and r.use in ("train", "valid") for r in points)
    assert spark.read.parquet(str(tmp_path / "out" / "validated" / "table")).count() == 3
    assert tables.read_regions(spark, str(tmp_path / "out" / "validated" / "sequences")).filter("length(seq) = region_end - region_start + 1").count() == 3


def test_command_line(tmp_path, spark):
    from locusframe import cli

    write_fasta(tmp_path / "x.fa", genome(3, 2))
    assert cli.main([str(tmp_path / "nothing.fa")]) == 2
    assert cli.main([str(tmp_path / "x.fa"), "-p", str(tmp_path / "p.fa"), "--min-gene-score", "0.3", "--gene-candidates", "50", "--cds-start-min-score", "0.5", "--cds-end-min-score", "0.5", "--exon-start-min-score", "0.3", "--exon-end-min-score", "0.3"]) == 0
    assert list((tmp_path / "x.gff3").glob("part-*")) and list((tmp_path / "p.fa").glob("part-*"))
    assert (tmp_path / "x.gff3.log").read_text().startswith("[run]")
    assert cli.main([str(tmp_path / "x.fa"), "--write-raw-scores", "-o", str(tmp_path / "y.gff3")]) == 0
    head = sorted((tmp_path / "y.gff3.seg").glob("part-*"))[0].read_text().splitlines()
    assert head[0].startswith("#track") and len(head[1].split("\t")) == 5
