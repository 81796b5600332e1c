import os

import numpy as np
import pytest
from oracle import SMALL, assert_same, connect

from locusframe import pipeline
from locusframe.operators import calling, scorers
from locusframe.operators import tracks as tracks_
from locusframe.plans import core, tracks

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(core.queries()[name](spark, SMALL), connect(SMALL).sql(core.oracle_sql()[name]))


@pytest.fixture(scope="module")
def structures():
    """Structures of all records by one plain walk over whole sequences, without tiles or tasks."""
    params, score, out = tracks.PARAMS, scorers.motif_scorer(), {}
    rows = connect(SMALL).sql("SELECT DISTINCT rec_id, upper(seq) FROM datafile WHERE length(seq) > 0").fetchall()
    for rec, seq in rows:
        own = "".join(c if c in "ACGT" else "N" for c in seq.replace("U", "T"))
        for strand, s in ((1, own), (-1, own[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            p = score("N" * 400 + s + "N" * 400)
            pos, kind, value = calling.sorted_events(p, params.thresholds())
            found = calling.structures(pos, kind, value, p, s, params)
            out[str(rec), strand] = [(round(v, 5), int(pos[at[0]]), int(pos[at[-1]]), len(at)) for v, at, _ in found if v >= calling.LEAST_SCORE]
    return {k: sorted(v) for k, v in out.items() if v}


def test_enumeration_equals_a_plain_walk(spark, structures):
    got = {}
    for r in core.queries()["r_enumerate"](spark, SMALL).collect():
        got.setdefault((r.contig_id, r.strand), []).append((r.score, r.first, r.last, r.events))
    assert {k: sorted(v) for k, v in got.items()} == structures


def test_selection_keeps_some_of_each_locus(spark, structures):
    rows = core.queries()["r_isoform_select"](spark, SMALL).collect()
    loci = {}
    for r in rows:
        loci.setdefault((r.contig_id, r.strand, r.group_id), []).append(r)
    assert {k[:2] for k in loci} == set(structures)
    for (contig, strand, _), kept in loci.items():
        assert sorted(r.place for r in kept) == list(range(len(kept))) and len(kept) <= 5
        assert {r.score for r in kept} <= {x[0] for x in structures[contig, strand]}
        best = max(r.score for r in kept)
        assert all(best - r.score <= calling.STRICT + 1e-5 for r in kept)


def test_rows_of_the_whole_prediction(spark):
    rows = core.queries()["r_end_to_end"](spark, SMALL).collect()
    genes = {r.gene_id: r for r in rows if r.feature_type == "gene"}
    assert genes and {r.gene_id for r in rows} == set(genes)
    for r in rows:
        g = genes[r.gene_id]
        assert g.start <= r.start <= r.end <= g.end and r.seqid == g.seqid and r.strand == g.strand
    assert len([r for r in rows if r.feature_type == "exon"]) == len([r for r in rows if r.feature_type == "CDS"])


def test_kinds_of_overlapping_records(spark):
    rows = core.queries()["r_isoform_class"](spark, SMALL).collect()
    kinds = {"INTRON_RETENTION", "EXON_SKIPPING", "ALT_FIRST_EXON", "ALT_LAST_EXON", "ALT_5_SPLICE_SITE", "ALT_3_SPLICE_SITE", "COMPLEX"}
    assert all(r.variant in kinds and r.rec_id < r.alt for r in rows)


def test_segments_of_the_motif_scorer(spark):
    """Runs equal those of each whole sequence's scores."""
    score, want = scorers.motif_scorer(), set()
    for rec, seq in connect(SMALL).sql("SELECT DISTINCT rec_id, upper(seq) FROM datafile WHERE length(seq) > 0").fetchall():
        own = "".join(c if c in "ACGT" else "N" for c in seq.replace("U", "T"))
        for sign, s in (("+", own), ("-", own[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            p = score("N" * 400 + s + "N" * 400)
            for name, (i, j) in pipeline.SEGMENT_TRACKS.items():
                v = tracks_.signed_values(p[i], p[j], pipeline.SEGMENT_LEAST[name])
                if sign == "-":
                    v = v[::-1]
                cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
                want |= {(name + sign, str(rec), a, b, float(v[a])) for a, b in zip(cuts, cuts[1:]) if v[a]}
    got = [(r.track, r.contig_id, r.seg_start, r.seg_end, r.value) for r in core.queries()["r_raw_segments"](spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_every_query_is_checked():
    checked = {"r_enumerate", "r_isoform_select", "r_end_to_end", "r_isoform_class", "r_raw_segments"}
    assert set(core.queries()) - set(core.oracle_sql()) == checked
