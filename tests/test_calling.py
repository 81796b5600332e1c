import itertools
import random

import numpy as np
import pytest

from locusframe import schema as S
from locusframe.operators import calling, isoforms, threshold, tracks
from locusframe.params import Params

STOPS = ("TAA", "TAG", "TGA")


def valid(cds):
    codons = [cds[i : i + 3] for i in range(0, len(cds), 3)]
    return len(cds) % 3 == 0 and codons[0] in ("ATG", "TTG", "CTG") and codons[-1] in STOPS and not any(c in STOPS for c in codons[:-1])


def exhaustive(events, seq, p, q):
    """All subsets of the events that are structures, without any search order."""
    out = set()
    for r in range(1, len(events)):
        for rest in itertools.combinations(range(1, len(events)), r):
            call = [events[0], *(events[i] for i in rest)]
            kinds = [k for _, k in call]
            middle = [S.EXON_END, S.EXON_START] * ((len(call) - 2) // 2)
            if len(call) % 2 or kinds != [S.CDS_START, *middle, S.CDS_END]:
                continue
            exons = [(a[0], b[0] + 1) for a, b in zip(call[::2], call[1::2])]
            introns = [y[0] - x[1] for x, y in zip(exons, exons[1:])]
            if any(b - a < q.min_exon_size for a, b in exons) or any(not q.min_intron_size <= n <= q.max_intron_size for n in introns):
                continue
            if any(not (p[5, a:b].sum() > p[6, a:b].sum()) for a, b in exons):
                continue
            if valid("".join(seq[a:b] for a, b in exons)):
                out.add((0, *rest))
    return out


def test_search_equals_exhaustive_enumeration():
    rng = random.Random(3)
    q = Params(min_intron_size=2, max_intron_size=400)
    hits = 0
    for _ in range(250):
        n = rng.randrange(30, 90)
        seq = "ATG" + "".join(rng.choice("ACGT") for _ in range(n)) + "TAA"
        p = np.zeros((7, len(seq)), np.float32)
        p[5], p[6] = 0.9, 0.1
        pos = sorted(rng.sample(range(1, len(seq) - 1), 9))
        events = [(0, S.CDS_START)] + [(x, rng.choice([S.EXON_END, S.EXON_START, S.CDS_END])) for x in pos] + [(len(seq) - 1, S.CDS_END)]
        events = events[:1] + sorted(events[1:], key=lambda e: e[0])
        found, _, ran_out = calling.Search(seq, tracks.Prefix(p), q).run(events)
        want = exhaustive(events, seq, p, q)
        assert not ran_out and {tuple(f) for f in found} == want
        hits += len(want)
    assert hits > 20


def test_budget_and_cap():
    seq = "ATG" + "AAA" * 200 + "TAA"
    p = np.zeros((7, len(seq)), np.float32)
    p[5] = 0.9
    events = [(0, 0)] + [x for k in range(8) for x in ((30 * k + 11, S.EXON_END), (30 * k + 24, S.EXON_START))] + [(len(seq) - 1, S.CDS_END)]
    search = lambda **k: calling.Search(seq, tracks.Prefix(p), Params(**k)).run(sorted(events))
    assert search(frame_max_ops=3)[2]
    full = search()[0]
    events.append((len(seq) - 4, S.CDS_END))
    assert len(full) > 5 and len(search(gene_candidates=2)[0]) <= len(search()[0])


def test_considered_events_by_a_plain_sort():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        pos = np.sort(rng.integers(0, n, n))
        kind = np.concatenate([[S.CDS_START], rng.integers(0, 4, n - 1)])
        score = rng.integers(1, int(rng.integers(3, 300)), n) / 300
        want = []
        for t in (S.EXON_START, S.EXON_END, S.CDS_END):
            own = sorted((i for i in range(1, n) if kind[i] == t), key=lambda i: (-score[i], i))
            if t != S.CDS_END and own:
                cut = min(np.percentile(score[own], 60), 0.1)
                own = own[: min(max(sum(score[i] >= cut for i in own), 15), 60)]
            want += [(pos[i], (S.EXON_START, S.EXON_END, S.CDS_END).index(t), score[i]) for i in own]
        got = calling.considered(pos, kind, score)[1:]
        assert sorted(want) == sorted((pos[i], (S.EXON_START, S.EXON_END, S.CDS_END).index(kind[i]), score[i]) for i in got)
        assert [(x[0], x[1]) for x in sorted(want, key=lambda x: x[:2])] == [(pos[i], (S.EXON_START, S.EXON_END, S.CDS_END).index(kind[i])) for i in got]


def test_percentile_is_that_of_numpy():
    rng = np.random.default_rng(12)
    for n in [*range(1, 40), 1000]:
        x = rng.random(n)
        assert calling.percentile(x) == np.percentile(x, 60)


def slow_stop(p, start):
    good, last, none, pos = 0, None, 0, start
    while pos < p.shape[1]:
        none = none + 1 if p[0, pos] > 0.8 else 0
        if none >= 20:
            return pos
        if p[5, pos] > 0.2 or p[6, pos] > 0.2:
            good, last = good + 1, pos
        elif pos - start > 300 and (good < 0.7 * (pos - start) or pos - last > 200):
            return pos
        pos += 1
    return pos


def test_region_stops():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = 1500
        p = rng.random((7, n)).astype(np.float32)
        p[0] = np.where(np.repeat(rng.random(n // 25) < 0.05, 25), 0.9, 0.3)
        p[5] = np.where(np.repeat(rng.random(n // 50) < 0.8, 50), 0.5, 0.1)
        p[6] = 0.1
        r = calling.Regions(p)
        for s in rng.integers(0, n, 30).tolist():
            assert r.stop(s) == slow_stop(p, s)


def test_call_score():
    p = np.zeros((7, 10), np.float32)
    p[5], p[6], p[3, 1], p[4, 8] = 0.75, 0.25, 1.0, 0.5
    assert tracks.call_score(tracks.Prefix(p), [(1, S.CDS_START), (8, S.CDS_END)]) == pytest.approx((0.5 + 0.75) / 2)


P = [(0, 100), (200, 300), (400, 500)]
KINDS = [
    ([(0, 100), (200, 300), (400, 500)][:0] or [(0, 100), (200, 500)], "INTRON_RETENTION"),
    ([(0, 100), (400, 500)], "EXON_SKIPPING"),
    ([(20, 100), (200, 300), (400, 500)], "ALT_FIRST_EXON"),
    ([(0, 100), (200, 300), (400, 480)], "ALT_LAST_EXON"),
    ([(0, 110), (200, 300), (400, 500)], "ALT_5_SPLICE_SITE"),
    ([(0, 100), (190, 300), (400, 500)], "ALT_3_SPLICE_SITE"),
    ([(20, 100), (190, 310), (400, 500)], "COMPLEX"),
]


@pytest.mark.parametrize("alt,kind", KINDS)
@pytest.mark.parametrize("strand", [1, -1])
def test_variants(alt, kind, strand):
    turn = (lambda x: x) if strand == 1 else (lambda x: [(1000 - e, 1000 - s) for s, e in x])
    assert isoforms.variant(turn(P), turn(alt), strand) == kind


def test_alternatives():
    ref = [(0, 0, 0.9), (100, 3, 0.5), (200, 2, 0.5), (300, 1, 0.9)]
    assert isoforms.is_alternative(ref, [(0, 0, 0.9), (110, 3, 0.4), (200, 2, 0.5), (300, 1, 0.9)])
    assert not isoforms.is_alternative(ref, [(0, 0, 0.9), (110, 3, 0.04), (200, 2, 0.5), (300, 1, 0.9)])
    assert not isoforms.is_alternative(ref, [(0, 0, 0.9), (110, 3, 0.15), (200, 2, 0.5), (300, 1, 0.9)])
    assert isoforms.choose([(0.9, ref), (0.8, ref)]) == [0]


def test_threshold():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0.15, 0.05, 4000), rng.normal(0.85, 0.05, 4000)]).clip(0, 1)
    h = np.convolve(np.histogram(x, 89, (0, 1))[0], np.ones(17) / 17, "same")
    assert 0.2 <= threshold.valley_threshold(h) <= 0.8
    assert threshold.valley_threshold(np.convolve(np.arange(50), np.ones(5) / 5, "same")) is None
    assert threshold.extrema(np.array([0, 2, 2, 2, 1, 1, 3, 0])) == ([2, 6], [4])
    assert threshold.shape(100) == (10, 5) and threshold.shape(10**6) == (150, 30)
