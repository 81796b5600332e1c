import random

import numpy as np

from locusframe.operators import intervals as I
from locusframe.operators import span_union as U


def by_hand(rows):
    groups = {}
    for g, s, a, b in rows:
        if a is not None and b is not None and a != b:
            groups.setdefault((g, s), []).append((min(a, b), max(a, b)))
    out = []
    for (g, s), spans in groups.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [("period", g, s, a, b) for a, b in merged]
        out += [("gap", g, s, x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=str)


def test_periods_and_gaps(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        a = rng.randrange(0, 4000) if rng.random() < 0.7 else rng.randrange(0, 60_000)
        b = a + (rng.randrange(0, 30) if rng.random() < 0.97 else rng.randrange(0, 9000))
        rows.append((rng.choice(["hot", "hot", "c", None]), rng.choice([1, -1]), *((b, a) if rng.random() < 0.2 else (a, b))))
    rows += [("c", 1, None, 5), ("c", 1, 5, None), ("e", 1, 3, 3), ("w", 1, -(1 << 61), 1 << 61), ("w", 1, 5, 9)] + rows[:50]
    df = spark.createDataFrame(rows, "g string, s int, a bigint, b bigint").selectExpr("*", "1 as _lo", "2 as kind").repartition(5)
    for tile_bits in (5, 11, 20):
        got = sorted((tuple(r) for r in U.periods_and_gaps(df, ["g", "s"], "a", "b", tile_bits, 3).collect()), key=str)
        assert got == by_hand(rows)
    assert U.periods_and_gaps(df.limit(0), ["g", "s"], "a", "b").count() == 0


def random_calls(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(0, 2500)
        out.append((i, rng.choice("ab"), s, s + rng.randrange(1, 40), round(rng.random(), 2)))
    return out


def test_groups_and_anchors(spark):
    calls = random_calls(1200, 2)
    df = spark.createDataFrame(calls, "id bigint, g string, s bigint, e bigint, v double")
    groups, number = {}, {}
    for g in "ab":
        rows, no = sorted((c for c in calls if c[1] == g), key=lambda c: (c[2], c[3], c[0])), 0
        for before, c in zip([None, *rows], rows):
            no += before is not None and c[2] >= before[3]
            number[c[0]] = no
            groups.setdefault((g, no), []).append(c)
    found = I.overlap_groups(df, ["g"], "s", "e", "id")
    assert {r.id: r.overlap_no for r in found.collect()} == number
    want = {}
    for rows in groups.values():
        anchor, k = None, -1
        for c in sorted(rows, key=lambda c: (c[2], -c[4], c[3], c[0])):
            if anchor is None or c[2] > anchor[3]:
                anchor, k = c, k + 1
            want[c[0]] = k
    loci = I.anchor_loci(found, ["g", "overlap_no"], "s", "e", "v", "id")
    assert {r.id: r.locus_no for r in loci.collect()} == want


def test_neighbours_and_overlaps(spark):
    rows = [(f"n{i}", g, s, e) for i, g, s, e, _ in random_calls(400, 9)]
    df = spark.createDataFrame(rows, "id string, g string, s bigint, e bigint")
    got = {r.id: (r.upstream, r.downstream) for r in I.neighbours(df, ["g"], "s", "e", "id").collect()}
    for i, g, s, e in rows:
        assert got[i] == (max((x[3] for x in rows if x[1] == g and x[3] < s), default=None), min((x[2] for x in rows if x[1] == g and x[2] > e), default=None))
    other = df.selectExpr("id as oid", "g", "s as os", "e as oe")
    pairs = I.overlap_join(df, other, ["g"], ("s", "e"), ("os", "oe"), bin_size=16).select("id", "oid").collect()
    assert len(pairs) == len(set(pairs))
    assert {tuple(p) for p in pairs} == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3]}


def test_opposite_strands(spark):
    rows = [(1, "c", 0, 10, 1, 0.5), (2, "c", 5, 15, -1, 0.9), (3, "c", 12, 20, 1, 0.1), (4, "c", 20, 25, -1, 1.0), (5, "d", 1, 5, -1, 0.2)]
    df = spark.createDataFrame(rows, "k bigint, g string, s bigint, e bigint, strand int, v double")
    assert sorted(r.k for r in I.resolve_opposite_strands(df, "g", "s", "e", "strand", "v", "k").collect()) == [2, 3, 4, 5]


def test_merge_runs_handles_wide_coordinates():
    g, lo, hi = U.merge_runs(np.array([0, 0, 1, 1]), np.array([-(1 << 62), 0, 5, 9]), np.array([3, 1 << 62, 9, 12]))
    assert (g.tolist(), lo.tolist(), hi.tolist()) == ([0, 1], [-(1 << 62), 5], [1 << 62, 12])
