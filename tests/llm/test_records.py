import os
import random
from functools import lru_cache

import pytest

from locusframe.llm import lookalike, oracle, overlap, pieces, queries, topn

SMALL = "/root/testdata/sf0.001"


def table(name, columns):
    import duckdb

    return duckdb.sql(f"SELECT DISTINCT {columns} FROM '{SMALL}/{name}.parquet'").fetchall()


def expected_pairs():
    rows = [(i, s, m) for i, s, m in table("datafile", "rec_id, seq, mode")]
    return sorted(pairs_by_distance(rows))


def pairs_by_distance(rows):
    comp = overlap.reverse_complement
    norm = [(i, s.upper().replace("U", "T").encode(), m.strip().lower()) for i, s, m in rows if s and m]
    for i, a, m in norm:
        for j, b, o in norm:
            if m in ("test", "val") and o == "train":
                s, t = sorted((a, b), key=len)
                k = len(s) // 10
                if 2 * len(s) >= len(t) and any(x in t or overlap.infix_distance(x, t, k, 0, len(t) - len(s)) <= k for x in (s, comp(s))):
                    yield min(i, j), max(i, j)


def expected_look_alikes():
    groups = {}
    for i, t in table("documents", "doc_id, text"):
        form = lookalike.skeleton(t) if t else ""
        if form.strip():
            groups.setdefault(form, []).append((i, t))
    return sorted({(min(a, b), max(a, b)) for g in groups.values() for a, s in g for b, t in g if s != t})


def tokens():
    return [(i, len(ids)) for i, ids in expected_ids() if ids]


def expected_ids():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return sorted((i, encoder.encode_ordinary(t or "")) for i, t in table("documents", "doc_id, text"))


def assert_packed(rows, sizes):
    placed, used = {}, {}
    for r in rows:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_tokens
        used.setdefault((r.container_id, r.container_size), []).append(r.n_tokens)
    assert sorted(placed.items()) == sorted(tokens())
    assert all(sum(n) <= size and size in sizes for (_, size), n in used.items())
    total = sum(placed.values())
    assert sum(size for _, size in used) <= 1.01 * total + max(sizes)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, name):
    """Every query over the smallest tables: against its SQL, or what plain code makes of the same rows."""
    from oracle import assert_same, connect

    df = queries.queries()[name](spark, SMALL)
    if name in oracle.oracle_sql():
        assert_same(df, connect(SMALL).sql(oracle.oracle_sql()[name]))
        return
    rows = df.collect()
    if name == "p2_found":
        want = expected_pairs()
        assert sorted(map(tuple, rows)) == want and want
    elif name == "p2_report":
        side = {i: m.strip().lower() for i, m in table("datafile", "rec_id, mode") if m}
        held = {k for p in expected_pairs() for k in p if side[k] != "train"}
        assert sum(r.records for r in rows) == len(held) and {r.mode for r in rows} <= {"test", "val"}
    elif name == "p7_ids":
        assert sorted((r.doc_id, list(r.ids)) for r in rows) == expected_ids()
    elif name == "p8_pack":
        assert_packed(rows, (2048,))
    elif name == "p8_sizes":
        assert_packed(rows, (256, 512, 1024, 2048))
    elif name == "p9_found":
        assert sorted(map(tuple, rows)) == expected_look_alikes()
    else:
        assert name == "p9_form"
        want = {i: None if t is None else lookalike.skeleton(t) for i, t in table("documents", "doc_id, text")}
        assert {r.doc_id: r.form for r in rows} == want


def ranked_by_hand(rows, n):
    groups = {}
    for g, k, v, t, i in {r for r in rows}:
        if k is not None and v is not None and v == v:
            groups.setdefault((g, k), set()).add((-v + 0.0, t is None, t or 0, i))
    return sorted((x[-1], r) for s in groups.values() for r, x in enumerate(sorted(s)[:n], 1))


def test_top_n(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        g, k = ("hot", 0) if rng.random() < 0.5 else (rng.choice(["a", "b", None]), rng.randrange(0, 40))
        v = rng.choice([None, float("nan"), float("inf"), -0.0, 0.0, 0.9, 0.9]) if rng.random() < 0.1 else round(rng.random(), 3)
        rows.append((g, None if rng.random() < 0.02 else k, v, rng.choice([None, rng.randrange(5)]), i))
    rows += rng.sample(rows, 500) + [("one", 1, 0.5, 1, 90_000)]
    df = spark.createDataFrame(rows, "g string, k int, v double, t int, id bigint").selectExpr("*", "1 as _floor", "2 as rank_no").repartition(6)
    want = ranked_by_hand(rows, 5)
    for parts in (20_000, 50, 1):
        got = sorted((r.id, r.rank_no) for r in topn.top_n(df, ["g", "k"], "v", ["t"], "id", 5, heavy_parts=parts).collect())
        assert got == want
    assert topn.top_n(df.limit(0), ["g", "k"], "v", ["t"], "id", 5).count() == 0


@pytest.mark.parametrize("score", ["(id * 7919 % 20000) / 20000.0D", "if(id = 7, 1e12D, (id * 7919 % 20000) / 20000.0D)", "0.5D + (id * 7919 % 20000) / 1e9D"])
def test_floors_cut_a_hot_group(spark, score):
    """Also with an outlier and with scores in a narrow range."""
    df = spark.range(20_000).selectExpr("'x' as g", "0 as k", "id", f"{score} as v")
    df = df.union(df.limit(500))
    least = topn.score_floors(df, ["g", "k"], "v", "id", 5).first()["_floor"]
    assert 5 <= df.filter(df.v >= least).select("id").distinct().count() < 200


def test_many_copies_of_a_winner(spark):
    df = spark.range(50_000).selectExpr("'x' as g", "0 as k", "if(id < 49000, 1, id) as id", "if(id < 49000, 9.0D, id / 1e6D) as v", "1 as t")
    got = [(r.id, r.rank_no) for r in topn.top_n(df, ["g", "k"], "v", ["t"], "id", 3).orderBy("rank_no").collect()]
    assert got == [(1, 1), (49_999, 2), (49_998, 3)]


def cuts_by_hand(s, limit, over):
    gaps = [i for i in range(len(s)) if s[i : i + 10].upper() == "N" * 10 and (i == 0 or s[i - 1] not in "Nn")]
    out, start = [], 0
    while len(s) - start > limit:
        fit = [g for g in gaps if 2 * (g - start) > limit and g <= start + limit]
        end = fit[-1] if fit else start + limit
        out.append((start, end))
        start = end - over
    return [*out, (start, len(s))]


def test_pieces(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        s = "".join(rng.choice(["ACGT", "N" * rng.randrange(1, 25), "n" * 10, "acgtt" * rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, s, rng.choice([8, 20, None, 99])))
    rows += [(900, None, 8), (901, "", 8), (902, "A" * 100_000, 20), (None, "C" * 90, 8)] + rows[:5]
    df = spark.createDataFrame(rows, "rec_id bigint, seq string, context_length int").selectExpr("*", "1 as piece_no", "2 as _limit")
    configs = spark.createDataFrame([(8, 40, False), (20, 61, True)], "context_length int, max_len int, is_default boolean")
    limits = {8: (40, 8), 20: (61, 20), None: (61, 20)}
    want = sorted({(-1 if i is None else i, k, *p) for i, s, c in rows if s and c in limits and len(s) > limits[c][0] for k, p in enumerate(cuts_by_hand(s, *limits[c]), 1)})
    got = sorted((-1 if r.rec_id is None else r.rec_id, r.piece_no, r.piece_start, r.piece_end) for r in pieces.split_long(df, configs).collect())
    assert [g for g in got if g[0] != -1] == [w for w in want if w[0] != -1] and len(got) == len(want)
    assert pieces.split_long(df.limit(0), configs).count() == 0


def test_stronger_boundaries_win(spark):
    """The longest gap in reach is cut at, the rightmost of equally long ones."""
    configs = spark.createDataFrame([(5, 50, True)], "context_length int, max_len int, is_default boolean")

    def first_end(s, **k):
        df = spark.createDataFrame([(1, s, 5)], "rec_id bigint, seq string, context_length int")
        rows = sorted((r.piece_start, r.piece_end) for r in pieces.split_long(df, configs, **k).collect())
        assert rows[-1][1] == len(s)
        return rows[0][1]

    uneven = "A" * 30 + "N" * 12 + "C" * 2 + "N" * 10 + "G" * 90
    assert first_end(uneven) == 44 and first_end(uneven, strength=pieces.GAP_LENGTH) == 30
    ties = "A" * 30 + "N" * 10 + "C" * 5 + "N" * 10 + "G" * 90
    assert first_end(ties) == first_end(ties, strength=pieces.GAP_LENGTH) == 45


def test_range_maxima():
    import numpy as np

    s = np.array([3, 1, 3, 2, 5, 5, 0])
    r = pieces.RangeMax(s)
    for a in range(8):
        for b in range(8):
            want = max(range(a, b), key=lambda i: (s[i], i), default=-1) if a < min(b, 7) and b <= 7 else None
            if want is not None:
                assert r.query(a, b) == want
    assert r.query(3, 3) == -1
    with pytest.raises(ValueError):
        pieces.cut(100, 10, 6, s, s)


SAME = [
    ("ﬁle", "file"), ("ｆｉｌｅ　１", "file 1"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("раурал", "paypaл"), ("ＤＮＡ", "DNA"),
    ("ﾄﾞﾗｲﾌﾞ", "ドライブ"), ("K", "K"), ("Αα", "Aα"), ("⚠️", "⚠"), ("e​́", "é"), ("soft­hyphen", "softhyphen"),
]
DIFFERENT = [("A", "a"), ("é", "e"), ("1", "l"), ("0", "O"), ("a\nb", "a\r\nb"), ("a b", "a  b"), ("a\tb", "a b"), ("x²", "x2"), ("rn", "m"), ("й", "и")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b)
    assert lookalike.skeleton(lookalike.skeleton(a)) == lookalike.skeleton(a)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


def test_look_alike_pairs(spark):
    rows = [(1, "file a"), (2, "ﬁle a"), (3, "file a"), (4, "file а"), (4, "file а"), (5, None), (6, ""), (7, "​"), (8, " "), (9, " "), (None, "file a"), (10, "x" * 300_000 + "ﬁ"), (11, "x" * 300_000 + "fi")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as s1", "2 as t")
    got = sorted(tuple(r) for r in lookalike.look_alikes(df).collect())
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)]
    assert lookalike.look_alikes(df.limit(0)).count() == 0
    forms = {r.doc_id: r.form for r in lookalike.skeletons(df).collect()}
    assert forms[1] == forms[2] == forms[4] and forms[5] is None and forms[6] == ""


def edit_infix(s, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(s, 1):
        last, row = row, [i] + [0] * len(t)
        for j, d in enumerate(t, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


def mutated(rng, s, rate):
    out = []
    for c in s:
        x = rng.random()
        out += [] if x < rate / 3 else [rng.choice("ACGT")] if x < 2 * rate / 3 else [c, rng.choice("ACGT")] if x < rate else [c]
    return "".join(out)


def test_banded_distances():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randrange(20, 150)
        s = "".join(rng.choice("ACGTN") for _ in range(n))
        before = rng.randrange(0, n // 2)
        t = "".join(rng.choice("ACGT") for _ in range(before)) + mutated(rng, s, rng.choice([0.02, 0.08, 0.13])) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(n // 2)))
        want, k = edit_infix(s, t), n // 10
        got = overlap.infix_distance(s.encode(), t.encode(), k, before, before, strip=rng.choice([7, 32, 256]))
        assert (got <= k) == (want <= k) and (want > k or got == want)


def records(seed):
    rng = random.Random(seed)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    element = base(150)
    rows = []

    def add(s, mode):
        if rng.random() < 0.3:
            s = overlap.reverse_complement(s.encode()).decode()
        if rng.random() < 0.2:
            s = s.lower().replace("t", rng.choice("tu"))
        rows.append((len(rows), s, mode))

    for _ in range(16):
        s = base(rng.randrange(200, 380))
        if rng.random() < 0.4:
            s = s[:90] + element + s[90:]
        add(s, "train")
        for _ in range(rng.randrange(0, 3)):
            t = mutated(rng, s, rng.choice([0.0, 0.03, 0.06, 0.09, 0.13]))
            cut = rng.choice([0, 0, len(t) // 3])
            add(t[cut:], rng.choice(["test", " VAL ", "Test", "train"]))
        if rng.random() < 0.4:
            add(base(150) + element + base(60), "test")
    return rows


@lru_cache
def pairs_by_hand(rows):
    out = set()
    comp = str.maketrans("ACGT", "TGCA")
    norm = [(i, s.upper().replace("U", "T"), m.strip().lower()) for i, s, m in rows if s and m]
    for i, a, m in norm:
        for j, b, o in norm:
            if m in ("test", "val") and o == "train":
                s, t = sorted((a, b), key=len)
                if 2 * len(s) >= len(t) and min(edit_infix(s, t), edit_infix(s.translate(comp)[::-1], t)) <= len(s) // 10:
                    out.add((min(i, j), max(i, j)))
    return out


def test_cross_split_pairs(spark):
    rows = records(11)
    want = pairs_by_hand(tuple(rows))
    assert len(want) > 8
    rows += [(5000, None, "test"), (5001, "", "test"), (5002, rows[0][1], None), (5003, "ACGT", "other"), (5004, "N" * 200, "test"), *rows[:4]]
    df = spark.createDataFrame(rows, "rec_id bigint, seq string, mode string").selectExpr("*", "1 as key", "2 as c", "'g' as genome_id")
    found = overlap.cross_split_pairs(df)
    got = {tuple(r) for r in found.collect()}
    assert got == want
    total = overlap.report(df, found).collect()
    assert sum(r.pairs for r in total) == len(want)


def test_copies_of_one_string(spark):
    rng = random.Random(8)
    s = "".join(rng.choice("ACGT") for _ in range(400))
    rows = [(i, mutated(rng, s, 0.02), "train") for i in range(12)] + [(50 + i, mutated(rng, s, 0.02), "test") for i in range(3)]
    df = spark.createDataFrame(rows, "rec_id bigint, seq string, mode string")
    assert overlap.cross_split_pairs(df).count() == 36
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def found_without_spark(a, b):
    from locusframe.llm import blocks

    return blocks.block_pairs(list(range(len(a))), [s.encode() for s in a], list(range(len(b))), [s.encode() for s in b])


def letters(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.mark.parametrize("n", [6000, 8000, 20_000, 60_000])
def test_edits_at_one_end(spark, n):
    rng = random.Random(n)
    s, k = letters(rng, n), n // 10
    hang = letters(rng, k)
    near = [hang + s[k:], s[:-k] + hang, hang + s[: n - k]]
    rows = [(0, s, "train")] + [(i, t, "test") for i, t in enumerate(near, 1)]
    rows.append((9, overlap.reverse_complement(near[0].encode()).decode(), "val"))
    df = spark.createDataFrame(rows, "rec_id bigint, seq string, mode string")
    assert sorted(tuple(r) for r in overlap.cross_split_pairs(df).collect()) == [(0, i) for i in (1, 2, 3, 9)]


def test_many_variants_of_one_gene():
    rng = random.Random(12)
    s = letters(rng, 400)
    swap = lambda t, at: "".join("CGTA"["ACGT".index(c)] if i in at else c for i, c in enumerate(t))
    variants = [swap(s, set(rng.sample(range(400), 4))) for _ in range(300)]
    copy = swap(s, set(range(3, 400, 13)))
    assert len(found_without_spark([copy], variants)) == 300


def test_even_edits_repeats_and_other_letters():
    rng = random.Random(13)
    turn = lambda t, step: "".join("CGTAN"["ACGTN".index(c)] if i % step == step - 1 else c for i, c in enumerate(t))
    even, tandem, dull = letters(rng, 1000), letters(rng, 171) * 175, "N" * 500 + letters(rng, 90) + "RYN" * 100
    copies = [turn(even, 10), tandem[:9000] + letters(rng, 40) + tandem[9000:], dull[:520] + "AC" + dull[523:]]
    assert found_without_spark(copies, [even, tandem, dull]) == {(0, 0), (1, 1), (2, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_blocks_of_all_lengths_by_brute_force(seed):
    """Short, long and very long strings, with shared elements, clumped edits and overhangs, against the plain recurrence."""
    rng = random.Random(seed)
    element = letters(rng, 60)
    train = [letters(rng, n) for n in (1, 4, 8, 9, 12, 20, 37, 64, 150, 300, 900, 4200, 5000)]
    train += [element + letters(rng, 40) for _ in range(5)] + ["N" * 40, "NNAC" * 30]
    held = []
    for t in train:
        k = len(t) // 10
        held += [mutated(rng, t, 0.07), t[k:] if k else t, letters(rng, k) + t[k:], overlap.reverse_complement(t.encode()).decode(), t + letters(rng, len(t) // 2)]
    held += [letters(rng, 30) + element + letters(rng, 10), "N" * 300 + letters(rng, 20)]

    def slow(s, t):
        a, b = sorted((s, t), key=len)
        return 2 * len(a) >= len(b) and any(overlap.infix_distance(x.encode(), b.encode(), len(a) // 10, 0, len(b) - len(a)) <= len(a) // 10 for x in (a, overlap.reverse_complement(a.encode()).decode()))

    want = {(i, j) for i, s in enumerate(held) for j, t in enumerate(train) if slow(s, t)}
    assert found_without_spark(held, train) == want
    assert {(5 * j + 3, j) for j in range(len(train))} <= want


def edited_evenly(t, k):
    """``t`` with ``k`` other letters, as far from each other as can be."""
    at = {(2 * x + 1) * len(t) // (2 * k) for x in range(k)}
    return "".join("CGTAN"["ACGTN".index(c)] if i in at else c for i, c in enumerate(t))


def test_longer_strings_are_counted_by_groups(monkeypatch):
    """Not string by string; with as many edits as allowed, among so many strings that there are several groups."""
    from locusframe.llm import blocks

    monkeypatch.setattr(blocks, "shared_words", None)
    rng = random.Random(14)
    sizes = [400, 409, 449, 899, 900, 1023, 2000, 4095, 4096, 5119, 5120, 9000]
    held = [letters(rng, n) for n in sizes] + [letters(rng, n // 2) + "N" * (n // 5) + letters(rng, n // 4) + "A" * (n // 9) for n in sizes]
    train = [edited_evenly(t, len(t) // 10) for t in held]
    train = [letters(rng, len(t) // 3) + t + letters(rng, len(t) // 2) if i % 2 else t for i, t in enumerate(train)]
    copies = len(train)
    train += [letters(rng, rng.randrange(400, 9000)) for _ in range(40)] + ["N" * rng.randrange(20, 400) + letters(rng, 1500) for _ in range(20)]
    for comp in (False, True):
        turned = [overlap.reverse_complement(t.encode()).decode() if comp else t for t in train]
        assert found_without_spark(held, turned) == {(i, i) for i in range(copies)}
        assert found_without_spark(turned, held) == {(i, i) for i in range(copies)}


def test_unlike_strings_with_many_n_need_no_recurrence(monkeypatch):
    from locusframe.llm import blocks

    rng = random.Random(15)
    mostly = lambda: letters(rng, 432) + "N" * 336 + letters(rng, 432)
    held, train = [mostly()], [mostly() for _ in range(8)]
    monkeypatch.setattr(blocks, "MATCHES", 60_000)
    monkeypatch.setattr(overlap, "infix_distance", None)
    assert found_without_spark(held, train) == set()


def test_words_held_by_groups():
    import numpy as np

    from locusframe.llm import blocks

    rng = random.Random(16)
    texts = [(letters(rng, 300) + "N" * 25 + letters(rng, 200) + "A" * 9 + "C").encode() for _ in range(150)]
    shorts = [(t[:180] + b"N" * 45).decode().encode() for t in texts[:20]]
    _, begin, whole = blocks._joined(texts)
    high = begin + np.array([len(t) for t in texts])
    groups = blocks.Groups(overlap._grams(whole, blocks.WORD), begin, high, blocks._room(whole, begin, high, blocks.WORD))
    key = groups.keys(blocks.Cut(shorts), 0, len(shorts), np.zeros(len(shorts), int))
    got = sum(groups.each(d).astype(int) << x for x, d in enumerate(groups.digits(key)))
    form = lambda t: t.replace(b"N", b"A")
    for i, s in enumerate(shorts):
        cut = [form(s)[x : x + 9] for x in range(0, len(s) - 8, 9)]
        for j, t in enumerate(texts):
            room = sum(len(run) // 9 for run in form(t).replace(b"C", b" ").replace(b"G", b" ").replace(b"T", b" ").split())
            assert got[i, j] == sum(w in form(t) for w in cut if w != b"A" * 9) + min(room, cut.count(b"A" * 9))
    assert (np.unpackbits(groups.reached(key, 9).view(np.uint8), axis=1, bitorder="little")[:, : len(texts)] == (got >= 9)).all()
