import numpy as np

from locusframe.operators import bad_rows as B

GOOD = "c1\ts\tCDS\t5\t9\t.\t+\t0\tID=a;Parent=b"


def with_column(i, value):
    f = GOOD.split("\t")
    f[i] = value
    return "\t".join(f)


CASES = [
    (GOOD, None),
    (with_column(8, 'gene_id "a b"; note "x; ""y""";'), None),
    (with_column(8, "ID = a ; Note = b, c"), None),
    (with_column(5, "-1.5E+10"), None),
    (with_column(3, "0005"), None),
    (GOOD + "\t", "columns"),
    ("c1 s CDS", "columns"),
    (with_column(8, 'ID="a'), "quoting"),
    (with_column(8, 'ID="a"x'), "quoting"),
    (with_column(8, 'ID=a"'), "quoting"),
    (with_column(8, 'ID=a"b"'), "quoting"),
    (with_column(2, "cds"), "value"),
    (with_column(3, "0"), "value"),
    (with_column(3, "10"), "value"),
    (with_column(4, "9.0"), "value"),
    (with_column(4, "９"), "value"),
    (with_column(5, "1e999"), "value"),
    (with_column(5, "nan"), "value"),
    (with_column(6, "−"), "value"),
    (with_column(7, "."), "value"),
    (with_column(8, ""), "attributes"),
    (with_column(8, "."), "attributes"),
    (with_column(8, "ID=a;;Parent=b"), "attributes"),
    (with_column(8, "ID=a;Name;Level=2"), "attributes"),
    (with_column(8, "ID=a;=lost"), "attributes"),
    (with_column(8, "ID=a;true"), "attributes"),
    (with_column(8, "ID=a;Note="), "attributes"),
]


def test_diagnosis():
    assert [(B.fault(line), line) for line, _ in CASES] == [(why, line) for line, why in CASES]
    assert B.fault(with_column(2, "x").replace("ID=a", 'ID="a')) == "quoting"


def test_blocks_agree_with_the_diagnosis():
    rng = np.random.default_rng(1)
    lines = [CASES[i][0] for i in rng.integers(0, len(CASES), 3000)] + [GOOD] * 5000 + ["a\rb"]
    good, bad = B.Loader().load(lines)
    assert sorted(bad) == [(i, why) for i, x in enumerate(lines) if (why := B.fault(x))]
    assert sorted(p for at, _ in good for p in at) == [i for i, x in enumerate(lines) if not B.fault(x)]


def test_table_cases(spark):
    rows = [(1, GOOD + "\r\n"), (2, "# x"), (3, None), (4, "  "), (5, "x"), (5, "x"), (6, "x" * 200_000), (None, "y")]
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string").selectExpr("*", "'z' as reason", "1 as start")
    assert sorted((r.line_id or 0, r.reason) for r in B.faulty_lines(df).collect()) == [(0, "columns"), (5, "columns"), (6, "columns")]
    loaded = B.load_rows(df).collect()
    assert [(r.line_id, r["start"], r.score, r.phase, r.attributes) for r in loaded] == [(1, 5, None, 0, "ID=a;Parent=b")]
    assert B.faulty_lines(df.limit(0)).count() == B.load_rows(df.limit(0)).count() == 0
