"""Comparison of a query with its SQL over the same tables."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


def assert_same(df, relation):
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert got == want
