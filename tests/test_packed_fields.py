import pyarrow as pa
from pyspark.sql import functions as F

from locusframe.operators import packed_fields as P


def items(text, syntax):
    return P.read_field(pa.array([text], pa.string()), syntax)[2]


def test_numbers():
    assert items('"571,022","571,298",571434', P.NUMBERS) == ["571022", "571298", "571434"]
    assert items('"1 200 278"', P.NUMBERS) == ["1200278"]
    assert items("[4619, 4978]", P.NUMBERS) == ["4619", "4978"]
    assert items("135513 134952;134646/133903;", P.NUMBERS) == ["135513", "134952", "134646", "133903"]
    for nothing in ("", "  ", "NA", ".", "-", ";;", '""', "{}", None):
        assert items(nothing, P.NUMBERS) == []


def test_attributes():
    assert items('gene_id "a"; note "x; y, z"; db_xref "T:1","T:2";', P.ATTRIBUTES) == ["gene_id=a", "note=x; y, z", "db_xref=T:1", "db_xref=T:2"]
    assert items('ID = a ; Note = "the ""short"" form" ; Alias = b, c', P.ATTRIBUTES) == ["ID=a", 'Note=the "short" form', "Alias=b", "Alias=c"]
    assert items("Note=;ID=x%2C;Note=p=0.5", P.ATTRIBUTES) == ["ID=x%2C", "Note=p=0.5"]
    assert items("ID=a|Parent=b\tName=c", P.ATTRIBUTES) == ["ID=a", "Parent=b", "Name=c"]
    assert items('note "";loose;ID=1', P.ATTRIBUTES) == ["ID=1"]
    assert items('Note="never closed; ID=1', P.ATTRIBUTES) == ["Note=never closed; ID=1"]


def test_nesting_and_escapes():
    nested = P.Syntax(entry=b"", value=b",", read=lambda t, f, s: (t, None), nested=True, escape=True)
    assert items('a(b,c),d', nested) == ["a(b,c)", "d"]
    assert items('"a\\",b",c', nested) == ['"a\\",b"', "c"]


def test_many_rows_keep_their_positions():
    rows, pos, found = P.read_field(pa.array(["1,2", None, "", "3", "4;5;6"], pa.string()), P.NUMBERS)
    assert (rows, pos, found) == ([0, 0, 3, 4, 4, 4], [1, 2, 1, 1, 2, 3], ["1", "2", "3", "4", "5", "6"])


def test_table_cases(spark):
    long = ",".join(map(str, range(20_000)))
    rows = [(1, "1,2", "x"), (1, "1,2", "y"), (2, None, "x"), (None, "7", "x"), (3, "", "x"), (4, long, "x")]
    df = spark.createDataFrame(rows, "id bigint, v string, item string")
    out = P.unpack(df, "id", {"v": P.NUMBERS}, "t")
    assert sorted((r.row_id or 0, r.pos, r.item) for r in out.filter("row_id is null or row_id < 4").collect()) == [(0, 1, "7"), (1, 1, "1"), (1, 2, "2")]
    assert out.filter("row_id = 4").agg(F.max("pos")).first()[0] == 20_000
    assert P.unpack(df.limit(0), "id", {"v": P.NUMBERS}, "t").count() == 0
