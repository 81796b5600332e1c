"""Interval operators that stay parallel inside one hot contig.

Order-dependent operators cut the sorted rows into range tiles (which may fall anywhere inside a
contig), run windows inside tiles and pass on one row for each tile and group: what a tile carries to
the next ones.  So no task holds a whole contig, however large its share of the rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from locusframe.operators.grouped import map_groups
from locusframe.session import cut_lineage, write_once


def range_tiles(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` in the ranges of ``order``, numbered by _tile, written once so that the ranges stay."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("_tile", F.spark_partition_id()))


def _alike(columns: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def carried(tiles: DataFrame, group: list[str], order: list, value: Column, out: str, how: str, inclusive: bool = False) -> DataFrame:
    """``out``: over the rows of the group before each row, the ``last`` non-null, ``max``, ``min`` or ``sum`` of ``value``."""
    rows = tiles.withColumn("_v", value)
    here = Window.partitionBy(*group, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*group).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    if how == "last":
        fold = lambda w: F.last("_v", ignorenulls=True).over(w)
        whole = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*[o if isinstance(o, str) else o for o in order])))
    else:
        f = {"max": F.max, "min": F.min, "sum": F.sum}[how]
        fold = lambda w: f("_v").over(w)
        whole = f("_v")
    marks = rows.groupBy(*group, "_tile").agg(whole.alias("_v")).withColumn("_c", fold(before)).select(*group, "_tile", "_c")
    local = rows.withColumn("_l", fold(here))
    joined = local.alias("t").join(marks.alias("m"), _alike([*group, "_tile"], "t", "m")).select("t.*", "m._c")
    pick = {
        "last": F.coalesce("_l", "_c"),
        "max": F.greatest("_l", "_c"),
        "min": F.least("_l", "_c"),
        "sum": F.coalesce("_l", F.lit(0)) + F.coalesce("_c", F.lit(0)),
    }[how]
    return joined.withColumn(out, pick).drop("_v", "_l", "_c")


def overlap_groups(df: DataFrame, group: list[str], start: str, end: str, tie: str, out: str = "overlap_no") -> DataFrame:
    """Number of each row's run of overlapping calls, from 0 in every group.

    In the order (start, end, tie) a run ends where a start reaches the end of the call just before:
    that call's end counts, not the furthest one.  Rows with null coordinates must be filtered before.
    """
    tiles = range_tiles(df, [*group, start, end, tie])
    order = [start, end, tie]
    seen = carried(tiles, group, order, F.col(end), "_prev", "last")
    broken = (F.col("_prev").isNotNull() & (F.col(start) >= F.col("_prev"))).cast("bigint")
    return carried(seen, group, order, broken, out, "sum", inclusive=True).drop("_prev", "_tile")


def within_margin(df: DataFrame, group: list[str], score: str, margin: float) -> DataFrame:
    """Rows whose score is at most ``margin`` below the best of their group; null scores go.

    The best scores are aggregated before they meet the rows, so a hot group isn't sorted in one task.
    """
    best = df.groupBy(*group).agg(F.max(score).alias("_best"))
    return df.alias("t").join(best.alias("m"), _alike(group, "t", "m")).select("t.*", "m._best").filter(F.col("_best") - F.col(score) <= margin).drop("_best")


def _pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Rows with equal first ``keys`` columns, that follow each other, and the arrays of their other columns."""
    now, held = None, []
    for b in batches:
        names = list(zip(*(b.column(k).to_pylist() for k in range(keys))))
        rest = [np.asarray(c) for c in b.columns[keys:]]
        cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        for x, y in zip([0, *cuts], [*cuts, len(names)]):
            if x == y:
                continue
            if names[x] != now and held:
                yield now, [np.concatenate(c) for c in zip(*held)]
                held = []
            now = names[x]
            held.append([c[x:y] for c in rest])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def _next_anchors(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Of each start, taken for an anchor, the first start after its end; the number of starts if there is none."""
    return np.maximum(np.arange(1, len(s) + 1), np.searchsorted(s, e, "right"))


def _passages(kinds: list[pa.DataType]):
    """What a tile makes of an anchor that reaches into it: by the end of that anchor, the end of the last anchor and how many begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, (s, e) in _pieces(batches, len(kinds)):
            after = _next_anchors(s, e)
            end, count = e.copy(), np.ones(len(s), np.int64)
            for i in range(len(s) - 1, -1, -1):
                if after[i] < len(s):
                    end[i], count[i] = end[after[i]], count[after[i]] + 1
            last = np.flatnonzero(np.concatenate([(end[1:] != end[:-1]) | (count[1:] != count[:-1]), [True]]))
            rows.append((*key, s[last].tolist(), end[last].tolist(), count[last].tolist()))
        if rows:
            lists = [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*kinds, *lists])], names=[f"c{i}" for i in range(len(kinds) + 3)])

    return run


def _numbered_loci(kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (s, e, reach, before) in _pieces(batches, len(kinds)):
            after, locus = _next_anchors(s, e), np.full(len(s), before[0] - 1, np.int64)
            i, number = int(np.searchsorted(s, reach[0], "right")), int(before[0])
            while i < len(s):
                locus[i : after[i]] = number
                i, number = int(after[i]), number + 1
            same = [pa.array([k], t).take(pa.array(np.zeros(len(s), np.int64))) for k, t in zip(key[:-1], kinds)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(s), pa.array(locus)], names=[f"c{i}" for i in range(len(kinds) + 1)])

    return run


def anchor_loci(df: DataFrame, group: list[str], start: str, end: str, score: str, tie: str, out: str = "locus_no") -> DataFrame:
    """Locus of each row inside its ``group``: loci begin with anchors in the order (start, score falling, tie).

    The first row is an anchor; the first row that begins after an anchor's last base is the next one.
    ``end`` is the last base.  Only the best row of each start can be an anchor.  The chain goes through
    range tiles of the different starts: each tile tells where every anchor that may reach into it leads,
    the tiles of a group are passed in their order by these, and loci are numbered inside the tiles.
    """
    best = df.groupBy(*group, F.col(start).cast("bigint").alias("_s")).agg(F.min_by(end, F.struct(-F.col(score), F.col(end), F.col(tie))).cast("bigint").alias("_e"))
    tiles = range_tiles(best, [*group, "_s"]).select(*group, F.col("_tile").cast("bigint").alias("_tile"), "_s", "_e")
    keys = [*group, "_tile"]
    fields = [*(T.StructField(g, df.schema[g].dataType) for g in group), T.StructField("_tile", T.LongType())]
    kinds = [f.type for f in to_arrow_schema(T.StructType(fields))]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("_last", "_end", "_count")]
    passages = tiles.sortWithinPartitions(*keys, "_s").mapInArrow(_passages(kinds), T.StructType([*fields, *lists]))

    def through(rows: list[dict]) -> list[tuple]:
        found, reach, number = [], -(1 << 62), 0
        for r in rows:
            found.append((*(r[k] for k in keys), reach, number))
            k = bisect_right(r["_last"], reach)
            if k < len(r["_last"]):
                reach, number = r["_end"][k], number + r["_count"][k]
        return found

    entries = map_groups(passages, group, ["_tile"], through, T.StructType([*fields, T.StructField("_reach", T.LongType()), T.StructField("_before", T.LongType())]))
    met = tiles.alias("t").join(entries.alias("m"), _alike(keys, "t", "m")).select("t.*", "m._reach", "m._before").repartition(*keys).sortWithinPartitions(*keys, "_s")
    loci = met.mapInArrow(_numbered_loci(kinds), T.StructType([*fields[:-1], T.StructField("_s", T.LongType()), T.StructField(out, T.LongType())]))
    rows = df.withColumn("_s", F.col(start).cast("bigint"))
    return rows.alias("t").join(loci.alias("m"), _alike([*group, "_s"], "t", "m")).select("t.*", f"m.{out}").drop("_s")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int = 1 << 16) -> DataFrame:
    """Pairs with equal ``on`` whose half-open spans share a base; each pair once.

    Spans meet in bins of positions, so the join is an equi join on (``on``, bin) that AQE can split,
    and the bin of the later start alone reports the pair.  Other columns of both sides stay; the
    right ones must have other names.
    """
    (ls, le), (rs, re_) = left_span, right_span

    def binned(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        return df.filter(F.col(s) < F.col(e)).withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size))))

    a, b = binned(left, ls, le, "_bin"), binned(right, rs, re_, "_rbin")
    b = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = F.col("_bin") == F.col("_rbin")
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_r_{c}"))
    cond = cond & (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.floor(F.greatest(F.col(ls), F.col(rs)) / bin_size) == F.col("_bin"))
    return a.join(b, cond).drop("_bin", "_rbin", *[f"_r_{c}" for c in on])


def neighbours(df: DataFrame, group: list[str], start: str, end: str, tie: str) -> DataFrame:
    """``upstream``: the greatest end before the start; ``downstream``: the least start after the end; null if none.

    Inclusive spans.  Ends and probes are sorted together; the running maximum of the ends is the
    nearest one to the left (and mirrored to the right).
    """
    spans = write_once(df.select(*group, tie, start, end))
    out = df
    for name, probe, value, sign, how in (("upstream", start, end, 1, "max"), ("downstream", end, start, -1, "min")):
        # a value at the probe's own position comes after it
        probes = spans.select(*group, F.col(tie), (F.col(probe) * sign).alias("_p"), F.lit(0).alias("_k"), F.lit(None).cast("bigint").alias("_value"))
        values = spans.select(*group, F.col(tie), (F.col(value) * sign).alias("_p"), F.lit(1).alias("_k"), F.col(value).cast("bigint").alias("_value"))
        tiles = range_tiles(probes.unionByName(values), [*group, "_p", "_k", tie])
        near = carried(tiles, group, ["_p", "_k", tie], F.col("_value"), name, how).filter("_k = 0").select(*group, tie, name)
        out = out.alias("t").join(near.alias("m"), _alike([*group, tie], "t", "m")).select("t.*", f"m.{name}")
    return out


def flanks(df: DataFrame, upstream: int = 1000, downstream: int = 500) -> DataFrame:
    """flank_start and flank_end of genes: so many bases before and after in sense direction, stopped by neighbours and the contig.

    ``df``: strand, start, end, upstream, downstream (of ``neighbours``) and contig_size.
    """
    before = F.when(F.col("strand") == "+", upstream).otherwise(downstream)
    after = F.when(F.col("strand") == "+", downstream).otherwise(upstream)
    return df.withColumn("flank_start", F.greatest(F.col("start") - before, F.col("upstream"), F.lit(1))).withColumn("flank_end", F.least(F.col("end") + after, F.col("downstream"), F.col("contig_size")))


def enough_flank(least: int = 200) -> Column:
    """Whether a flank is long enough or was cut by a neighbour, not by the contig's end."""
    left = (F.col("start") - F.col("flank_start") >= least) | (F.col("flank_start") != 1)
    right = (F.col("flank_end") - F.col("end") >= least) | (F.col("flank_end") != F.col("contig_size"))
    return left & right


def resolve_opposite_strands(df: DataFrame, group: str, start: str, end: str, strand: str, score: str, key: str) -> DataFrame:
    """Keys that stay after overlaps between strands are resolved along each contig.

    In the order (start, end, score falling, key) a row gives way to the next one if that is on the other
    strand, overlaps it and has a higher score; only neighbours are compared, so a weaker later row stays.
    Range tiles may fall inside a contig, so a hot one is no single task.
    """
    rows = df.select(*(F.col(c) for c in (group, start, end, strand, score, key))).withColumn("_down", -F.col(score))
    order = [start, end, "_down", key]
    tiles = range_tiles(rows, [group, *order])
    own = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate((start, end, strand, score, key))))
    seen = carried(tiles, [group], order, own, "_before", "last")
    before = lambda i: F.col("_before")[f"c{i}"]
    beaten = (before(2) != F.col(strand)) & (F.col(start) < before(1)) & (before(0) < F.col(end)) & (F.col(score) > before(3))
    gone = seen.filter(beaten).select(before(4).alias(key))
    return rows.select(key).join(gone, key, "left_anti")
