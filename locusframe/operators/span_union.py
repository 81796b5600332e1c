"""Covered periods of overlapping spans and the gaps between them.

Sorted lists of disjoint spans are merged in a tree: the spans of a batch become one list for each
group and tile of positions, lists meet first under a salt and then under the tile.  A list holds at
most half as many spans as its tile has positions, however many rows a group has.  Tiles are joined
by their ends alone: windows over one row for each tile carry the furthest end from the left and
fetch the end of a period that the tile's last span begins from the right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.session import cut_lineage, workers

TILE_BITS = 20
#: Spans that wait for their group's end before they are merged to one list.
WAITING = 1 << 20


def merge_runs(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint, not touching spans of each group, by group and start; groups are numbered from 0.

    The sort is one that merges the rising runs it finds, so lists put end to end are merged in linear steps.
    """
    if not len(lo):
        return group, lo, hi
    span = int(hi.max()) - int(lo.min()) + 2
    narrow = span * (int(group.max()) + 1) < 1 << 62
    order = np.argsort(lo - lo.min() + group * span, kind="stable") if narrow else np.lexsort((lo, group))
    group, lo, hi = group[order], lo[order], hi[order]
    if narrow:
        shifted = hi - lo.min() + group * span
        reach = np.maximum.accumulate(shifted) - group * span + lo.min()
    else:  # coordinates too wide to keep groups apart by a shift
        reach = hi.copy()
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(heads, np.append(heads[1:], len(group))):
            reach[a:b] = np.maximum.accumulate(hi[a:b])
    new = np.ones(len(lo), bool)
    new[1:] = (group[1:] != group[:-1]) | (lo[1:] > reach[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(lo)) - 1
    return group[head], lo[head], reach[last]


def _numbered(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different combination of values (nulls are values), and a row of each."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        codes = np.asarray(c.dictionary_encode(null_encoding="encode").indices).astype(np.int64)
        _, key = np.unique(key * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return number, first


def _lists(keys: list[pa.Array], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, names: list[str]) -> pa.RecordBatch:
    group, lo, hi = merge_runs(group, lo, hi)
    there, begin = np.unique(group, return_index=True)
    offsets = pa.array(np.append(begin, len(lo)), pa.int32())
    some = pa.array(first[there])
    return pa.RecordBatch.from_arrays([*(k.take(some) for k in keys), pa.ListArray.from_arrays(offsets, pa.array(lo)), pa.ListArray.from_arrays(offsets, pa.array(hi))], names=names)


def _first_lists(n_keys: int, names: list[str], tile_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lo, hi = (np.asarray(b.column(n_keys + i)) for i in (0, 1))
            keys = [*b.columns[:n_keys], pa.array(lo >> tile_bits)]
            number, first = _numbered(keys)
            yield _lists(keys, number, lo, hi, first, names)

    return run


def _merge_lists(n_keys: int, names: list[str]):
    """Merges the lists of equal keys in sorted partitions; the last group waits for the next batch.

    What waits is merged whenever it passes WAITING spans, so a group holds its merged list and that much.
    """

    def merged(table: pa.Table) -> pa.RecordBatch:
        b = table.combine_chunks().to_batches()[0]
        keys, lows, highs = b.columns[:n_keys], b.column(n_keys), b.column(n_keys + 1)
        number, first = _numbered(keys)
        sizes = np.diff(np.asarray(lows.offsets))
        return _lists(keys, np.repeat(number, sizes), np.asarray(lows.flatten()), np.asarray(highs.flatten()), first, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = [c[b.num_rows - 1] for c in b.columns[:n_keys]]
            cut = b.num_rows
            while cut and [c[cut - 1] for c in b.columns[:n_keys]] == last:
                cut -= 1
            if cut or (wait and [c[0] for c in wait[-1].columns[:n_keys]] != last):
                wait.append(b.slice(0, cut))
                table = pa.Table.from_batches([w for w in wait if w.num_rows])
                if table.num_rows:
                    yield merged(table)
                wait = []
            wait.append(b.slice(cut))
            if len(wait) > 1 and sum(len(w.column(n_keys).flatten()) for w in wait[1:]) > WAITING:
                wait = [merged(pa.Table.from_batches(wait))]
        table = pa.Table.from_batches(wait) if wait else None
        if table is not None and table.num_rows:
            yield merged(table)

    return run


def tile_lists(df: DataFrame, group: list[str], start: str, end: str, tile_bits: int = TILE_BITS, salts: int | None = None) -> DataFrame:
    """One row for each group and tile with spans: _tile and the rising, disjoint _lo and _hi."""
    salts = salts or workers(df.sparkSession)
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    lists = f"{kinds}, _tile bigint, _lo array<bigint>, _hi array<bigint>"
    a, b = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    spans = df.filter(a.isNotNull() & b.isNotNull()).select(*group, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))
    spans = spans.filter("_a < _b")
    first = spans.mapInArrow(_first_lists(len(group), [*group, "_tile", "_lo", "_hi"], tile_bits), lists)
    keys = [*group, "_tile"]
    salted = first.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).select(*keys, "_salt", "_lo", "_hi")
    for some, names in ((salted, [*keys, "_salt"]), (None, keys)):
        some = some if some is not None else first.select(*keys, "_lo", "_hi")
        schema = f"{kinds}, _tile bigint, {'_salt int, ' if '_salt' in names else ''}_lo array<bigint>, _hi array<bigint>"
        first = some.repartition(*names).sortWithinPartitions(*names).mapInArrow(_merge_lists(len(names), [*names, "_lo", "_hi"]), schema)
    return first


def periods_and_gaps(df: DataFrame, group: list[str], start: str, end: str, tile_bits: int = TILE_BITS, salts: int | None = None) -> DataFrame:
    """kind (``period`` or ``gap``), the group, span_start, span_end.

    Half-open spans; touching spans are unbroken; a span written backwards is the same span; spans with
    a null or equal coordinates cover nothing.  A null in ``group`` is a value like others (filter such
    rows before if they shouldn't count).  Repeated spans change nothing.  An empty table gives no rows;
    other columns aren't read.
    """
    tiles = cut_lineage(tile_lists(df, group, start, end, tile_bits, salts))
    alike = [F.col(f"t.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group] + [F.col("t._tile") == F.col("s._tile")]
    same = alike[0]
    for x in alike[1:]:
        same = same & x
    here = Window.partitionBy(*group).orderBy("_tile")
    ends = tiles.select(*group, "_tile", F.element_at("_hi", -1).alias("_end"))
    carried = ends.withColumn("_carry", F.max("_end").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    joined = tiles.alias("t").join(carried.alias("s"), same).select("t.*", "s._carry", "s._end")
    swallowed = F.when(F.col("_carry").isNull(), 0).otherwise(F.size(F.filter("_lo", lambda x: x <= F.col("_carry"))))
    joined = joined.withColumn("_k", swallowed).withColumn("_n", F.size("_lo"))
    before = F.greatest(F.col("_carry"), F.when(F.col("_k") > 0, F.element_at("_hi", F.greatest(F.col("_k"), F.lit(1)))))
    joined = joined.withColumn("_before", before)
    later = here.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*group)
    closing = (
        joined.select(*group, "_tile", "_end", F.when(F.col("_k") < F.col("_n"), F.col("_before")).alias("_first"), (F.col("_k") < F.col("_n")).alias("_any"))
        .withColumn("_close", F.coalesce(F.first(F.when(F.col("_any"), F.col("_first")), ignorenulls=True).over(later), F.max("_end").over(whole)))
        .select(*group, "_tile", "_close")
    )
    rest = joined.filter("_k < _n").alias("t").join(closing.alias("s"), same).select("t.*", "s._close")
    kept_lo = F.slice("_lo", F.col("_k") + 1, F.col("_n") - F.col("_k"))
    inner = F.slice("_hi", F.col("_k") + 1, F.col("_n") - F.col("_k") - 1)
    rows = F.arrays_zip(kept_lo.alias("a"), F.concat(F.array("_before"), inner).alias("p"), F.concat(inner, F.array("_close")).alias("b"))
    flat = rest.select(*group, F.explode(rows).alias("r")).select(*group, F.col("r.a").alias("a"), F.col("r.p").alias("p"), F.col("r.b").alias("b"))
    both = flat.select(*group, F.explode(F.array(F.struct(F.lit("period").alias("kind"), F.col("a").alias("s"), F.col("b").alias("e")), F.struct(F.lit("gap").alias("kind"), F.col("p").alias("s"), F.col("a").alias("e")))).alias("x"))
    return both.filter("x.s is not null").select(F.col("x.kind").alias("kind"), *group, F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"))
