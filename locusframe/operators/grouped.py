"""Sequential work on the rows of small groups, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_groups(df: DataFrame, keys: list[str], order: list, fn: Callable[[list[dict]], list[tuple]], schema: T.StructType) -> DataFrame:
    """``fn`` of the rows (dicts) of each group, in ``order``; its tuples become rows of ``schema``.

    Groups are found in sorted partitions, so a group costs no call between processes of its own.  A
    group is held in memory while ``fn`` works on it: for groups whose size the operator bounds.
    """
    kinds = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], names=kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now and held:
                    out += fn(held)
                    held = []
                now = key
                held.append(row)
            yield batch(out)
        if held:
            yield batch(fn(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
