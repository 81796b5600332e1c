"""Packing items of many lengths into containers of few permitted sizes.

Only the number of items of each length matters to a packing, and lengths are whole numbers up to
the largest container.  So the packing is planned on that histogram, whose size doesn't grow with
the corpus: best fit in falling order of length, whole classes of equal containers at a time.  With
several permitted sizes every set of them is planned, a container being opened in the smallest size
of the set that holds the item and at last cut down to the smallest permitted size that holds its
contents; the plan of least cost is taken.  Items then find their places by their rank among the
items of equal length, in parallel.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.bpe import VOCABULARY, count_ids
from locusframe.session import cut_lineage

#: Parts that the items of one length are ranked in; a length may hold any share of all items.
BUCKETS = 4096


class Kind(NamedTuple):
    """Containers with equal contents: how many, their size, and (length, items of it) in order of place."""

    containers: int
    size: int
    contents: tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], opened: Sequence[int]) -> list[Kind]:
    """Best-fit packing of ``counts`` (items by length), opening the smallest of ``opened`` that holds an item."""
    opened = sorted(opened)
    room: list[int] = []  # rising, different
    by_room: dict[int, list[tuple[int, int, tuple]]] = {}

    def put(left: int, n: int, size: int, contents: tuple) -> None:
        if left not in by_room:
            by_room[left] = []
            insort(room, left)
        by_room[left].append((n, size, contents))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(room, length)
            if k == len(room):
                size = opened[bisect_left(opened, length)]
                per = size // length
                full, rest = divmod(left, per)
                if full:
                    put(size - per * length, full, size, ((length, per),))
                if rest:
                    put(size - rest * length, 1, size, ((length, rest),))
                break
            space = room[k]
            n, size, contents = by_room[space].pop()
            if not by_room[space]:
                del by_room[space]
                room.pop(k)
            per = space // length
            full = min(n, left // per)
            if full:
                put(space - per * length, full, size, (*contents, (length, per)))
                left -= full * per
            if full < n:
                rest = min(left, per)
                if rest:
                    put(space - rest * length, 1, size, (*contents, (length, rest)))
                    left -= rest
                if n - full - bool(rest):
                    put(space, n - full - bool(rest), size, contents)
    return [Kind(n, size, contents) for some in by_room.values() for n, size, contents in some]


def cost(plan: list[Kind]) -> int:
    return sum(k.containers * k.size for k in plan)


def downsized(plan: list[Kind], sizes: Sequence[int]) -> list[Kind]:
    sizes = sorted(sizes)
    return [k._replace(size=sizes[bisect_left(sizes, sum(n * m for n, m in k.contents))]) for k in plan]


def plan_packing(counts: dict[int, int], sizes: Sequence[int]) -> list[Kind]:
    """The cheapest of the plans over all sets of permitted sizes that contain the largest one."""
    sizes = sorted(set(sizes))
    if not counts:
        return []
    plans = (downsized(best_fit(counts, (*some, sizes[-1])), sizes) for r in range(len(sizes)) for some in combinations(sizes[:-1], r))
    return min(plans, key=lambda p: (cost(p), sum(k.containers for k in p)))


class Places:
    """Finds the container of an item from its length and its rank among the items of that length."""

    def __init__(self, plan: list[Kind]):
        rows, first = [], 0
        for kind in sorted(plan, key=lambda k: k.contents, reverse=True):
            offset = 0
            for length, per in kind.contents:
                rows.append((length, per, kind.containers * per, first, kind.size, offset))
                offset += length * per
            first += kind.containers
        rows.sort(key=lambda r: (r[0], r[3]))
        a = np.array(rows, np.int64).reshape(-1, 6)
        self.length, self.per, self.first, self.size, self.offset = a[:, 0], a[:, 1], a[:, 3], a[:, 4], a[:, 5]
        before = np.cumsum(a[:, 2]) - a[:, 2]
        head = np.searchsorted(self.length, self.length)
        self.rank = before - before[head] if len(a) else before
        self.key = self.length << 44 | self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Container, its size, and the item's place in it."""
        k = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        nth = rank - self.rank[k]
        return self.first[k] + nth // self.per[k], self.size[k], self.offset[k] + nth % self.per[k] * length


def pack(items: DataFrame, key: str, length: str, sizes: Sequence[int] = (2048,), buckets: int = BUCKETS) -> DataFrame:
    """Each item with its container: key, part_no, part_from, ``length``, container_id, container_size, place.

    ``items`` should be cheap to read twice.  Items longer than the largest size are split into parts
    of that size and a rest (part_no from 1, part_from its first unit); others are never split.
    Null lengths and lengths below 1 have nothing to place and give no row.  Equal or null keys are
    items of their own.  The result depends only on keys and lengths.  Further columns aren't carried.
    An empty table gives no rows.
    """
    top = max(sizes)
    n = F.col(length).cast("long")
    parts = (
        items.filter(n >= 1)
        .select(F.col(key).alias("_key"), n.alias("_n"), F.explode(F.sequence(F.lit(0), F.ceil(n / F.lit(top)).cast("int") - 1)).alias("_part"))
        .select("_key", "_part", F.least(F.lit(top), F.col("_n") - F.col("_part") * top).alias("_len"), F.pmod(F.xxhash64("_key", "_part"), F.lit(buckets)).cast("int").alias("_bucket"))
    )
    tallies = parts.groupBy("_len", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    counts = {int(r[0]): int(r[1]) for r in tallies.groupBy("_len").agg(F.sum("_count")).collect()}  # at most ``top`` rows
    places = Places(plan_packing(counts, sizes))
    before = Window.partitionBy("_len").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tallies.select("_len", "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_len", "_bucket").orderBy("_key", "_part")) - 1
    ranked = parts.withColumn("_rank", rank).join(offsets, ["_len", "_bucket"]).select("_key", "_part", "_len", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, size, nth = (np.asarray(b.column(c)).astype(np.int64) for c in (1, 2, 3))
            container, capacity, place = places.find(size, nth)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(part + 1, pa.int32()), pa.array(part * top), pa.array(size), pa.array(container), pa.array(capacity, pa.int32()), pa.array(place, pa.int32())],
                names=[key, "part_no", "part_from", length, "container_id", "container_size", "place"],
            )

    kind = items.schema[key].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{key}` {kind}, part_no int, part_from bigint, `{length}` bigint, container_id bigint, container_size int, place int")


def pack_texts(docs: DataFrame, sizes: Sequence[int] = (2048,), key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``pack`` of texts by their number of ids under a public tokenizer; texts are encoded once."""
    counted = count_ids(docs, key, text, "n_tokens", vocabulary, folder)
    return pack(cut_lineage(counted), key, "n_tokens", sizes)
