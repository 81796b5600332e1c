"""Cutting long strings into overlapping pieces at natural boundaries.

A sparse table of range maxima over the boundaries of one string answers "the strongest boundary in
this window, the rightmost of equals" in constant time, so a string takes time in proportion to its
boundaries and pieces, not to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An assembly gap: the place where an unbroken run of ten or more N begins.
GAP_BEGIN = "(?<![Nn])(?=[Nn]{10})"
#: A gap's letters, from its begin.
GAP_LENGTH = "^[Nn]+"


class RangeMax:
    """Index of the greatest strength in a range of boundaries, the rightmost of equals."""

    def __init__(self, strengths: np.ndarray):
        self.s = strengths
        self.levels = [np.arange(len(strengths))]
        width = 1
        while 2 * width <= len(strengths):
            below = self.levels[-1]
            self.levels.append(self._better(below[:-width], below[width:]))
            width *= 2

    def _better(self, left, right):
        return np.where(self.s[right] >= self.s[left], right, left)

    def query(self, lo: int, hi: int) -> int:
        """Best index in [lo, hi), -1 if the range is empty."""
        if hi <= lo:
            return -1
        k = (hi - lo).bit_length() - 1
        return int(self._better(self.levels[k][lo], self.levels[k][hi - (1 << k)]))


def cut(length: int, limit: int, overlap: int, at: np.ndarray, strengths: np.ndarray) -> list[tuple[int, int]]:
    """Pieces (start, end) of a string of ``length``; ``at`` holds the rising boundaries.

    Each piece but the last ends at the strongest boundary in (start + limit/2, start + limit], the
    rightmost of equals, or at start + limit if there is none; the next one starts ``overlap`` before.
    """
    if 2 * overlap > limit:
        raise ValueError(f"an overlap of {overlap} is more than half of the limit {limit}")
    best = RangeMax(strengths)
    pieces, start = [], 0
    while length - start > limit:
        lo, hi = np.searchsorted(at, [start + limit // 2, start + limit], "right")
        k = best.query(int(lo), int(hi))
        end = int(at[k]) if k >= 0 else start + limit
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, length))
    return pieces


def split_long(df: DataFrame, configs: DataFrame, key: str = "rec_id", text: str = "seq", config: str = "context_length", limit: str = "max_len", default: str = "is_default", boundary: str = GAP_BEGIN, strength: str | None = None) -> DataFrame:
    """Pieces of every ``text`` longer than the ``limit`` of its ``config``, as offsets.

    Columns: key, piece_no (from 1), piece_start, piece_end (0-based, half-open).  ``config`` doubles
    as the overlap; null means the row of ``configs`` marked ``default``.  Null, empty and short texts
    and those whose config isn't listed (or has no limit) give no rows; repeated rows of a key give
    its pieces once; an empty table gives no rows; further columns aren't read.  Texts are searched
    for boundaries in the JVM and only distances and strengths travel to Python.  All boundaries are equally
    strong, or as strong as what the pattern ``strength`` matches right after them is long (GAP_LENGTH: the
    longest gap in reach wins).
    """
    listed = configs.filter(F.col(limit).isNotNull()).groupBy(F.col(config).alias("_config")).agg(F.min(limit).alias("_limit"), F.max(F.coalesce(default, F.lit(False))).alias("_default"))
    fallback = listed.filter("_default").select(F.lit(None).cast("int").alias("_config"), "_limit", F.col("_config").alias("_overlap"))
    listed = listed.filter("_config is not null").select("_config", "_limit", F.col("_config").alias("_overlap")).unionByName(fallback)
    parts = F.split(text, boundary, -1)
    long_ones = (
        df.select(key, text, config)
        .join(listed, F.col(config).eqNullSafe(F.col("_config")))
        .filter(F.length(text) > F.col("_limit"))
        .select(
            F.col(key),
            F.length(text).alias("n"),
            F.col("_limit").cast("int").alias("lim"),
            F.col("_overlap").cast("int").alias("over"),
            F.transform(parts, lambda x: F.length(x)).alias("runs"),
            F.transform(parts, lambda x: F.length(F.regexp_extract(x, strength, 0)) if strength else F.lit(1)).alias("strong"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, number, starts, ends = [], [], [], []
            for i, (n, lim, over, runs, strong) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 6)))):
                at = np.cumsum(np.array(runs, np.int64))[:-1]
                for k, (s, e) in enumerate(cut(n, lim, over, at, np.array(strong[1:], np.int64)), 1):
                    keys.append(i)
                    number.append(k)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keys, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=[key, "piece_no", "piece_start", "piece_end"],
            )

    kind = df.schema[key].dataType.simpleString()
    return long_ones.mapInArrow(run, f"`{key}` {kind}, piece_no int, piece_start bigint, piece_end bigint").distinct()
