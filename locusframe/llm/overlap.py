"""Records of one split that occur, exactly or almost, in records of another one.

Classes of equal strings are compared in ``blocks``, which misses no pair; here are the rows of a table, the
distance that decides, and the pairs and report of the records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.blocks import all_links
from locusframe.session import write_once

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_COMPLEMENT = bytes.maketrans(b"ACGTRYKMBVDHSWN", b"TGCAYRMKVBHDSWN")


def reverse_complement(s: bytes) -> bytes:
    return s.translate(_COMPLEMENT)[::-1]


def infix_distance(s: bytes, text: bytes, k: int, d_lo: int, d_hi: int, strip: int = 256) -> int:
    """Least edits between ``s`` and a stretch of ``text`` on diagonals (text - s) from d_lo - k to d_hi + k.

    The columns of the dynamic program are bit vectors of vertical differences; strip by strip the
    vectors are cut to the rows of the band, rows above it and below it counting as unreachable.
    """
    n, lo, hi = len(s), d_lo - k, d_hi + k
    left, right = max(0, lo), min(len(text), n + hi)
    where: dict[int, int] = {}
    for ch in set(s):
        where[ch] = int("".join("1" if x == ch else "0" for x in reversed(s)), 2) if n < 64 else int.from_bytes(np.packbits(np.frombuffer(s, np.uint8) == ch, bitorder="little").tobytes(), "little")
    top_row, bottom = 0, min(n, max(1, left - lo + 1))
    width = bottom
    up, down, score, best = (1 << width) - 1, 0, bottom, n
    for begin in range(left, right, strip):
        end = min(right, begin + strip)
        new_bottom = min(n, max(bottom, end - lo + 1))
        if new_bottom > bottom:
            up |= ((1 << new_bottom - bottom) - 1) << bottom - top_row
            score += new_bottom - bottom
            bottom = new_bottom
        new_top = max(top_row, min(begin - hi - 1, bottom - 1), 0)
        if new_top > top_row:
            up >>= new_top - top_row
            down >>= new_top - top_row
            top_row = new_top
        width = bottom - top_row
        mask, last, enter = (1 << width) - 1, 1 << width - 1, int(top_row > 0)
        eq_of = {ch: w >> top_row & mask for ch, w in where.items()}
        for ch in text[begin:end]:
            eq = eq_of.get(ch, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            rise = down | (mask & ~(xh | up))
            fall = up & xh
            if rise & last:
                score += 1
            elif fall & last:
                score -= 1
            rise = rise << 1 | enter
            up = mask & (fall << 1 | ~(xv | rise))
            down = mask & rise & xv
            if score < best and bottom == n:
                best = score
    return best


def _grams(s: bytes, q: int = 8) -> np.ndarray:
    """The number of the ``q`` letters at each position; other letters than ACGT count as A."""
    one = _CODE[np.frombuffer(s, np.uint8)] & 3
    n = max(len(one) - q + 1, 0)
    kind = np.uint16 if q <= 8 else np.int32
    have, some, done, out = 1, one.astype(kind), 0, np.zeros(n, kind)
    while True:  # ``some`` holds the numbers of ``have`` letters: 1, 2, 4, ...
        if q & have:
            out |= some[q - done - have :][:n] << kind(2 * done)
            done += have
        if 2 * have > q:
            return out
        some = some[:-have] << kind(2 * have) | some[have:]
        have *= 2


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.encode().upper().replace(b"U", b"T") for t in b.column(1).to_pylist()]
        c = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
        z = pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), c, pa.array([len(t) for t in texts], pa.int32()), b.column(2), z], names=["key", "c", "n", "held_out", "z"])


def split_rows(df: DataFrame, key: str, text: str, split: str, held_out: tuple[str, ...], training: str) -> DataFrame:
    """key, c (128-bit name of the class of equal strings), n bytes, held_out, z (the compressed string, upper case, U as T).

    Rows in no split or without text are left out.
    """
    side = F.lower(F.trim(F.col(split)))
    rows = df.filter(side.isin(*held_out, training) & (F.length(text) > 0) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("s"), side.isin(*held_out).alias("held_out"))
    return rows.mapInArrow(_packed, f"key {df.schema[key].dataType.simpleString()}, c binary, n int, held_out boolean, z binary")


def cross_split_pairs(df: DataFrame, key: str = "rec_id", text: str = "seq", split: str = "mode", held_out: tuple[str, ...] = ("test", "val"), training: str = "train") -> DataFrame:
    """Pairs (key_a < key_b) of a held-out and a training record, one of which holds the other almost.

    Letter case is ignored, U is T, either record may be reverse-complemented; N is a letter like the
    others.  The shorter string is at least half as long as the longer and matches a stretch of it with
    at most a tenth of its letters edited.  Split names are read without regard to case and outer
    spaces; null and other splits, null and empty strings, and null keys are in no pair.  Repeated rows
    count once; an empty table gives no rows; other columns aren't read.  No pair is missed, at a cost
    that grows as the product of both sides' letters (see ``blocks``).
    """
    rows = write_once(split_rows(df, key, text, split, held_out, training))
    members = write_once(rows.select("c", "key", "held_out").distinct())
    links = all_links(rows)
    first = members.filter("held_out").select(F.col("c").alias("a"), F.col("key").alias("ka"))
    second = members.filter("not held_out").select(F.col("c").alias("b"), F.col("key").alias("kb"))
    equal = first.select("a").distinct().join(second.select(F.col("b").alias("a")).distinct(), "a").select("a", F.col("a").alias("b"))
    pairs = links.unionByName(equal).join(first, "a").join(second, "b").filter("ka <> kb")
    return pairs.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()


def report(df: DataFrame, pairs: DataFrame, key: str = "rec_id", split: str = "mode", source: str = "genome_id") -> DataFrame:
    """Of each split and source: held-out records with a pair in training, and their pairs."""
    side = F.lower(F.trim(F.col(split)))
    of = df.filter(side.isin("test", "val")).groupBy(F.col(key).alias("k")).agg(F.min(side).alias(split), F.min(source).alias(source))
    ends = pairs.select(F.explode(F.array(f"{key}_a", f"{key}_b")).alias("k"))
    return ends.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(of, "k").groupBy(split, source).agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("pairs"))
