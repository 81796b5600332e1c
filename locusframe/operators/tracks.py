"""Score tracks: scoring in overlapping tiles, prefix sums, run-length segments.

A track table has one row for each contig, strand and tile: tile_start, length (of the contig), letters (of
the tile) and p, the scores of the seven classes as arrays over the tile's positions.  Positions never become
rows; only what is found in them does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from locusframe import schema as S
from locusframe.session import workers, write_once

#: Positions scored at once and the context on both sides together that a scorer may look at.
TILE, CONTEXT = 100_000, 800
#: Letters of an Arrow batch of tiles, and rows of one of segments.
BATCH, RUNS = 4_000_000, 200_000

Scorer = Callable[[str], np.ndarray]
#: contig_id, strand, tile_start, length of the contig, letters and score matrix of the tile.
Tile = tuple[object, int, int, int, str, np.ndarray]
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


def _cut(b: pa.RecordBatch, tile: int, half: int, strands: tuple[int, ...]) -> Iterator[tuple]:
    for contig, seq in zip(b.column(0).to_pylist(), b.column(1)):
        own = (seq.as_py() or "").encode()
        for strand in strands:
            turned = own if strand == 1 else own.translate(_COMPLEMENT)[::-1]
            for start in range(0, len(own), tile):
                first, size = max(0, start - half), min(tile, len(own) - start)
                yield contig, strand, start, len(own), start - first, size, turned[first : start + size + half]


def _scored_piece(score: Scorer, piece: str, left: int, size: int, context: int) -> tuple[str, np.ndarray]:
    padding = "N" * (context // 2)
    whole = np.asarray(score(padding + piece + padding), np.float32)
    if whole.shape != (7, len(piece)):
        raise ValueError(f"a scorer gave {whole.shape} for 7 classes of {len(piece)} letters with a context of {context}")
    return piece[left : left + size], whole[:, left : left + size]


def contig_tiles(make_scorer: Callable[[], Scorer], tile: int = TILE, context: int = CONTEXT, strands: tuple[int, ...] = (1, -1)) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Tile]]:
    """What makes scored tiles of batches (contig_id, seq), those of one strand of a contig in a row, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
        score = make_scorer()
        for b in batches:
            for contig, strand, start, length, left, size, piece in _cut(b, tile, context // 2, strands):
                yield contig, strand, start, length, *_scored_piece(score, piece.decode(), left, size, context)

    return run


def sequence_tiles(contigs: DataFrame, tile: int = TILE, context: int = CONTEXT) -> DataFrame:
    """contig_id, strand, tile_start, length, left (letters of context before the tile), size, piece.

    The reverse strand is tiled in its own direction.  A long contig becomes many rows in one pass over its
    letters, so none is scored by one task; empty and null sequences give no tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for row in _cut(b, tile, context // 2, (1, -1)):
                rows.append(row)
                held += row[5]
                if held >= BATCH:
                    yield batch(rows, b)
                    rows, held = [], 0
            if rows:
                yield batch(rows, b)

    def batch(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [like.schema.field(0).type, pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["contig_id", "strand", "tile_start", "length", "left", "size", "piece"])

    kind = contigs.schema["contig_id"].dataType.simpleString()
    return contigs.select("contig_id", "seq").mapInArrow(run, f"contig_id {kind}, strand tinyint, tile_start bigint, length bigint, left int, size int, piece string")


def scored(tiles: DataFrame, make_scorer: Callable[[], Scorer], context: int = CONTEXT) -> DataFrame:
    """Scores of every tile: contig_id, strand, tile_start, length, letters, p (array of seven float arrays).

    ``make_scorer`` is called once a task and gives a function from letters (with half the ``context`` of N
    on either side) to a matrix [7, letters without the context]; any other shape is a ValueError.  A model
    file is loaded there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make_scorer()
        for b in batches:
            letters, flat, sizes = [], [], []
            for left, size, piece in zip(b.column("left").to_pylist(), b.column("size").to_pylist(), b.column("piece").to_pylist()):
                own, p = _scored_piece(score, piece, left, size, context)
                letters.append(own)
                flat.append(np.ascontiguousarray(p).ravel())
                sizes += [size] * 7
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.float32)))
            p = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) + 1, 7), pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("contig_id", "strand", "tile_start", "length")), pa.array(letters, pa.string()), p], names=["contig_id", "strand", "tile_start", "length", "letters", "p"])

    kind = tiles.schema["contig_id"].dataType.simpleString()
    return tiles.mapInArrow(run, f"contig_id {kind}, strand tinyint, tile_start bigint, length bigint, letters string, p array<array<float>>")


def signed_values(a: np.ndarray, b: np.ndarray, least: float, digits: int = 2) -> np.ndarray:
    """``a`` where it is the greater one, else -``b``; rounded, and zero below ``least`` in size."""
    v = np.round(np.where(a > b, a, -b).astype(np.float64), digits)
    return np.where(np.abs(v) >= least, v, 0.0)


def _tile_runs(p: list[np.ndarray] | np.ndarray, i: int, j: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and value of the runs of equal signed values inside a tile, without zero runs."""
    v = signed_values(p[i], p[j], least)
    if not len(v):
        return np.empty(0, np.int64), np.empty(0, np.int64), v
    start = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
    end = np.concatenate([start[1:], [len(v)]])
    keep = np.flatnonzero(v[start] != 0)
    return start[keep], end[keep], v[start[keep]]


def _run_batch(out: list[tuple], contig: pa.DataType, names: list[str]) -> pa.RecordBatch:
    at = pa.array(np.repeat(np.arange(len(out)), [len(o[2]) for o in out]))
    named = [pa.array([o[0] for o in out], pa.string()).take(at), pa.array([o[1] for o in out], contig).take(at)]
    return pa.RecordBatch.from_arrays([*named, *(pa.array(np.concatenate([o[k] for o in out])) for k in range(2, len(names)))], names=names)


def segments(tracks: DataFrame, pairs: dict[str, tuple[int, int, float]]) -> DataFrame:
    """track, contig_id, seg_start, seg_end, value: runs of equal signed values in forward coordinates; zero runs are left out.

    ``pairs``: by name the two classes (from 0) and the least size of a value; ``track`` is the name and + or -.
    Runs are found inside the tiles in one pass; only those at a tile's border meet in a window of their
    contig (at most two for each tile and track) and are put together there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for contig, strand, first, length, p in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                rows = [np.asarray(x.values) for x in p.values]
                for name, (i, j, least) in pairs.items():
                    start, end, value = _tile_runs(rows, i, j, least)
                    border = (start == 0) | (end == len(rows[i]))
                    low, high = (first + start, first + end) if strand == 1 else (length - first - end, length - first - start)
                    out.append((f"{name}{'+' if strand == 1 else '-'}", contig, low, high, value, border))
            if out:
                yield _run_batch(out, b.schema.field(0).type, ["track", "contig_id", "seg_start", "seg_end", "value", "border"])

    kind = tracks.schema["contig_id"].dataType.simpleString()
    runs = write_once(tracks.select("contig_id", "strand", "tile_start", "length", "p").mapInArrow(run, f"track string, contig_id {kind}, seg_start bigint, seg_end bigint, value double, border boolean"))
    line = Window.partitionBy("track", "contig_id").orderBy("seg_start")
    ends = runs.filter("border").withColumn("_new", F.coalesce((F.lag("seg_end").over(line) != F.col("seg_start")) | (F.lag("value").over(line) != F.col("value")), F.lit(True)).cast("int"))
    joined = ends.withColumn("_g", F.sum("_new").over(line)).groupBy("track", "contig_id", "_g").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.first("value").alias("value"))
    return runs.filter("not border").drop("border").unionByName(joined.drop("_g"))


def joined_runs(tiles: Iterator[Tile], pairs: dict[str, tuple[int, int, float]]) -> Iterator[tuple]:
    """Track, contig and the starts, ends and values of whole runs, tile by tile.

    The tiles of one strand of a contig must follow each other; a run that reaches a tile's end is kept back
    for the next one.
    """
    at: tuple = ()
    for contig, strand, first, length, _, p in tiles:
        size = p.shape[1]
        if first and at != (contig, strand, first):
            raise ValueError(f"the tile at {first} of {contig} doesn't follow the one before it")
        if not first:
            held: dict[str, tuple[int, float]] = {}
        at = (contig, strand, first + size)
        for name, (i, j, least) in pairs.items():
            start, end, value = _tile_runs(p, i, j, least)
            start, end = start + first, end + first
            if before := held.pop(name, None):
                if len(start) and start[0] == first and value[0] == before[1]:
                    start[0] = before[0]
                else:
                    start, end, value = np.concatenate([[before[0]], start]), np.concatenate([[first], end]), np.concatenate([[before[1]], value])
            if len(end) and end[-1] == first + size < length:
                held[name] = (int(start[-1]), float(value[-1]))
                start, end, value = start[:-1], end[:-1], value[:-1]
            low, high = (start, end) if strand == 1 else (length - end, length - start)
            yield f"{name}{'+' if strand == 1 else '-'}", contig, low, high, value


def joined_segments(rows: DataFrame, tiles: Callable[[Iterator[pa.RecordBatch]], Iterator[Tile]], pairs: dict[str, tuple[int, int, float]]) -> DataFrame:
    """The rows of ``segments`` for tiles that ``tiles`` makes of the batches of ``rows`` (contig_id, ...).

    Scores become runs in the process that makes them: neither a batch of score matrices nor a table of
    unjoined runs comes to be.  Rows are shuffled before, so that all tasks get some.
    """
    spark = rows.sparkSession
    rows = rows.repartition(max(4 * workers(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), "contig_id")

    names, contig = ["track", "contig_id", "seg_start", "seg_end", "value"], to_arrow_type(rows.schema["contig_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for found in joined_runs(tiles(batches), pairs):
            out.append(found)
            held += len(found[2])
            if held >= RUNS:
                yield _run_batch(out, contig, names)
                out, held = [], 0
        if out:
            yield _run_batch(out, contig, names)

    kind = rows.schema["contig_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"track string, contig_id {kind}, seg_start bigint, seg_end bigint, value double")


class Prefix:
    """Sums over stretches of a score matrix in constant time."""

    def __init__(self, p: np.ndarray):
        self.p = p
        self.gap = np.concatenate([[0.0], np.cumsum(p[5].astype(np.float64) - p[6].astype(np.float64))])

    def exon_minus_intron(self, start: int, end: int) -> float:
        return float(self.gap[end] - self.gap[start])


def call_score(prefix: Prefix, call: list[tuple[int, int]]) -> float:
    """Score of a structure of (position, type) events: agreement of its stretches and confidence of its borders.

    Agreement is the mean, over the bases strictly between neighbouring events, of the exon score above
    the intron score (or the reverse in introns), at least 0.  Confidence is the mean of the first and last
    event's scores, averaged with the mean of the inner events if there are any.
    """
    agree, bases = 0.0, 0
    for (a, _), (b, kind) in zip(call, call[1:]):
        gain = prefix.exon_minus_intron(a + 1, b) if b > a else 0.0
        agree += gain if kind in (S.CDS_END, S.EXON_END) else -gain
        bases += b - a - 1
    at = [float(prefix.p[S.EVENT_CLASS[kind]][pos]) for pos, kind in call]
    border = (at[0] + at[-1]) / 2
    if len(call) > 2:
        border = (sum(at[1:-1]) / (len(call) - 2) + border) / 2
    return ((max(0.0, agree / bases) if bases else 0.0) + border) / 2
