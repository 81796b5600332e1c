"""Training data from annotated sequences: exon algebra, CDS repair, windows, labels, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe import schema as S
from locusframe.functions import seq as Q
from locusframe.operators.intervals import carried, range_tiles


def introns(exons: Column) -> Column:
    """Between neighbouring exons in genome order: from the end of one to the start of the next."""
    return F.when(F.size(exons) > 1, F.zip_with(F.slice(exons, 1, F.size(exons) - 1), F.slice(exons, 2, F.size(exons) - 1), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))).otherwise(
        F.array().cast(f"array<{S.EXON}>")
    )


def cds_length(exons: Column) -> Column:
    """Bases of inclusive exons."""
    return F.aggregate(exons, F.lit(0).cast("bigint"), lambda n, e: n + e["end"] + 1 - e["start"])


def phases(exons: Column, strand: Column) -> Column:
    """Reading phase of each inclusive exon in transcript order: bases to the next codon."""
    walk = F.when(strand == "-", F.reverse(exons)).otherwise(exons)
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        walk,
        zero,
        lambda a, e: F.struct((a["sum"] + e["end"] + 1 - e["start"]).alias("sum"), F.concat(a["out"], F.array(((3 - a["sum"] % 3) % 3).cast("int"))).alias("out")),
        lambda a: a["out"],
    )


def part_of(number: Column, every: int = 5) -> Column:
    """Every fifth record is a test record."""
    return F.when(F.pmod(number, F.lit(every)) == 0, "test").otherwise("train")


def extend_stops(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """CDS whose only fault is a missing stop get the stop that follows, if enough faults are of that kind.

    ``rows``: rec_id, strand, seq, seq_start, exons.  Adds reason and extended and moves the last exon
    end (+) or the first exon start (-) by three bases.  ``threshold`` is the share of
    ``no_terminal_stop`` among all faults from which on this is done; each record keeps its own
    reason otherwise.
    """
    cds = Q.spliced("seq", "seq_start", F.col("exons"), "strand")
    judged = rows.withColumn("reason", Q.cds_reason(cds)).withColumn("_after", Q.downstream_triplet("seq", "seq_start", F.col("exons"), "strand"))
    if threshold > 0:
        share = judged.agg(F.try_divide(F.count_if(F.col("reason") == "no_terminal_stop"), F.count_if(F.col("reason") != "valid"))).first()[0]
        go = F.lit(bool(share is not None and share >= threshold))
    else:
        go = F.lit(True)
    judged = judged.withColumn("extended", go & (F.col("reason") == "no_terminal_stop") & F.coalesce(F.col("_after").isin(S.STOP_CODONS), F.lit(False)))
    n = F.size("exons")
    moved = F.transform(
        "exons",
        lambda e, i: F.struct(
            F.when((F.col("strand") == "-") & (i == 0), e["start"] - 3).otherwise(e["start"]).alias("start"),
            F.when((F.col("strand") != "-") & (i == n - 1), e["end"] + 3).otherwise(e["end"]).alias("end"),
        ),
    )
    return judged.withColumn("exons", F.when(F.col("extended"), moved).otherwise(F.col("exons"))).withColumn("reason", F.when(F.col("extended"), "valid").otherwise(F.col("reason"))).drop("_after")


def window_tiles(rows: DataFrame, block: int, context: int, compat: bool = False) -> DataFrame:
    """Windows of ``block`` labelled bases with half the context on either side: tile_no, tile_start, window.

    ``rows`` have rec_id, seq, seq_start, cds_start, cds_end.  What lies outside the sequence is N, or T
    with ``compat`` (a published encoder reads its padding as the last base).
    """
    half, pad = context // 2, "T" if compat else "N"
    width = block + 2 * half
    first = F.col("cds_start") - F.col("seq_start")
    n = F.col("cds_end") - F.col("cds_start") + 1
    tiles = rows.select("rec_id", F.upper("seq").alias("u"), first.alias("t0"), F.explode(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1)).alias("tile_no"))
    a = F.col("t0") + F.col("tile_no").cast("bigint") * block - half
    b = a + width
    size = F.length("u")
    left, right = F.greatest(F.lit(0), -a), F.greatest(F.lit(0), b - size)
    inside = F.col("u").substr(F.greatest(a, F.lit(0)).cast("int") + 1, F.greatest(F.lit(0), F.least(b, size) - F.greatest(a, F.lit(0))).cast("int"))
    fill = lambda k: F.repeat(F.lit(pad), F.least(F.lit(width), k).cast("int"))
    return tiles.select("rec_id", "tile_no", (F.col("tile_no").cast("bigint") * block).alias("tile_start"), F.concat(fill(left), inside, fill(right)).alias("window"))


def datapoints(rows: DataFrame, block: int, context: int, compat: bool = False) -> DataFrame:
    """rec_id, tile_no, x (base codes of a window in sense direction) and y (label codes of its block).

    Codes stand for one-hot rows (``functions.seq.one_hot``): a base code of 4 and a label code of 7 are
    rows of zeros; 7 fills the last block.  ``rows`` have rec_id, seq, seq_start, strand, cds_start, cds_end
    and exons in genome order.
    """
    minus = F.col("strand") == "-"
    behind = F.col("seq_start") + F.length("seq") - 1
    sense = rows.withColumn("_lead", F.when(minus, behind - F.col("cds_end")).otherwise(F.col("cds_start") - F.col("seq_start")))
    sense = sense.withColumn("seq", F.when(minus, Q.reverse_complement(F.upper("seq"))).otherwise(F.upper("seq"))).withColumn("seq_start", F.col("cds_start") - F.col("_lead"))
    tiles = window_tiles(sense, block, context, compat)
    labelled = tiles.join(label_raster(rows, "rec_id"), "rec_id")
    own = F.rpad(F.col("labels").substr(F.col("tile_start").cast("int") + 1, F.lit(block)), block, "7")
    return labelled.select("rec_id", "tile_no", Q.base_codes("window").alias("x"), F.transform(F.split(own, ""), lambda c: c.cast("tinyint")).alias("y"))


def raster(first: int, last: int, strand: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Label of every base from ``first`` to ``last`` in sense direction; see ``label_raster``."""
    n = last - first + 1
    change = np.zeros(n + 1, np.int64)

    def covered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.zeros(n + 1, np.int64)
        np.add.at(d, np.clip(a - first, 0, n), 1)
        np.add.at(d, np.clip(np.maximum(a, b) - first, 0, n), -1)
        return np.cumsum(d)[:n] > 0

    out = np.where(covered(starts, ends), 5, change[:n])
    out[covered(ends[:-1], starts[1:])] = 6
    donor, acceptor, begin, finish = (1, 2, 4, 3) if strand == "-" else (2, 1, 3, 4)
    for points, label in ((ends, donor), (starts, acceptor), (starts[:1], begin), (ends[-1:], finish)):
        at = points - first
        out[at[(at >= 0) & (at < n)]] = label
    return out[::-1] if strand == "-" else out


def label_raster(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and a string of label digits over the bases from cds_start to cds_end, in sense direction.

    0 none, 1 exon start, 2 exon end, 3 CDS start, 4 CDS end, 5 exon, 6 intron; junctions win over
    stretches and CDS ends over junctions.  ``rows`` hold strand, cds_start, cds_end and the exons in
    genome order; a null bound or no exon gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, ends = b.column("_s"), b.column("_e")
            out = []
            for i, (strand, first, last) in enumerate(zip(b.column("strand").to_pylist(), b.column("cds_start").to_pylist(), b.column("cds_end").to_pylist())):
                s, e = (np.array(c[i].as_py(), np.int64) for c in (starts, ends))
                out.append((raster(first, last, strand, s, e) + 48).astype(np.uint8).tobytes().decode())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.string())], names=[key, "labels"])

    ready = rows.filter((F.size("exons") > 0) & (F.col("cds_start") <= F.col("cds_end"))).select(
        key, "strand", F.col("cds_start").cast("bigint").alias("cds_start"), F.col("cds_end").cast("bigint").alias("cds_end"), F.col("exons.start").alias("_s"), F.col("exons.end").alias("_e")
    )
    return ready.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, labels string")


def seeded(key: str, seed: int) -> Column:
    """A value whose order is a permutation of the keys: the same for one seed, another for each."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sampled(df: DataFrame, key: str, group: str, per_group: int, seed: int = 0, total: int | None = None) -> DataFrame:
    """At most ``per_group`` rows of each group, and ``total`` of all, by a seeded hash order.

    The order (of md5 sums of seed and key) is the same however rows are laid out; it isn't that of any
    other program's generator.
    """
    order = seeded(key, seed)
    ranked = df.withColumn("_h", order).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h", key)))
    kept = ranked.filter(F.col("_r") <= per_group).drop("_r")
    if total is not None:
        kept = kept.orderBy("_h", key).limit(total)
    return kept.drop("_h")


def in_chunks(df: DataFrame, key: str, per_chunk: int = 100, seed: int = 0, held_out: float = 0.1) -> DataFrame:
    """``chunk`` (about ``per_chunk`` keys each, by a seeded hash) and ``use``: ``valid`` for that share of the chunks, else ``train``.

    All rows of a key come into one chunk.  The keys are counted once; nothing is sorted.
    """
    keys = df.agg(F.count_distinct(key)).first()[0]
    chunks = max(1, -(-keys // per_chunk))
    digits = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint")
    spread = df.withColumn("chunk", (digits(seeded(key, seed)) % chunks).cast("int"))
    order = F.concat(F.lit(f"{seed}/"), F.col("chunk").cast("string"))
    return spread.withColumn("use", F.when(digits(F.md5(order)) / float(1 << 32) < held_out, "valid").otherwise("train"))


def epoch_order(df: DataFrame, chunk: str, key: list[str], epoch: int, pool: int = 4) -> DataFrame:
    """``pool_no`` and ``place``: the rows of an epoch, chunks permuted and taken ``pool`` at a time, rows permuted inside each pool.

    Both permutations change with ``epoch`` and are the same on every layout.  A pool is what is read and
    shuffled together, so it bounds a task.
    """
    chunks = df.select(chunk).distinct().withColumn("_order", seeded(chunk, epoch))
    order = ["_order", chunk]
    turns = carried(range_tiles(chunks, order), [], order, F.lit(1).cast("bigint"), "_turn", "sum")
    pools = turns.select(chunk, F.floor(F.col("_turn") / pool).cast("int").alias("pool_no"))
    mixed = F.md5(F.concat_ws(":", F.lit(str(epoch)), *[F.col(k).cast("string") for k in key]))
    place = F.row_number().over(Window.partitionBy("pool_no").orderBy(mixed, *key)) - 1
    return df.join(pools, chunk).withColumn("place", place)
