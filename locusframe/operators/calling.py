"""From boundary events to scored gene structures: regions, bounded search, selection.

The search itself is a bounded walk over the events of one region; it works on prefix sums of the
scores and on the next stop codon of every position, never on growing strings.  Everything after it
is DataFrame operators: overlap groups, margins, anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from locusframe import schema as S
from locusframe.operators import intervals as I
from locusframe.operators import training
from locusframe.operators.grouped import map_groups
from locusframe.operators.isoforms import choose
from locusframe.operators.tracks import Prefix, Tile, call_score
from locusframe.params import Params
from locusframe.session import workers, write_once

# Limits of the region scan.
STRONG_NONE, NONE_RUN, GOOD, LEAD, GOOD_SHARE, SILENT = 0.8, 20, 0.2, 300, 0.7, 200
# The event filter of a region, and the margins of selection.
PERCENTILE, CEILING, FLOOR, CAP = 0.6, 0.1, 15, 60
LOOSE, STRICT, LEAST_SCORE = 0.4, 0.2, 0.01


class Regions:
    """Where the scan from a CDS start stops: after 20 strong intergenic bases in a row, or on a weak base
    more than 300 bases on when less than 0.7 of the bases were good or none of the last 200 was."""

    def __init__(self, p: np.ndarray):
        none = p[0] > STRONG_NONE
        n = p.shape[1]
        at = np.arange(n)
        run = at - np.maximum.accumulate(np.where(~none, at, -1))
        self.deserts = np.flatnonzero(run >= NONE_RUN)
        good = (p[5] > GOOD) | (p[6] > GOOD)
        self.weak = np.flatnonzero(~good)
        self.good_before = np.concatenate([[0], np.cumsum(good)])
        self.last_good = np.maximum.accumulate(np.where(good, at, -1))
        self.n = n

    def stop(self, start: int) -> int:
        k = np.searchsorted(self.deserts, start + NONE_RUN - 1)
        stop = int(self.deserts[k]) if k < len(self.deserts) else self.n
        if not len(self.weak):
            return stop
        weak = self.weak[np.searchsorted(self.weak, start + LEAD, "right") : np.searchsorted(self.weak, stop)]
        far = weak - start
        poor = (self.good_before[weak] - self.good_before[start]) / np.maximum(far, 1) < GOOD_SHARE
        silent = weak - self.last_good[weak] > SILENT
        hit = np.flatnonzero(poor | silent)
        return int(weak[hit[0]]) if len(hit) else stop


def percentile(score: np.ndarray) -> float:
    """The score that PERCENTILE of the scores lie below, linear between neighbours."""
    at = PERCENTILE * (len(score) - 1)
    low = int(at)
    high, part = min(low + 1, len(score) - 1), at - low
    near = np.partition(score, (low, high))
    a, b = float(near[low]), float(near[high])
    return a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part)  # as np.percentile, to the last bit


def considered(pos: np.ndarray, kind: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indices of a region's events that are searched, in order; the first event is the CDS start."""
    keep = [np.array([0])]
    for t in (S.EXON_START, S.EXON_END, S.CDS_END):
        own = np.flatnonzero(kind[1:] == t) + 1
        if t != S.CDS_END and len(own):
            value = score[own]
            passing = np.count_nonzero(value >= min(percentile(value), CEILING))
            most = min(max(passing, FLOOR), CAP)
            if len(own) > most:  # the best, of equal ones the first
                least = np.partition(value, len(own) - most)[len(own) - most]
                near = np.flatnonzero(value >= least)
                own = own[near[np.argsort(-value[near], kind="stable")[:most]]]
        keep.append(own)
    tail = np.concatenate(keep[1:])
    place = np.repeat(np.arange(3), [len(k) for k in keep[1:]])  # equal positions in the order of the types above
    return np.concatenate([keep[0], tail[np.argsort(pos[tail] * 3 + place)]])


class Search:
    """Bounded enumeration of the valid structures over some events of a sequence."""

    def __init__(self, seq: str, prefix: Prefix, params: Params):
        self.seq, self.params = seq, params
        n = len(seq)
        # position of the next in-frame stop codon at or after each position
        self.next_stop = np.full(n + 3, 1 << 40, np.int64)
        codes = np.frombuffer(seq.encode(), np.uint8)
        t, a, g = (codes == ord(x) for x in "TAG")
        if n >= 3:
            stop = t[:-2] & (a[1:-1] & (a[2:] | g[2:]) | g[1:-1] & a[2:])
            where = np.where(stop, np.arange(n - 2), 1 << 40)
            for r in range(3):
                lane = where[r::3]
                self.next_stop[r : n - 2 : 3] = np.minimum.accumulate(lane[::-1])[::-1]
        # lists: single elements of arrays are slow to reach
        self.next_stop, self.gap = self.next_stop.tolist(), prefix.gap.tolist()

    def extend(self, bases: int, carry: str, head: str, start: int, end: int) -> tuple[int, str, str, bool, int, int]:
        """The CDS with the exon [start, end) appended: bases, open codon, first codon, whether the codon across
        the border stops, where codons inside the exon begin, and the first stop among them (or far away)."""
        fill = min(-bases % 3, end - start)
        across = carry + self.seq[start : start + fill]
        stops = len(across) == 3 and across in S.STOP_CODONS
        body = start + fill
        first = self.next_stop[body] if len(across) in (0, 3) else 1 << 40
        if len(head) < 3:
            head += self.seq[start : min(end, start + 3 - len(head))]
        total = bases + end - start
        rest = total % 3
        open_ = "" if not rest else self.seq[end - rest : end] if end - start >= rest else (carry + self.seq[start:end])[-rest:]
        return total, open_, head, stops, body, first if first + 3 <= end else 1 << 40

    def run(self, events: list[tuple[int, int]]) -> tuple[list[list[int]], int, bool]:
        """Structures as lists of event indices, operations spent, and whether a frame ran out of them.

        ``events`` are (position, type), the first a CDS start.  Every frame goes through the events after its
        last one; sizes beyond the greatest end it, as does a weak exon of more than 20 bases.
        """
        q, found, gap = self.params, [], self.gap
        marks = 0

        def frame(chosen: list[int], after: int, bases: int, carry: str, head: str) -> int:
            nonlocal marks
            ops = 0
            last_pos, last_kind = events[chosen[-1]]
            opened = last_kind in (S.CDS_START, S.EXON_START)
            for j in range(after, len(events)):
                pos, kind = events[j]
                if opened != (kind in (S.EXON_END, S.CDS_END)) or not opened and kind != S.EXON_START:
                    continue
                state = (bases, carry, head)
                if opened:
                    size = pos + 1 - last_pos
                    if size < q.min_exon_size:
                        continue
                    if size > q.max_exon_size:
                        return ops
                    if not gap[pos + 1] - gap[last_pos] > 0:
                        if size <= 20:
                            continue
                        return ops
                    if kind == S.CDS_END and (bases + size) % 3:
                        continue  # no whole number of codons
                    total, open_, first, across, body, stop = self.extend(bases, carry, head, last_pos, pos + 1)
                    starts = first in S.START_CODONS
                    if kind == S.EXON_END:
                        if total > 2 and not starts or across or stop < 1 << 40:
                            return ops
                        state = (total, open_, first)
                    else:
                        whole = body < pos + 1
                        ends = (not across and stop == pos - 2) if whole else across
                        if total % 3 == 0 and starts and ends:
                            found.append([*chosen, j])
                            if len(found) + marks >= q.gene_candidates:
                                break
                        continue
                else:
                    size = pos - last_pos - 1
                    if size < q.min_intron_size:
                        continue
                    if size > q.max_intron_size:
                        return ops
                if ops > q.frame_max_ops:
                    marks += 1
                    break
                ops += 1 + frame([*chosen, j], j + 1, *state)
            return ops

        spent = frame([0], 1, 0, "", "")
        return found, spent, marks > 0


def structures(pos: np.ndarray, kind: np.ndarray, score: np.ndarray, p: np.ndarray, seq: str, params: Params) -> Iterator[tuple[float, np.ndarray, list[float]]]:
    """Score, event indices and exon scores of all candidate structures of one strand of a contig.

    CDS starts whose regions end at the same event share a budget; once it is spent, or a search ran
    out of operations, the other starts of that region are passed over.
    """
    regions, prefix = Regions(p), Prefix(p)
    search = Search(seq, prefix, params)
    ends_there = np.concatenate([[0], np.cumsum(kind == S.CDS_END)])
    region_end, spent, skip = -1, 0, False
    for i in np.flatnonzero(kind == S.CDS_START):
        end = min(max(int(np.searchsorted(pos, regions.stop(int(pos[i])))), int(i)), len(pos) - 1)
        if end - i < 2 or ends_there[end + 1] == ends_there[i]:
            continue
        if end != region_end:
            region_end, spent, skip = end, 0, False
        elif spent > params.region_max_ops:
            skip = True
        if skip:
            continue
        own = i + considered(pos[i : end + 1], kind[i : end + 1], score[i : end + 1])
        calls, ops, ran_out = search.run(list(zip(pos[own].tolist(), kind[own].tolist())))
        spent += ops
        skip = ran_out or spent > params.frame_max_ops
        for c in sorted(calls, key=lambda c: pos[own[c[-1]]]):
            at = own[c]
            call = list(zip(pos[at].tolist(), kind[at].tolist()))
            yield call_score(prefix, call), at, [call_score(prefix, call[k : k + 2]) for k in range(0, len(call), 2)]


#: Calls of an Arrow batch.
BATCH = 5_000
CALLS = "contig_id {0}, strand tinyint, call_no bigint, first bigint, last bigint, score double, call array<struct<pos:bigint,type:tinyint,score:double>>, exon_scores array<double>"


def sorted_events(p: np.ndarray, thresholds: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, type and score of every score that reaches its type's threshold, by position and type."""
    rows = np.array([S.EVENT_CLASS[t] for t in range(4)])
    reached = np.zeros((p.shape[1], 4), bool)
    for t, least in thresholds.items():
        reached[:, t] = p[S.EVENT_CLASS[t]] >= np.float32(least)
    pos, kind = np.nonzero(reached)
    return pos, kind, p[rows[kind], pos].astype(np.float64)


def candidate_calls(tracks: DataFrame, params: Params) -> DataFrame:
    """All candidate structures with at least the least score: one row each.

    ``tracks`` are scored tiles with their letters.  The tiles of one strand of a contig meet in one task,
    sorted; a contig's length bounds what that holds.
    """
    kind = tracks.schema["contig_id"].dataType.simpleString()
    rows = tracks.repartition("contig_id", "strand").sortWithinPartitions("contig_id", "strand", "tile_start")
    rows = rows.select("contig_id", "strand", "letters", *[F.col("p")[i].alias(f"p{i}") for i in range(7)])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
        for b in batches:
            for i in range(b.num_rows):
                p = np.stack([np.asarray(b.column(3 + c)[i].values, np.float32) for c in range(7)])
                yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), 0, 0, b.column(2)[i].as_py(), p

    return rows.mapInArrow(_calls(tiles, to_arrow_type(tracks.schema["contig_id"].dataType), params), CALLS.format(kind))


def contig_calls(contigs: DataFrame, tiles: Callable[[Iterator[pa.RecordBatch]], Iterator[Tile]], params: Params) -> DataFrame:
    """``candidate_calls`` of ``contigs`` (contig_id, seq) that ``tiles`` scores in the task that searches them.

    Only sequences are shuffled, so that all tasks get some; for contigs of few tiles, each of which is scored in one task.
    """
    spark = contigs.sparkSession
    rows = contigs.select("contig_id", "seq").repartition(max(4 * workers(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), "contig_id")
    of = contigs.schema["contig_id"].dataType
    return rows.mapInArrow(_calls(tiles, to_arrow_type(of), params), CALLS.format(of.simpleString()))


def _calls(tiles: Callable[[Iterator[pa.RecordBatch]], Iterator[Tile]], contig: pa.DataType, params: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    least = LEAST_SCORE if params.dynamic_scoring else params.min_gene_score
    thresholds = params.thresholds()
    event = pa.struct([("pos", pa.int64()), ("type", pa.int8()), ("score", pa.float64())])
    kinds = [contig, pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(event), pa.list_(pa.float64())]

    def solve(now: tuple, own: list[Tile]) -> list[tuple]:
        p = np.concatenate([t[5] for t in own], axis=1) if len(own) > 1 else own[0][5]
        pos, types, score = sorted_events(p, thresholds)
        out = []
        for n, (value, at, parts) in enumerate(structures(pos, types, score, p, "".join(t[4] for t in own), params)):
            if value >= least:
                call = [{"pos": int(pos[k]), "type": int(types[k]), "score": float(score[k])} for k in at]
                out.append((*now, n, call[0]["pos"], call[-1]["pos"], value, call, parts))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for now, own in groupby(tiles(batches), key=lambda t: t[:2]):
            out += solve(now, list(own))
            if len(out) >= BATCH:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["contig_id", "strand", "call_no", "first", "last", "score", "call", "exon_scores"])

    return run


def selected_calls(calls: DataFrame, params: Params, loose: float = LOOSE, strict: float = STRICT) -> DataFrame:
    """The transcripts kept of all candidates, with their locus (group_id, from 0 on each strand of a contig).

    Overlap groups, loose margin, anchors, strict margin, then the choice of isoforms inside each locus.
    ``place`` is the order in the locus, longest CDS first.
    """
    strand = ["contig_id", "strand"]
    narrow = calls.select(*strand, "call_no", "first", "last", "score")  # structures join those that are left
    grouped = write_once(I.overlap_groups(narrow, strand, "first", "last", "call_no"))
    group = [*strand, "overlap_no"]
    loose_ones = write_once(I.within_margin(grouped, group, "score", loose))
    loci = write_once(I.anchor_loci(loose_ones, group, "first", "last", "score", "call_no"))
    locus = [*group, "locus_no"]
    final = I.within_margin(loci, locus, "score", strict).join(calls.select(*strand, "call_no", "call"), [*strand, "call_no"])
    limit = params.max_transcripts

    def keep(rows: list[dict]) -> list[tuple]:
        chosen = choose([(r["score"], [(e["pos"], e["type"], e["score"]) for e in r["call"]]) for r in rows], limit)
        return [(*(rows[i][k] for k in locus), rows[i]["call_no"], n) for n, i in enumerate(chosen)]

    schema = T.StructType([*final.select(*locus, "call_no").schema.fields, T.StructField("place", T.IntegerType())])
    chosen = map_groups(final, locus, ["first", F.desc("score"), "last", "call_no"], keep, schema)
    chosen = write_once(chosen)
    numbers = I.carried(I.range_tiles(chosen.select(*locus).distinct(), locus), strand, ["overlap_no", "locus_no"], F.lit(1).cast("bigint"), "group_id", "sum")
    kept = chosen.join(numbers.drop("_tile"), locus).drop("overlap_no", "locus_no")
    return calls.join(kept, [*strand, "call_no"])


def transcripts(selected: DataFrame, contigs: DataFrame) -> DataFrame:
    """Exons in forward coordinates from selected calls: contig_id, strand, group_id, place, start, end, score, exons.

    Exons stay in transcript order and hold start, end (half-open) and their reading phase.
    """
    lengths = contigs.select("contig_id", F.length("seq").alias("_n"))
    rows = selected.join(lengths, "contig_id")
    n = F.size("call") / 2
    pair = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(F.get("call", 2 * i)["pos"].alias("a"), (F.get("call", 2 * i + 1)["pos"] + 1).alias("b")))
    turned = F.transform(pair, lambda x: F.struct(F.when(F.col("strand") == 1, x["a"]).otherwise(F.col("_n") - x["b"]).alias("start"), F.when(F.col("strand") == 1, x["b"]).otherwise(F.col("_n") - x["a"]).alias("end")))
    rows = rows.withColumn("_x", turned)
    inclusive = F.transform("_x", lambda x: F.struct(x["start"].alias("start"), (x["end"] - 1).alias("end")))  # in transcript order
    phases = training.phases(inclusive, F.lit("+"))
    exons = F.transform(F.arrays_zip(F.col("_x").alias("x"), phases.alias("ph"), F.col("exon_scores").alias("s")), lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["s"].alias("score"), z["ph"].alias("phase")))
    return rows.withColumn("exons", exons).select("contig_id", "strand", "group_id", "call_no", "place", F.array_min("_x.start").alias("start"), F.array_max("_x.end").alias("end"), "score", "exons", training.cds_length(inclusive).alias("bases"))
