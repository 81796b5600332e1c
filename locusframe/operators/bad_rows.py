"""Annotation lines that can't be read, with the reason; the others as typed rows.

Blocks of lines go through a columnar parser; a block that it refuses is halved until single lines are
refused.  What it parsed is checked column by column, and the rows that fail are isolated by halving
too.  Only isolated lines are diagnosed strictly, character by character.  The columnar checks pass no
faulty line; a sound line that they refuse is accepted by the diagnosis.  Block sizes follow the share
of refused lines met so far, so that about every second block is parsed at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns, feature types, strands and phases of an annotation line.
COLUMNS = ["seqid", "source", "feature_type", "start", "end", "score", "strand", "phase", "attributes"]
FEATURE_TYPES = ["region", "gene", "mRNA", "exon", "CDS"]
STRANDS = ["+", "-", ".", "?"]
PHASES = [".", "0", "1", "2"]

SMALL, LARGE = 8, 4096
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
DIGITS = re.compile(r"[0-9]+")

# The checks of the columnar path, as one pattern for each column (RE2).
FAST_POSITION = r"^[0-9]{1,18}$"
FAST_SCORE = r"^(?:\.|[+-]?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]{1,2})?)$"
_VALUE = r'(?:"(?:[^"]|"")+"|[^",; =][^",;]*)'
_ENTRY = rf"[A-Za-z_]+(?: *= *| +){_VALUE} *(?:, *{_VALUE} *)*"
FAST_ATTRIBUTES = rf"^{_ENTRY}(?:; *{_ENTRY})*(?:; *)?$"

ROW = "line_id bigint, reason string, seqid string, source string, feature_type string, `start` bigint, `end` bigint, score double, strand string, phase int, attributes string"


def attribute_fault(text: str) -> str | None:
    """``quoting``, ``attributes`` or None for one attribute column.

    States: before a tag, in it, before a value, in a plain one, in quotes, after quotes.
    """
    state, tag, values, fault, entries, empty = "entry", "", 0, False, 0, False
    i, n = 0, len(text)

    def close() -> None:
        nonlocal entries, empty, fault, tag, values
        if not tag and state == "entry":
            fault |= empty  # an empty entry that wasn't the last one
            empty = True
        else:
            fault |= empty
            empty = False
            entries += 1
            fault |= values == 0 or not re.fullmatch("[A-Za-z_]+", tag)
        tag, values = "", 0

    while i < n:
        c = text[i]
        if state == "quoted":
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    state = "after"
        elif c == ";":
            close()
            state = "entry"
        elif c == '"':
            if state in ("entry", "value"):
                if state == "value":
                    values += text[i + 1 : i + 2] != '"' or text[i + 2 : i + 3] == '"'
                else:
                    tag = '"'
                state = "quoted"
            else:
                return "quoting"
        elif state == "after":
            if c == ",":
                state = "value"
            elif c != " ":
                return "quoting"
        elif state == "entry":
            if c != " ":
                state, tag = ("value", "=") if c == "=" else ("tag", c)
        elif state == "tag":
            if c == "=":
                state = "value"
            elif c == " ":
                rest = text[i:].lstrip(" ")
                i = n - len(rest) - (rest[:1] != "=")
                state = "value"
            else:
                tag += c
        elif state == "value":
            if c not in " ,":
                state = "plain"
                values += 1
        elif c == ",":
            state = "value"
        i += 1
    if state == "quoted":
        return "quoting"
    last_empty = state == "entry" and not tag
    if not last_empty:
        close()
    else:
        fault |= empty
    return "attributes" if fault or not entries else None


def fault(line: str) -> str | None:
    """Why a data line (without its line end) can't be read; None if it can."""
    f = line.split("\t")
    if len(f) != len(COLUMNS):
        return "columns"
    inside = attribute_fault(f[8])
    if inside == "quoting":
        return inside
    sound = (
        f[2] in FEATURE_TYPES
        and DIGITS.fullmatch(f[3])
        and DIGITS.fullmatch(f[4])
        and 1 <= int(f[3]) <= int(f[4])
        and (f[5] == "." or NUMBER.fullmatch(f[5]) and math.isfinite(float(f[5])))
        and f[6] in STRANDS
        and f[7] in (PHASES[1:] if f[2] == "CDS" else PHASES)
    )
    return inside if sound else "value"


class Refused(Exception):
    """A block that the columnar parser doesn't accept as a whole."""


def bulk_parse(lines: pa.Array) -> pa.Array:
    """The fields of all lines one after the other, or ``Refused`` if a line hasn't as many as it should."""
    if not pc.all(pc.equal(pc.count_substring(lines, "\t"), len(COLUMNS) - 1)).as_py():
        raise Refused
    return pc.split_pattern(lines, "\t").flatten()


def in_columns(fields: pa.Array) -> pa.Table:
    n = len(COLUMNS)
    return pa.table([fields.take(pa.array(np.arange(i, len(fields), n))) for i in range(n)], names=COLUMNS)


def typed(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The columns with their types, null where they don't fit, and which rows pass all checks."""
    kind, phase, one = t["feature_type"], t["phase"], pa.scalar(1, pa.int64())
    null = pa.scalar(None, pa.string())
    ok = pc.is_in(kind, pa.array(FEATURE_TYPES))
    for mask in (
        pc.match_substring_regex(t["score"], FAST_SCORE),
        pc.is_in(t["strand"], pa.array(STRANDS)),
        pc.is_in(phase, pa.array(PHASES)),
        pc.or_(pc.not_equal(kind, "CDS"), pc.not_equal(phase, ".")),
        pc.match_substring_regex(t["attributes"], FAST_ATTRIBUTES),
    ):
        ok = pc.and_(ok, mask)
    number = lambda c, pattern, to: pc.if_else(pc.match_substring_regex(c, pattern), c, null).cast(to)
    start, end = (number(t[c], FAST_POSITION, pa.int64()) for c in ("start", "end"))
    ok = pc.and_(ok, pc.fill_null(pc.and_(pc.greater_equal(start, one), pc.greater_equal(end, start)), False))
    score = pc.if_else(pc.equal(t["score"], "."), null, t["score"])
    values = {"start": start, "end": end, "score": number(score, FAST_SCORE, pa.float64()), "phase": number(phase, "^[0-9]$", pa.int32())}
    for name, column in values.items():
        t = t.set_column(COLUMNS.index(name), name, column)
    return t, ok.to_numpy().astype(bool)


def strict_row(line: str) -> pa.Table:
    """One sound line as a typed row."""
    f = line.split("\t")
    whole = [int(x) if int(x) < 1 << 63 else None for x in f[3:5]]
    values = [*f[:3], *whole, None if f[5] == "." else float(f[5]), f[6], None if f[7] == "." else int(f[7]), f[8]]
    kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.float64(), pa.string(), pa.int32(), pa.string()]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=COLUMNS)


def isolate(failures: np.ndarray, lo: int, hi: int, out: list[int]) -> None:
    """Rows of [lo, hi) that fail, by halving; ``failures`` are the failing rows before each row."""
    if failures[lo] == failures[hi]:
        return
    if hi - lo == 1:
        out.append(lo)
        return
    half = (lo + hi) // 2
    isolate(failures, lo, half, out)
    isolate(failures, half, hi, out)


class Loader:
    """Parses lines in blocks of a size that follows the share of lines with wrong columns."""

    def __init__(self):
        self.seen, self.refused = 1.0, 0.0

    def block_size(self) -> int:
        return max(SMALL, min(LARGE, int(0.7 * self.seen / max(self.refused, 1e-9))))

    def bisect(self, lines: pa.Array, at: int, parsed: list, single: list) -> None:
        """Fields of parsed blocks with the place of their first line, and the places of the lines that no block with them parses."""
        try:
            parsed.append((at, bulk_parse(lines)))
        except Refused:
            if len(lines) == 1:
                single.append(at)
                return
            half = len(lines) // 2
            self.bisect(lines[:half], at, parsed, single)
            self.bisect(lines[half:], at + half, parsed, single)

    def load(self, lines: list[str]) -> tuple[list, list]:
        """Typed rows (places, table) and faults (place, reason) of all lines."""
        parsed, single, i = [], [], 0
        whole = pa.array(lines, pa.string())
        while i < len(lines):
            block, before = whole[i : i + self.block_size()], len(single)
            self.bisect(block, i, parsed, single)
            self.seen, self.refused = 0.99 * self.seen + len(block), 0.99 * self.refused + len(single) - before
            i += len(block)
        good, doubtful = [], list(single)
        if parsed:
            table, passes = typed(in_columns(pa.concat_arrays([f for _, f in parsed])))
            place = np.concatenate([np.arange(at, at + len(f) // len(COLUMNS)) for at, f in parsed])
            rows: list[int] = []
            isolate(np.concatenate([[0], np.cumsum(~passes)]), 0, len(passes), rows)
            doubtful += place[rows].tolist()
            good.append((place[passes].tolist(), table.filter(pa.array(passes))))
        bad = []
        for at in doubtful:
            why = fault(lines[at])
            if why:
                bad.append((at, why))
            else:
                good.append(([at], strict_row(lines[at])))
        return good, bad


def data_line(line: str | None) -> str | None:
    """The line without its end, None if it is no data line."""
    if line is None or line.startswith("#"):
        return None
    line = line.rstrip("\r\n")
    return line if line.strip() else None


def _run(bad_only: bool):
    kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.float64(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loader = Loader()
        for b in batches:
            kept = [(i, d) for i, x in enumerate(b.column(1).to_pylist()) if (d := data_line(x)) is not None]
            place = [i for i, _ in kept]
            good, bad = loader.load([d for _, d in kept])
            ids = b.column(0).take(pa.array([place[k] for k, _ in bad], pa.int64()))
            reasons = pa.array([r for _, r in bad], pa.string())
            if bad_only:
                yield pa.RecordBatch.from_arrays([ids, reasons], names=["line_id", "reason"])
                continue
            yield pa.RecordBatch.from_arrays([ids, reasons, *(pa.nulls(len(ids), k) for k in kinds)], names=["line_id", "reason", *COLUMNS])
            for at, t in good:
                ids = b.column(0).take(pa.array([place[k] for k in at], pa.int64()))
                cols = [pa.concat_arrays(t[c].chunks) if t.num_rows else pa.nulls(0, k) for c, k in zip(COLUMNS, kinds)]
                yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.string()), *cols], names=["line_id", "reason", *COLUMNS])

    return run


def faulty_lines(df: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """line_id and reason (``columns``, ``quoting``, ``value``, ``attributes``: the first that holds).

    Null lines, blank lines and lines that begin with # are no data and give no row.  Every data line
    is either here or in ``load_rows``.  A line repeated under its own key is reported for each key;
    a key repeated with the same line counts once.  An empty table gives no rows.
    """
    return df.select(F.col(key).cast("bigint").alias("line_id"), F.col(line).cast("string").alias("line")).mapInArrow(_run(True), "line_id bigint, reason string").distinct()


def load_rows(df: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """The sound lines as typed rows; ``.`` as score or phase becomes null. Else as ``faulty_lines``.

    A start or end beyond 64 bits is sound but can't be held and becomes null.
    """
    read = df.select(F.col(key).cast("bigint").alias("line_id"), F.col(line).cast("string").alias("line")).distinct()
    return read.mapInArrow(_run(False), ROW).filter("reason is null").drop("reason")
