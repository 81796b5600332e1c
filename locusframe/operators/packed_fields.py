"""Fields that hold several values: one row for each value, with its position.

A finite-state tokenizer runs over all fields of an Arrow batch at once: quote parity and bracket
depth are running sums over the bytes, and delimiters count only where the parity is even.  A
doubled quote flips the parity twice and so stays inside; a backslash can be made to escape.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, BACKSLASH = 0x22, 0x5C
OPENING, CLOSING = b"([{", b")]}"


@dataclass(frozen=True)
class Syntax:
    """How a field is packed.

    ``entry`` bytes end an entry, ``value`` bytes end a value inside it; both only outside quotes.
    With ``nested`` they don't count inside brackets either.  ``escape``: a backslash takes the next
    quote's meaning away.  ``read`` makes items of (text of a value, whether it begins an entry,
    what ``read`` returned as state for the value before).
    """

    entry: bytes
    value: bytes
    read: Callable[[str, bool, object], tuple[str | None, object]]
    nested: bool = False
    escape: bool = False


def spans(data: np.ndarray, offsets: np.ndarray, syntax: Syntax) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin, end and "begins an entry" of every stretch between delimiters, in order.

    ``data`` are the bytes of all fields, ``offsets`` where each begins.  A quote that is never closed
    reaches to the end of its field.
    """
    n, lengths = len(data), np.diff(offsets)
    quote = data == QUOTE
    if syntax.escape:
        slash = data == BACKSLASH
        run = np.arange(n) - np.maximum.accumulate(np.where(~slash, np.arange(n), -1))
        quote[1:] &= run[:-1] % 2 == 0
    total = np.concatenate([[0], np.cumsum(quote)])
    row = np.repeat(np.arange(len(lengths)), lengths)
    outside = (total[:-1] - total[offsets[:-1]][row]) % 2 == 0 if n else np.empty(0, bool)
    outside &= ~quote
    if syntax.nested:
        step = (np.isin(data, list(OPENING)).astype(np.int64) - np.isin(data, list(CLOSING))) * outside
        depth = np.concatenate([[0], np.cumsum(step)])
        outside &= depth[1:] - depth[offsets[:-1]][row] <= 0
    table = np.zeros(256, np.uint8)
    table[list(syntax.value)] = 1
    table[list(syntax.entry)] = 2
    kind = table[data] * outside
    cut = np.flatnonzero(kind)
    live = np.flatnonzero(lengths > 0)
    begins = np.concatenate([offsets[live], cut + 1])
    first = np.concatenate([np.full(len(live), True), kind[cut] == 2])
    ends_at = np.concatenate([cut, offsets[live + 1]])
    rows = np.concatenate([live, row[cut]])
    order = np.lexsort((begins, rows))
    begins, first, rows = begins[order], first[order], rows[order]
    ends = np.sort(ends_at, kind="stable")
    return rows, begins, ends, first


def unquoted(text: str) -> str:
    """``text`` without blanks around it, its enclosing quotes taken off and doubled ones made single."""
    text = text.strip()
    if text[:1] != '"':
        return text
    body = re.match(r'"((?:[^"]|"")*)("?)', text)
    return body[1].replace('""', '"') + text[body.end() :]


def whole_number(text: str, first: bool, state: object) -> tuple[str | None, object]:
    """The digits of a whole number, whose thousands may be set apart inside quotes; else nothing."""
    text = text.strip()
    value = unquoted(text)
    if text[:1] == '"':
        value = re.sub(r"[\s,._']", "", value)
    return (value.lstrip("0") or "0") if re.fullmatch(r"[0-9]+", value) else None, None


TAGGED = re.compile(r"\s*([A-Za-z_]+)(?:\s*=|\s)(.*)", re.S)


def tagged_value(text: str, first: bool, state: object) -> tuple[str | None, object]:
    """``tag=value``; values after commas take the tag of their entry; entries without a tag hold none."""
    if first:
        m = TAGGED.fullmatch(text)
        state, text = (m[1], m[2]) if m else (None, "")
        if text.lstrip()[:1] == "=":
            text = text.lstrip()[1:]
    value = unquoted(text)
    return f"{state}={value}".strip() if state and value.strip() else None, state


#: Lists of whole numbers under any of the usual delimiters, with or without brackets.
NUMBERS = Syntax(entry=b"", value=b",;|/: \t\n\r()[]{}", read=whole_number)
#: GFF3 and GTF attributes.
ATTRIBUTES = Syntax(entry=b";|\t\n\r", value=b",", read=tagged_value)


def read_field(values: pa.Array, syntax: Syntax) -> tuple[list[int], list[int], list[str]]:
    """Row, position (from 1 in each row) and item of every value."""
    filled = values.fill_null("").cast(pa.large_string())
    filled = pa.concat_arrays([filled])  # without an offset
    _, raw, body = filled.buffers()
    offsets = np.frombuffer(raw, np.int64, len(filled) + 1, filled.offset * 8)
    data = np.frombuffer(body, np.uint8)[: offsets[-1]] if body is not None and offsets[-1] else np.empty(0, np.uint8)
    data, offsets = data[offsets[0] :], offsets - offsets[0]
    rows, begins, ends, first = (a.tolist() for a in spans(data, offsets, syntax))
    whole = data.tobytes()
    out_row, out_pos, out_item = [], [], []
    before, pos, state = -1, 0, None
    for r, b, e, f in zip(rows, begins, ends, first):
        if r != before:
            before, pos, state = r, 0, None
        if b == e:
            if f:
                state = None
            continue
        item, state = syntax.read(whole[b:e].decode("utf-8", "surrogatepass"), f, state)
        if item is not None:
            pos += 1
            out_row.append(r)
            out_pos.append(pos)
            out_item.append(item)
    return out_row, out_pos, out_item


def unpack(df: DataFrame, key: str, fields: dict[str, Syntax], table_name: str) -> DataFrame:
    """table_name, row_id, field, pos, item: one row for each non-empty value of ``fields``, pos from 1.

    Null, empty and blank fields and fields of placeholders hold no value.  Rows that repeat a key with
    the same fields count once (so do rows without a key that are alike); a null key stays null.
    An empty table gives no rows; other columns aren't read.
    """
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in enumerate(names, 1):
                rows, pos, items = read_field(b.column(i), fields[name])
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([table_name] * n, pa.string()), b.column(0).take(pa.array(rows, pa.int64())), pa.array([name] * n, pa.string()), pa.array(pos, pa.int32()), pa.array(items, pa.string())],
                    names=["table_name", "row_id", "field", "pos", "item"],
                )

    once = df.select(F.col(key).cast("bigint").alias(key), *[F.col(f).cast("string").alias(f) for f in names]).distinct()
    return once.mapInArrow(run, "table_name string, row_id bigint, field string, pos int, item string")
