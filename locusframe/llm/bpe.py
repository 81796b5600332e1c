"""Byte-pair encoding of whole corpora with a public rank file.

Text is cut into words without a regular-expression engine: code points of a block of documents are
classed through one lookup table and the word boundaries follow from comparisons of neighbouring
classes, all in numpy.  The words of a block become an Arrow string array over the same bytes (no
copies) and are dictionary-encoded, so merges run only over words not met before.

Merges use a contiguous rank array: each row of a matrix holds the parts of one short word and the
ranks of its adjacent pairs.  Every round takes each row's minimum, deletes that boundary and
refreshes the two neighbouring ranks.  Words longer than ``SHORT`` bytes take a heap over linked
parts, which gives the same merges without the quadratic scan.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public rank files lie; a parameter of every operator here.
TOKENIZER_DIR = os.environ.get("LOCUSFRAME_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Bytes up to which a word's ranks are scanned as one row.
SHORT = 64
#: Characters worked on at once.
BLOCK_CHARS = 1_500_000
#: Words whose ids a worker keeps; beyond it the memory starts anew, which changes nothing but time.
MEMORY_WORDS = 600_000

NO_RANK = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

# The code points with the property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    of = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = category(chr(cp))[0]
        if c == "L":
            of[cp] = LETTER
        elif c == "N":
            of[cp] = NUMBER
    of[WHITE_SPACE] = SPACE
    return of


def word_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions at which words begin in the code points of documents laid end to end.

    A word is a run of letters, of numbers or of other characters with one ordinary space before it,
    or a run of white space without the character that the next word may take; the English
    contractions after an apostrophe are words of their own.
    """
    n = len(cp)
    if n == 0:
        return np.empty(0, np.int64)
    kind = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[doc_starts[doc_starts < n]] = True
    first[n] = True
    run = first.copy()  # a run of one class begins here
    run[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start = run[:n].copy()
    # the last character of a white-space run that a visible run follows is cut off ...
    last = space.copy()
    last[:-1] &= ~space[1:] & ~first[1:n]
    last[-1] = False
    start |= last
    # ... and joins that run if it is the ordinary space
    joins = last & (cp == 0x20)
    after = np.flatnonzero(joins) + 1
    start[after] = False
    # contractions: a lone apostrophe that begins a word, then small letters
    quote = np.flatnonzero((cp == 0x27) & start)
    if len(quote):
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        ends = np.concatenate([first, np.ones(3, bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = ~ends[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
        pair = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        two = ~ends[quote + 1] & ~ends[quote + 2] & pair
        for where, length in ((one, 2), (two, 3)):
            at = quote[where]
            start[at + 1] = False
            rest = at + length
            rest = rest[rest < n]
            # what follows begins a word unless it is white space that stays with its own run
            start[rest] = True
    return np.flatnonzero(start)


class RankTable:
    """Ranks of byte strings, and of pairs of ids, from a rank file (one ``base64 rank`` a line)."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                word, _, rank = line.partition(b" ")
                if rank:
                    self.ranks[base64.b64decode(word)] = int(rank)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        get = self.ranks.get
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                a, b = get(word[:cut]), get(word[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        # Open addressing, so that a batch of pairs is looked up with a few gathers.
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int64)
        self.merged = np.full(1 << bits, NO_RANK, np.int32)
        todo_k, todo_m = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        at = self._slot(todo_k)
        self.probes = 0
        while len(todo_k):
            self.probes += 1
            free = self.slots[at] < 0
            _, won = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = won[free[won]]
            self.slots[at[won]], self.merged[at[won]] = todo_k[won], todo_m[won]
            left = np.ones(len(at), bool)
            left[won] = False
            todo_k, todo_m, at = todo_k[left], todo_m[left], (at[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair of ids, ``NO_RANK`` where there is none or a part is missing (-1)."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        out = np.full(len(keys), NO_RANK, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._slot(keys[open_])
        for _ in range(self.probes):
            if not len(open_):
                break
            found = self.slots[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[at[hit]]
            go = ~hit & (found >= 0)
            open_, at = open_[go], (at[go] + 1) & (len(self.slots) - 1)
        return out

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of like length: all rank rows shrink together, one boundary a round."""
        width = max(map(len, words))
        parts = np.full((len(words), width), -1, np.int32)
        for row, w in enumerate(words):
            parts[row, : len(w)] = self.of_byte[np.frombuffer(w, np.uint8)]
        out: list = [None] * len(words)
        live = np.arange(len(words))
        ranks = self.pair_ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), width - 1) if width > 1 else np.full((len(words), 0), NO_RANK)
        while True:
            if ranks.shape[1]:
                at = ranks.argmin(1)
                low = ranks[np.arange(len(live)), at]
                done = low == NO_RANK
            else:
                done = np.ones(len(live), bool)
            for row in np.flatnonzero(done):
                p = parts[row]
                out[live[row]] = p[p >= 0].tolist()
            if done.all():
                return out
            if done.any():
                go = ~done
                live, parts, ranks, at, low = live[go], parts[go], ranks[go], at[go], low[go]
            rows, cols = np.arange(len(live)), np.arange(parts.shape[1] - 1)
            # delete the boundary right of the part at ``at``
            parts[rows, at] = low
            parts = np.take_along_axis(parts, cols + (cols > at[:, None]), 1)
            if parts.shape[1] == 1:
                ranks = np.empty((len(live), 0), np.int32)
                continue
            cols = np.arange(parts.shape[1] - 1)
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
            inside = at < parts.shape[1] - 1
            ranks[rows[inside], at[inside]] = self.pair_ranks(parts[rows[inside], at[inside]], parts[rows[inside], at[inside] + 1])
            left = at > 0
            ranks[rows[left], at[left] - 1] = self.pair_ranks(parts[rows[left], at[left] - 1], parts[rows[left], at[left]])

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word: a heap of pairs over linked parts, lowest rank and leftmost first."""
        get, n = self.ranks.get, len(word)
        end = list(range(1, n + 1))  # where the part that begins at i ends; 0 once it is swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue
            mid = end[i]
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (word by word, no text rules)."""
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = [whole]
            elif len(w) > SHORT:
                out[i] = self.merge_long(w)
            elif w:
                by_width.setdefault((len(w) + 3) // 4, []).append(i)
            else:
                out[i] = []
        for members in by_width.values():
            for i in range(0, len(members), 4096):
                some = members[i : i + 4096]
                for k, ids in zip(some, self.merge_short([words[k] for k in some])):
                    out[k] = ids
        return out


class Encoder:
    """Encodes batches of texts; remembers the ids of words it has met in one flat pool."""

    def __init__(self, path: str):
        self.table = RankTable(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0
        self.begin = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int32)

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.empty(max(need - len(a), len(a)), a.dtype)])

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the memory, new words being merged first."""
        if len(self.known) > MEMORY_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            for w, ids in zip(new, self.table.encode_words(new)):
                k = len(self.known)
                self.known[w] = k
                self.pool = self._room(self.pool, self.used + len(ids))
                self.begin, self.count = self._room(self.begin, k + 1), self._room(self.count, k + 1)
                self.pool[self.used : self.used + len(ids)] = ids
                self.begin[k], self.count[k] = self.used, len(ids)
                self.used += len(ids)
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def _block(self, texts: list[str], ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids of each text and, if asked, the ids laid end to end."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        data = joined.encode("utf-8", "surrogatepass")
        cp = np.frombuffer(data, np.uint8) if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.concatenate([[0], np.cumsum(lengths)])
        starts = word_starts(cp, doc[:-1])
        if not len(starts):
            return np.zeros(len(texts), np.int64), np.empty(0, np.int32)
        if len(data) == len(joined):
            at = starts
        else:
            size = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
            at = np.concatenate([[0], np.cumsum(size)])[starts]
        offsets = np.append(at, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        number = self._numbers(words.dictionary.to_pylist())[np.asarray(words.indices)]
        count = self.count[number].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        per_doc = np.diff(total[np.searchsorted(starts, doc)])
        if not ids:
            return per_doc, None
        places = np.arange(total[-1]) + np.repeat(self.begin[number] - total[:-1], count)
        return per_doc, self.pool[places]

    def encode(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Counts of ids a text and, if ``ids``, all ids end to end; null and empty texts have none."""
        counts, flat, block, size = [], [], [], 0
        for i, t in enumerate(texts):
            block.append(t or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS or i + 1 == len(texts):
                c, f = self._block(block, ids)
                counts.append(c)
                flat.append(f)
                block, size = [], 0
        if not counts:
            return np.zeros(0, np.int64), np.empty(0, np.int32)
        return np.concatenate(counts), np.concatenate(flat) if ids else None


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and rank file."""
    return Encoder(path)


def rank_file(name: str = VOCABULARY, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")


def encode_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``key`` and the ids of ``text`` (array<int>) without special tokens, one row for each row of ``docs``.

    Null and empty texts give the empty list; a null key stays null; repeated rows stay repeated;
    other columns of ``docs`` are not carried, whatever their names.  An empty table gives no rows.
    Whole texts are encoded, however long; strings that look like special tokens are ordinary text.
    """
    path = rank_file(vocabulary, folder)
    key_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            counts, flat = enc.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, ids])

    schema = T.StructType([T.StructField(key, key_type), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def count_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str = "n_tokens", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``key`` and the number of ids of ``text``; 0 for null and empty texts. Else as ``encode_ids``."""
    path = rank_file(vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            counts, _ = enc.encode(b.column(1).to_pylist(), ids=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=[key, count])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(count, T.LongType())])
    return docs.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def decode(ids: list[int], table: RankTable) -> bytes:
    """The bytes that ids stand for."""
    back = {r: w for w, r in table.ranks.items()}
    return b"".join(back[i] for i in ids)
