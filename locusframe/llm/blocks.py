"""Pairs of an exact or almost exact occurrence, complete: blocks of strings against blocks of strings.

Of a string of n letters, cut into n // 9 segments, k = n // 10 edits touch at most k: at least n // 9 - k
segments occur untouched in the other string, however the edits lie.  All pairs are counted by that (numpy,
nine-letter words against the bits of groups of strings, which hold what any of theirs holds; long strings chunk
by chunk against windows; strings under GROUPED letters against each string), what is left by two further lower
bounds over shorter segments, what is left then by the dynamic program.  No bound drops a true pair.  Work
grows as the product of the two sides; it is spread over blocks of limited size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD, FINE, COARSE = 9, 6, 8
#: Strings from LONG letters on share many words with any other by chance: their words are counted chunk by chunk.
#: Chunks have CHUNK to CHUNK * 5 / 4 letters, windows of the searched string begin each STEP letters and overlap by the most that a chunk can match.
LONG, CHUNK = 4096, 1024
OVERLAP = CHUNK * 5 // 4 * 11 // 10
STEP = 2 * OVERLAP
#: Strings from GROUPED letters on are counted against groups of strings first. Of how few and how many letters a group has, and 64-bit words looked at together.
GROUPED, FEWEST, MOST, BITS = 400, 2500, 9000, 12_000
#: Ranges of lengths in an octave.
RANGES = 8
#: Short segments of one stretch, and width of half a window of diagonals.
GROUP = 16
#: Letters of a block, counters of a batch, letters and matches looked at together.
BLOCK, COUNTERS, LETTERS, MATCHES = 20_000_000, 400_000, 300_000, 20_000_000


class Longs:
    """Strings to be searched, with the strings that hold each word and the short words of all positions."""

    def __init__(self, texts: list[bytes], indexed: bool = True, listed: bool = True):
        from locusframe.llm.overlap import _grams

        self.sizes, self.begin, whole = _joined(texts)
        m = len(texts)
        self.short = {FINE: _grams(whole, FINE), COARSE: None if listed else _grams(whole, COARSE)}
        if indexed:
            row = np.repeat(np.arange(m, dtype=np.int32), self.sizes + 1)[: len(whole)]
            end = (self.begin + self.sizes).astype(np.int32)
            left = np.repeat(end, self.sizes + 1)[: len(whole)] - np.arange(len(whole), dtype=np.int32)  # letters to the end
            key = _grams(whole, WORD)
            inside = left[: len(key)] >= WORD
            bits = max(1, (m - 1).bit_length())
            kind = np.uint32 if 2 * WORD + bits <= 32 else np.uint64
            held = np.sort(key[inside].astype(kind) << kind(bits) | row[: len(key)][inside].astype(kind))
            held = held[np.concatenate([[True], held[1:] != held[:-1]])] if len(held) else held
            self.start = np.searchsorted(held >> kind(bits), np.arange(4**WORD + 1, dtype=kind))
            self.holder = (held & kind((1 << bits) - 1)).astype(np.int32)
        if not listed:
            return
        # which short words a string holds at all, a bit for each
        self.q = 6 if self.sizes.max() < 1000 else 7 if self.sizes.max() < 4000 else 8
        word = self.short[FINE] if self.q == 6 else _grams(whole, self.q)
        self.holds = np.empty((m, 4**self.q // 8), np.uint8)
        for first in range(0, m, 64):
            last = min(m, first + 64)
            count = np.maximum(0, self.sizes[first:last] - self.q + 1)
            there = np.zeros((last - first, 4**self.q), bool)
            there[np.repeat(np.arange(last - first), count), word[_ranges(self.begin[first:last], count)]] = True
            self.holds[first:last] = np.packbits(there, axis=1, bitorder="little")
        self.room = _room(whole, self.begin, self.begin + self.sizes, self.q)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sizes and begins of strings, and the strings one after the other, a zero byte between them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return sizes, np.cumsum(sizes + 1) - sizes - 1, b"\x00".join(texts)


def _room(whole: bytes, low: np.ndarray, high: np.ndarray, q: int) -> np.ndarray:
    """Into how many segments of ``q`` letters side by side the runs of A, and of letters counted as A, from low to high can be cut."""
    from locusframe.llm.overlap import _CODE

    turn = np.flatnonzero(np.diff(_CODE[np.frombuffer(whole, np.uint8)] & 3 == 0, prepend=False, append=False))
    begin, end = turn[::2], turn[1::2]
    some = end - begin >= q
    begin, end = begin[some], end[some]
    first, last = np.searchsorted(end, low, "right"), np.searchsorted(begin, high)
    of, run = np.repeat(np.arange(len(low)), last - first), _ranges(first, last - first)
    room = np.maximum(0, np.minimum(end[run], high[of]) - np.maximum(begin[run], low[of])) // q
    return np.bincount(of, weights=room, minlength=len(low)).astype(np.int64)


class Groups:
    """Groups of letters (strings next to each other, or a stretch of one) from low to high, with a bit for each word and group that holds it.

    A word of A alone (or letters counted as A) is held a first, second ... time, as far as there is room for it.
    """

    TIMES = 32
    NONE, ALL = 4**WORD + TIMES, 4**WORD + TIMES + 1  # a word that no group holds and one that all hold

    def __init__(self, word: np.ndarray, low: np.ndarray, high: np.ndarray, room: np.ndarray):
        self.held = np.zeros((self.ALL + 1, -(-len(low) // 64)), np.uint64)
        self.size = len(low)
        for column in range(self.held.shape[1]):
            bits = np.zeros(4**WORD, np.uint64)
            for i in range(64 * column, min(len(low), 64 * column + 64)):
                key = word[low[i] : high[i]]  # also what lies across two strings: never too few
                bits[key] |= np.uint64(1 << i % 64)
            self.held[: 4**WORD, column] = bits
            for i in range(64 * column, min(len(low), 64 * column + 64)):
                self.held[4**WORD : 4**WORD + min(self.TIMES, int(room[i])), column] |= np.uint64(1 << i % 64)
        self.held[self.ALL] = ~np.uint64(0)

    def digits(self, key: np.ndarray) -> list[np.ndarray]:
        """Of each row of words: how many of them each group holds, as binary digits from the lowest one on, a bit for each group."""
        waiting: list[list[np.ndarray]] = [[]]
        for x in range(key.shape[1]):
            level, carry = 0, self.held[key[:, x]]
            while carry is not None:
                if level == len(waiting):
                    waiting.append([])
                waiting[level].append(carry)
                carry = None
                if len(waiting[level]) == 3:  # three numbers of this weight are one, and one of the next
                    a, b, c = waiting[level]
                    either = a ^ b
                    waiting[level] = [either ^ c]
                    carry = a & b | either & c
                    level += 1
        out, level = [], 0
        while level < len(waiting):
            if len(waiting[level]) == 3:
                a, b, c = waiting[level]
                digit, carry = a ^ b ^ c, a & b | (a ^ b) & c
            elif len(waiting[level]) == 2:
                a, b = waiting[level]
                digit, carry = a ^ b, a & b
            else:
                digit, carry = waiting[level][0], None
            out.append(digit)
            level += 1
            if carry is not None:
                if level == len(waiting):
                    waiting.append([])
                waiting[level].append(carry)
        return out

    def each(self, bits: np.ndarray) -> np.ndarray:
        """The bits of all groups, a byte for each."""
        return np.unpackbits(bits.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little", count=self.size)

    def reached(self, key: np.ndarray, least: int) -> np.ndarray:
        """Of each row of words: which groups hold at least ``least`` of them, as bits."""
        digits = self.digits(key)
        more, equal = np.zeros_like(digits[0]), np.full_like(digits[0], ~np.uint64(0))
        for i in reversed(range(max(len(digits), least.bit_length()))):
            digit = digits[i] if i < len(digits) else np.zeros_like(more)
            if least >> i & 1:
                equal = equal & digit
            else:
                more, equal = more | equal & digit, equal & ~digit
        return more | equal

    def keys(self, cut: Cut, first: int, last: int, pad: np.ndarray) -> np.ndarray:
        """The words of the strings from ``first`` to before ``last``, a row for each, and ``pad`` words that all groups hold."""
        own = np.arange(last - first)
        given, count = cut.between(first, last, WORD)
        given, row = given.astype(np.int64), np.repeat(own, count)
        plain = np.flatnonzero(given == 0)
        time = np.arange(len(plain)) - np.searchsorted(row[plain], row[plain])
        given[plain] = 4**WORD + np.minimum(time, self.TIMES - 1)
        key = np.full((last - first, int((count + pad).max())), self.NONE, np.int64)
        key[row, _ranges(np.zeros_like(count), count)] = given
        key[np.repeat(own, pad), _ranges(count, pad)] = self.ALL
        return key

    def found(self, cut: Cut) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Strings, cut in words and ordered by length, and groups that hold as many of their words as an occurrence leaves untouched."""
        words = cut.sizes // WORD
        least = words - cut.sizes // 10
        step = max(1, BITS // self.held.shape[1])
        for first in range(0, len(words), step):
            last = min(len(words), first + step)
            most = int(least[first:last].max())
            reached = self.reached(self.keys(cut, first, last, most - least[first:last]), most)  # padded, so that one number is to be reached
            if reached.any():
                i, g = np.nonzero(self.each(reached))
                yield first + i, g


def group_letters(sizes: np.ndarray) -> int:
    """Letters of a group that by chance seldom holds as many words of such a string as an occurrence."""
    words = sizes // WORD
    return int(np.clip(((0.32 * (words - sizes // 10) - 1) * 4**WORD / words).min(), FEWEST, MOST))


class Cut:
    """Strings cut into whole segments side by side from the first letter on, for every length of segments asked."""

    def __init__(self, texts: list[bytes]):
        from locusframe.llm.overlap import _CODE

        self.code = _CODE[np.frombuffer(b"".join(texts), np.uint8)] & 3
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _keys(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        if q not in self.made:
            parts = self.sizes // q
            at = (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * q + np.repeat(self.begin, parts)
            key = np.zeros(len(at), np.int32)
            for i in range(q):
                key = key << 2 | self.code[at + i]
            self.made[q] = key, np.concatenate([[0], np.cumsum(parts)])
        return self.made[q]

    def of(self, i: int, q: int) -> np.ndarray:
        key, end = self._keys(q)
        return key[end[i] : end[i + 1]]

    def between(self, first: int, last: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the strings from ``first`` to before ``last``, and how many each has."""
        key, end = self._keys(q)
        return key[end[first] : end[last]], np.diff(end[first : last + 1])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The whole numbers start, start + 1, ... of each pair, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def shared_words(cut: Cut, longs: Longs, first: int, last: int) -> np.ndarray:
    """How many words each string from ``first`` to before ``last`` shares with each searched string, as a matrix."""
    m = len(longs.sizes)
    key, words = cut.between(first, last, WORD)
    start, count = longs.start[key], longs.start[key + 1] - longs.start[key]
    own = np.repeat(np.arange(last - first) * m, words)
    return np.bincount(np.repeat(own, count) + longs.holder[_ranges(start, count)], minlength=(last - first) * m).reshape(last - first, m)


def missing(own: np.ndarray, longs: Longs, which: np.ndarray) -> np.ndarray:
    """How many of the segments ``own`` (of ``longs.q`` letters) each of the searched strings ``which`` holds nowhere: each has an edit.

    Untouched segments lie side by side there too, so those of A alone count for no more than its runs have room for.
    """
    plain = int(np.count_nonzero(own == 0))
    own = own[own != 0]
    byte, bit = own >> 3, (own & 7).astype(np.uint8)
    return len(own) - (longs.holds[which[:, None], byte] >> bit & 1).sum(axis=1, dtype=np.int64) + np.maximum(0, plain - longs.room[which])


def least_edits(own: np.ndarray, n: int, longs: Longs, which: np.ndarray, q: int = FINE) -> np.ndarray:
    """Lower bounds, by its segments ``own`` of ``q`` letters, of the edits between a string of ``n`` letters and any stretch of each of ``which``.

    Every edit lies in one stretch of GROUP segments at most.  With e <= GROUP edits in a stretch its
    untouched segments lie on diagonals at most e apart, so one window of twice GROUP diagonals has them all:
    e is at least the segments of the stretch less those in its best window.
    """
    k, parts = n // 10, n // q
    stretches = -(-parts // GROUP)
    order = np.argsort(own, kind="stable")
    degree = np.bincount(own, minlength=4**q)
    begin = np.cumsum(degree) - degree
    ends = np.cumsum(longs.sizes[which] - q + 1)
    first = np.concatenate([[0], ends[:-1]])
    key = np.concatenate([longs.short[q][x : x + z - q + 1] for x, z in zip(longs.begin[which].tolist(), longs.sizes[which].tolist())])
    some = np.flatnonzero((degree > 0)[key])
    key = key[some]
    count = degree[key]
    if int(count.sum()) > MATCHES:
        half = len(which) // 2
        return np.concatenate([least_edits(own, n, longs, w, q) for w in (which[:half], which[half:])]) if half else np.zeros(1, np.int64)
    row = np.searchsorted(ends, some, "right")
    place = some - first[row]
    part = order[_ranges(begin[key], count)]
    row = np.repeat(row, count)
    d = np.repeat(place, count) - q * part
    fit = (d >= -k) & (d <= longs.sizes[which][row] - n + k)
    row, d, part = row[fit], d[fit], part[fit]
    windows = (int(longs.sizes[which].max()) - n + 2 * k) // GROUP + 3
    cell = (row * stretches + part // GROUP) * windows + (d + k) // GROUP + 1
    cell = np.sort(np.concatenate([cell, cell - 1]))
    best = np.zeros(len(which) * stretches, np.int64)
    if len(cell):
        turn = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        times, of = np.diff(np.concatenate([turn, [len(cell)]])), cell[turn] // windows
        lead = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        best[of[lead]] = np.maximum.reduceat(times, lead)
    held = np.minimum(GROUP, parts - GROUP * np.arange(stretches))
    return np.maximum(0, held - best.reshape(len(which), stretches)).sum(axis=1)


def bounded(cut: Cut, i: int, longs: Longs, found: np.ndarray, q: int) -> np.ndarray:
    """Those of ``found`` that the bound by segments of ``q`` letters doesn't tell from an occurrence of the string ``i``."""
    n = int(cut.sizes[i])
    group = np.cumsum(longs.sizes[found]) // LETTERS
    some = [found[group == g] for g in np.unique(group)]
    return np.concatenate([w[least_edits(cut.of(i, q), n, longs, w, q) <= n // 10] for w in some]) if some else found


def short_candidates(shorts: list[bytes], texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs that share at least n // 9 - n // 10 words, as every occurrence does, and pass the further bounds."""
    cut, longs = Cut(shorts), Longs(texts)
    m = len(texts)
    step = max(1, COUNTERS // m)
    for first in range(0, len(shorts), step):
        sizes = cut.sizes[first : first + step]
        shared = shared_words(cut, longs, first, first + len(sizes))
        i, j = np.divmod(np.flatnonzero((shared >= (sizes // WORD - sizes // 10)[:, None]).ravel()), m)
        fit = (longs.sizes[j] >= sizes[i]) & (longs.sizes[j] <= 2 * sizes[i])
        yield from _judged(cut, longs, first + i[fit], j[fit])


def _judged(cut: Cut, longs: Longs, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those of the pairs (i in order) that pass the bounds by segments held nowhere and by stretches."""
    turn = np.flatnonzero(np.diff(i, prepend=-1))
    for at, end in zip(turn, [*turn[1:], len(i)]):
        own, found = int(i[at]), j[at:end]
        n = int(cut.sizes[own])
        found = found[missing(cut.of(own, longs.q), longs, found) <= n // 10]
        for y in bounded(cut, own, longs, found, FINE) if n >= FINE else found:
            yield own, int(y)


def grouped_candidates(shorts: list[bytes], texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """The same for strings of GROUPED letters or more, by groups of searched strings.

    A group of strings holds all words that one of them holds. So a group that holds fewer of a string's words
    than an occurrence leaves untouched has no occurrence; by chance, few groups hold as many.
    """
    from locusframe.llm.overlap import _grams

    sizes, begin, whole = _joined(texts)
    room = _room(whole, begin, begin + sizes, WORD)
    order = np.lexsort([sizes, np.minimum(room, Groups.TIMES)])  # strings with as much N come together
    turn = np.argsort([len(s) for s in shorts], kind="stable")
    cut, texts, room = Cut([shorts[i] for i in turn]), [texts[j] for j in order], room[order]
    sizes, begin, whole = _joined(texts)
    head = np.flatnonzero(np.diff(begin // group_letters(cut.sizes), prepend=-1))  # the first string of each group
    tail = np.append(head[1:], len(texts))
    groups = Groups(_grams(whole, WORD), begin[head], (begin + sizes)[tail - 1], np.maximum.reduceat(room, head))
    longs = Longs(texts, indexed=False)
    for i, g in groups.found(cut):
        many = tail[g] - head[g]
        i, j = np.repeat(i, many), _ranges(head[g], many)
        fit = (longs.sizes[j] >= cut.sizes[i]) & (longs.sizes[j] <= 2 * cut.sizes[i])
        for x, y in _judged(cut, longs, i[fit], j[fit]):
            yield int(turn[x]), int(order[y])


def long_candidates(shorts: list[bytes], texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """The same for long strings, whose words are counted chunk by chunk.

    A chunk that occurs in a stretch of the searched string lies in one of its windows; it has at least as many
    edits as words that its best window lacks, and the string at least the sum over its chunks.
    """
    from locusframe.llm.overlap import _grams

    chunks, ends = [], [0]
    for s in shorts:
        at = np.linspace(0, len(s), len(s) // CHUNK + 1).astype(int).tolist()
        chunks += [s[x:y] for x, y in zip(at, at[1:])]
        ends.append(len(chunks))
    parts, whole, longs = Cut(chunks), Cut(shorts), Longs(texts, indexed=False, listed=False)
    _, _, joined = _joined(texts)
    many = np.maximum(1, -(-(longs.sizes - OVERLAP) // STEP))
    owner = np.cumsum(many) - many
    low = np.repeat(longs.begin, many) + STEP * _ranges(np.zeros_like(many), many)
    high = np.minimum(low + STEP + OVERLAP, np.repeat(longs.begin + longs.sizes, many))
    windows = Groups(_grams(joined, WORD), low, high, _room(joined, low, high, WORD))
    words = parts.sizes // WORD
    step = max(1, BITS // windows.held.shape[1])
    first = 0
    while first < len(shorts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, "right")) - 1)
        rows = slice(ends[first], ends[last])
        held = np.zeros((ends[last] - ends[first], len(low)), np.uint8)
        for level, digit in enumerate(windows.digits(windows.keys(parts, ends[first], ends[last], np.zeros_like(words[rows])))):
            held += windows.each(digit) << np.uint8(level)
        best = np.maximum.reduceat(held, owner, axis=1)
        lacking = np.add.reduceat(np.maximum(0, words[rows, None] - best), np.array(ends[first:last]) - ends[first], axis=0)
        for i in range(first, last):
            n = int(whole.sizes[i])
            found = np.flatnonzero((lacking[i - first] <= n // 10) & (longs.sizes >= n) & (longs.sizes <= 2 * n))
            for q in (COARSE, FINE):
                found = bounded(whole, i, longs, found, q)
            for j in found:
                yield i, int(j)
        first = last


def occurrences(shorts: list[bytes], texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """All (i, j): the string i matches a stretch of the string j, at most twice as long, with a tenth of i's letters edited."""
    from locusframe.llm.overlap import infix_distance

    for chosen, find in ((lambda n: n < GROUPED, short_candidates), (lambda n: GROUPED <= n < LONG, grouped_candidates), (lambda n: n >= LONG, long_candidates)):
        rows = [i for i, s in enumerate(shorts) if chosen(len(s))]
        if not rows:
            continue
        least, most = min(len(shorts[i]) for i in rows), max(len(shorts[i]) for i in rows)
        columns = [j for j, t in enumerate(texts) if least <= len(t) <= 2 * most]
        if not columns:
            continue
        for x, y in find([shorts[i] for i in rows], [texts[j] for j in columns]):
            s, t = shorts[rows[x]], texts[columns[y]]
            if s in t or infix_distance(s, t, len(s) // 10, 0, len(t) - len(s)) <= len(s) // 10:
                yield rows[x], columns[y]


def block_pairs(names_a: list, a: list[bytes], names_b: list, b: list[bytes]) -> set[tuple]:
    """Names of all pairs of a string of ``a`` and one of ``b``, the shorter of which occurs almost in the longer, in either direction."""
    from locusframe.llm.overlap import reverse_complement

    out: set[tuple] = set()
    for own, names, other, others, turn in ((a, names_a, b, names_b, False), (b, names_b, a, names_a, True)):
        least, most = min(map(len, other)), max(map(len, other))
        some = [i for i, t in enumerate(own) if 2 * len(t) >= least and len(t) <= most]
        both = [own[i] for i in some] + [reverse_complement(own[i]) for i in some]
        for i, j in occurrences(both, other):
            pair = (names[some[i % len(some)]], others[j])
            out.add(pair[::-1] if turn else pair)
    return out


def _of_task(table: pa.Table) -> pa.Table:
    side: dict[bool, tuple[list, list[bytes]]] = {True: ([], []), False: ([], [])}
    for c, n, held_out, z in zip(*(table.column(x).to_pylist() for x in ("c", "n", "held_out", "z"))):
        side[held_out][0].append(c)
        side[held_out][1].append(pa.decompress(z, n, "zstd", asbytes=True))
    pairs = sorted(p for p in block_pairs(*side[True], *side[False]) if p[0] != p[1]) if side[True][0] and side[False][0] else []
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})


def length_blocks(letters: dict[int, int], block: int) -> list[tuple[int, int, int]]:
    """Blocks of about ``block`` letters: first and last range of lengths, and in how many parts they are cut.

    ``letters``: of each range.  Neighbouring small ranges come together, a large one is parted.
    """
    out: list[tuple[int, int, int]] = []
    first, total = None, 0
    for x in sorted(letters):
        if first is not None and (total + letters[x] > block or x - first >= RANGES):
            out.append((first, last, math.ceil(total / block)))
            first, total = None, 0
        first, last, total = x if first is None else first, x, total + letters[x]
    return [*out, (first, last, math.ceil(total / block))] if first is not None else out


def all_links(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs of classes (a held out, b of training) with different strings within the allowed edits; ``rows``: c, n, held_out, z.

    ``z`` are the compressed strings of ``n`` bytes.  Blocks are of strings of neighbouring lengths, so a block
    meets only those from half to twice its lengths.
    """
    spark = rows.sparkSession
    packed = rows.select("c", "n", "held_out", "z").withColumn("bin", F.floor(F.log2("n") * RANGES).cast("int"))
    total: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in packed.select("c", "n", "held_out", "bin").distinct().groupBy("bin", "held_out").agg(F.sum("n").alias("letters")).collect():  # some hundred ranges at most
        total[r["held_out"]][r["bin"]] = r["letters"]
    blocks = {side: length_blocks(total[side], block) for side in total}
    number = {side: [sum(p for *_, p in blocks[side][:i]) for i in range(len(blocks[side]))] for side in total}
    plan = []
    for side in (True, False):
        for (low, high, parts), base in zip(blocks[side], number[side]):
            for (other_low, other_high, other_parts), other in zip(blocks[not side], number[not side]):
                if low <= other_high + RANGES and other_low <= high + RANGES:
                    plan += [(x, side, parts, base, other + p) for x in range(low, high + 1) if x in total[side] for p in range(other_parts)]
    if not plan:
        return spark.createDataFrame([], "a binary, b binary")
    meets = spark.createDataFrame(plan, "bin int, held_out boolean, parts int, base int, other int")
    spread = packed.dropDuplicates(["c", "held_out"]).join(F.broadcast(meets), ["bin", "held_out"]).withColumn("own", F.col("base") + F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    side = [F.when(F.col("held_out"), x).otherwise(y).alias(name) for name, x, y in (("block_a", F.col("own"), F.col("other")), ("block_b", F.col("other"), F.col("own")))]
    return spread.select("c", "n", "held_out", "z", *side).groupBy("block_a", "block_b").applyInArrow(_of_task, "a binary, b binary").distinct()
