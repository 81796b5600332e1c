"""Alternative transcripts of one locus: what differs, what counts as an alternative, and its kind."""

from __future__ import annotations

from locusframe import schema as S

Event = tuple[int, int, float]


def difference(ref: list[Event], alt: list[Event]) -> tuple[list[Event], list[Event]]:
    """Events that ``alt`` adds and removes, matched by position and type."""
    of_ref, of_alt = {e[:2] for e in ref}, {e[:2] for e in alt}
    return [e for e in alt if e[:2] not in of_ref], [e for e in ref if e[:2] not in of_alt]


def is_alternative(ref: list[Event], alt: list[Event]) -> bool:
    """Whether ``alt`` is a believable alternative of ``ref``.

    Every added event scores at least 0.05, and the added ones beat the removed ones by 0.2; or there
    is one added event of at least 0.2 against one removed event, introns outside ``alt`` not counted.
    """
    added, removed = difference(ref, alt)
    if any(e[2] < 0.05 for e in added):
        return False
    plus, minus = sum(e[2] for e in added), sum(e[2] for e in removed)
    if plus - minus >= 0.2:
        return True
    outside = sum(1 for e in removed if e[1] == S.EXON_END and not alt[0][0] <= e[0] <= alt[-1][0])
    return len(added) == 1 and plus >= 0.2 and len(removed) - 2 * outside == 1


def cds_bases(call: list[Event]) -> int:
    return sum(b[0] + 1 - a[0] for a, b in zip(call[::2], call[1::2]))


def choose(calls: list[tuple[float, list[Event]]], limit: int = 5) -> list[int]:
    """Indices of the transcripts of a locus that are kept, longest CDS first.

    ``calls`` are in the order (start, score falling): the first one is the seed, the others are tried
    by falling score against all that are kept; never more than five.
    """
    most = min(5, limit)
    kept = [0]
    for i in sorted(range(1, len(calls)), key=lambda i: -calls[i][0]):
        if len(kept) >= most:
            break
        if all(is_alternative(calls[k][1], calls[i][1]) for k in kept):
            kept.append(i)
    return sorted(kept, key=lambda i: -cds_bases(calls[i][1]))[:limit]


def ordered_introns(exons: list[tuple[int, int]], strand: int) -> list[tuple[int, int]]:
    """(donor, acceptor) of neighbouring exons in transcript order."""
    d, a = (1, 0) if strand == 1 else (0, 1)
    return [(x[d], y[a]) for x, y in zip(exons, exons[1:])]


def variant(primary: list[tuple[int, int]], alt: list[tuple[int, int]], strand: int) -> str:
    """Kind of an alternative transcript; exons are half-open and in transcript order.

    Several kinds at once are COMPLEX. A ValueError if the transcripts are equal or don't overlap.
    """
    span = lambda x: (min(s for s, _ in x), max(e for _, e in x))
    p_span, a_span = span(primary), span(alt)
    lo, hi = max(p_span[0], a_span[0]), min(p_span[1], a_span[1])
    if primary == alt or lo >= hi:
        raise ValueError("transcripts are equal or don't overlap")
    inside = (lambda i: i[0] >= lo and i[1] <= hi) if strand == 1 else (lambda i: i[0] <= hi and i[1] >= lo)
    mine, other = ([i for i in ordered_introns(x, strand) if inside(i)] for x in (primary, alt))
    five, three = (0, 1) if strand == 1 else (1, 0)
    kinds = set()
    if p_span[five] != a_span[five]:
        kinds.add("ALT_FIRST_EXON")
    if p_span[three] != a_span[three]:
        kinds.add("ALT_LAST_EXON")
    used = (set(), set())  # explained introns of the primary, of the alternative

    for whole, parts, w, q in ((mine, other, 0, 1), (other, mine, 1, 0)):
        joined = {}
        for x, y in zip(parts, parts[1:]):
            joined.setdefault((x[0], y[1]), []).append((x, y))
        for i in whole:
            for pair in joined.get(i, ()):
                kinds.add("EXON_SKIPPING")
                used[w].add(i)
                used[q].update(pair)

    for i in mine:
        if i in used[0]:
            continue
        for j in other:
            same = (i[0] == j[0], i[1] == j[1])
            if j in used[1] or same[0] == same[1]:
                continue
            if same[1]:
                kinds.add("ALT_5_SPLICE_SITE")
            else:
                ends = [k for k, at in (("ALT_FIRST_EXON", 0), ("ALT_LAST_EXON", -1)) if i == mine[at] or j == other[at]]
                if not kinds.intersection(ends):
                    kinds.add("ALT_3_SPLICE_SITE")
            used[0].add(i)
            used[1].add(j)

    if (set(mine) - set(other) - used[0]) or (set(other) - set(mine) - used[1]):
        kinds.add("INTRON_RETENTION")
    if not kinds:
        raise ValueError("the transcripts differ in no known way")
    return kinds.pop() if len(kinds) == 1 else "COMPLEX"
