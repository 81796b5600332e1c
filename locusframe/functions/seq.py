"""Sequence algebra as column expressions: everything stays in the JVM.

Codons are cut out by one regular-expression pass, never by ``substring`` position by position, so
long sequences cost time in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe import schema as S


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(seq: Column | str) -> Column:
    """Upper case, letters for several bases as N; null stays null."""
    return F.translate(F.upper(_col(seq)), S.AMBIGUOUS, "N" * len(S.AMBIGUOUS))


def invalid_letters(seq: Column | str) -> Column:
    """The letters of a cleaned sequence outside ACGTN, each once, rising."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(clean(seq), F.lit("([^ACGTN])"), F.lit(1))))


def checked(seq: Column | str) -> Column:
    """The cleaned sequence; an error if it is empty or holds invalid letters."""
    bad = invalid_letters(seq)
    return (
        F.when(F.length(_col(seq)) == 0, F.raise_error(F.lit("empty sequence")))
        .when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("invalid letters: "), F.array_join(bad, ""))))
        .otherwise(clean(seq))
    )


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(_col(seq)), "ACGTN", "TGCAN")


def codons(seq: Column | str) -> Column:
    """Whole codons of frame 0."""
    return F.regexp_extract_all(_col(seq), F.lit("(?s)(...)"), F.lit(1))


def is_start(codon: Column | str) -> Column:
    return F.upper(F.substring(_col(codon), 1, 3)).isin(S.START_CODONS)


def ends_with_stop(seq: Column | str) -> Column:
    return F.upper(F.right(_col(seq), F.lit(3))).isin(S.STOP_CODONS)


def stop_count(seq: Column | str) -> Column:
    """In-frame stop codons."""
    return F.size(F.filter(codons(F.upper(_col(seq))), lambda c: c.isin(S.STOP_CODONS)))


def internal_stops(seq: Column | str) -> Column:
    """In-frame stop codons before the last codon of ``seq``; sequences under six bases have none.

    The last codon begins within the last three bases, so a trailing part of a codon hides none.
    """
    s = _col(seq)
    return F.when(F.length(s) < 6, 0).otherwise(stop_count(F.left(s, F.floor((F.length(s) - 1) / 3).cast("int") * 3)))


def training_digits(seq: Column | str) -> Column:
    """Letters as training digits 0 to 4; letters without a base are 0."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.upper(_col(seq)), letters, "".join(str(S.TRAINING_BASES.get(c, 0)) for c in letters))


def base_codes(seq: Column | str) -> Column:
    """A C G T as 0 to 3 and other letters as 4, one array element a base: the compact form of one-hot rows."""
    return F.transform(F.split(F.regexp_replace(F.translate(F.upper(_col(seq)), "ACGT", "0123"), "[^0123]", "4"), ""), lambda c: c.cast("tinyint"))


def one_hot(codes: Column | str, classes: int = 4) -> Column:
    """Codes as 0/1 rows; a code outside the classes is a row of zeros."""
    return F.transform(_col(codes), lambda c: F.array(*[(c == i).cast("tinyint") for i in range(classes)]))


def translated(seq: Column | str) -> Column:
    """Amino acids of the whole codons, X where a base is unknown."""
    digits = F.translate(F.upper(_col(seq)), S.BASE_ORDER, "0123")
    aminos = F.array(*[F.lit(a) for a in S.AMINO_ACIDS])
    return F.array_join(
        F.transform(
            codons(digits),
            lambda c: F.when(c.rlike("^[0-3]{3}$"), F.element_at(aminos, F.conv(c, 4, 10).cast("int") + 1)).otherwise(F.lit("X")),
        ),
        "",
    )


def protein(seq: Column | str, strict: bool = True) -> Column:
    """Protein of a complete CDS: starts with M, the stop left out.

    ``strict``: an error unless the length is a multiple of three, the first codon starts and only the
    last one stops. Else null in these cases.
    """
    s = F.upper(_col(seq))
    fault = (
        F.when(F.length(s) % 3 != 0, "length is no multiple of three")
        .when(~is_start(s), "no start codon")
        .when(~ends_with_stop(s), "no stop codon at the end")
        .when(stop_count(s) != 1, "stop codon inside")
    )
    whole = translated(s)
    good = F.concat(F.lit("M"), whole.substr(F.lit(2), F.length(whole) - 2))
    return F.when(fault.isNull(), good).otherwise(F.raise_error(fault) if strict else F.lit(None))


def int_list(text: Column | str) -> Column:
    """Whole numbers of a comma list; empty parts are left out, others that are no numbers become null."""
    return F.transform(F.filter(F.split(_col(text), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("bigint"))


def slice_between(text: Column | str, begin: Column, end: Column) -> Column:
    """Letters [begin, end) counted from 0; null if that reaches outside."""
    t = _col(text)
    return F.when((begin >= 0) & (end <= F.length(t)) & (begin <= end), t.substr(begin.cast("int") + 1, (end - begin).cast("int")))


def exon_pairs(starts: Column, ends: Column) -> Column:
    """Array of (start, end) in genome order."""
    return F.array_sort(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end"))))


def spliced(region: Column | str, region_start: Column | str, exons: Column, strand: Column | str) -> Column:
    """CDS of inclusive exons in genome order, in sense direction; null if an exon reaches outside."""
    r, first = _col(region), _col(region_start)
    parts = F.transform(exons, lambda x: slice_between(r, x["start"] - first, x["end"] - first + 1))
    joined = F.upper(F.array_join(parts, ""))
    return F.when((F.size(exons) > 0) & ~F.exists(parts, lambda p: p.isNull()), F.when(_col(strand) == "-", reverse_complement(joined)).otherwise(joined))


def downstream_triplet(region: Column | str, region_start: Column | str, exons: Column, strand: Column | str) -> Column:
    """The three bases after the CDS in sense direction; null outside the region."""
    r, first = _col(region), _col(region_start)
    after = F.element_at(exons, -1)["end"] - first + 1
    before = F.element_at(exons, 1)["start"] - first - 3
    plus = F.upper(slice_between(r, after, after + 3))
    minus = reverse_complement(F.upper(slice_between(r, before, before + 3)))
    return F.when(F.size(exons) > 0, F.when(_col(strand) == "-", minus).otherwise(plus))


def cds_reason(cds: Column | str, need_stop: bool = True, compat: bool = True) -> Column:
    """``valid``, ``valid_without_terminal_stop`` or why a CDS isn't valid.

    ``compat``: the codon before the terminal one isn't searched for stops, as the published rules have it.
    """
    s = _col(cds)
    inside = F.left(s, F.length(s) - 3)
    stops = internal_stops(inside) if compat else stop_count(inside)
    return (
        F.when(s.isNull() | (F.length(s) < 6), "too_short")
        .when(F.length(s) % 3 != 0, "not_divisible_by_3")
        .when(~is_start(s), "no_start_codon")
        .when(stops > 0, "internal_stops")
        .when(ends_with_stop(s), "valid")
        .otherwise("no_terminal_stop" if need_stop else "valid_without_terminal_stop")
    )


def padded(seq: Column | str, context: int) -> Column:
    """The sequence with half the context of N on either side."""
    return F.concat(F.lit("N" * (context // 2)), _col(seq), F.lit("N" * (context // 2)))
