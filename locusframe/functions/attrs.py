"""Attribute columns of annotation tables as maps, and what the training pipeline reads from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(text: Column, separator: Column) -> Column:
    """key and value of each part between semicolons; value null where the separator is missing."""
    parts = F.split(F.regexp_replace(text, "^;+|;+$", ""), ";")
    return F.transform(parts, lambda p: F.struct(_before(F.trim(p), separator).alias("k"), _after(F.trim(p), separator).alias("v")))


def _before(p: Column, sep: Column) -> Column:
    at = F.call_function("instr", p, sep)
    return F.when(at > 0, p.substr(F.lit(1), at - 1))


def _after(p: Column, sep: Column) -> Column:
    at = F.call_function("instr", p, sep)
    return F.when(at > 0, p.substr(at + 1, F.length(p)))


def cds_separator(text: Column) -> Column:
    """CDS rows: ``=`` if the text speaks of a parent, else a space."""
    return F.when(F.contains(text, F.lit("Parent")), "=").otherwise(" ")


def region_separator(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("=")), "=").otherwise(" ")


def malformed(parsed: Column) -> Column:
    """Whether a part has no separator; such CDS rows are left out, such parts of region rows ignored."""
    return F.exists(parsed, lambda x: x["v"].isNull())


def value(parsed: Column, key: str) -> Column:
    """Value of the last part with this key."""
    return F.get(F.reverse(F.filter(parsed, lambda x: x["k"] == key)), F.lit(0))["v"]


def is_pseudo(parsed: Column) -> Column:
    return F.coalesce(value(parsed, "pseudo") == "true", F.lit(False)) | F.exists(parsed, lambda x: F.coalesce(x["k"] == "pseudogene", F.lit(False)))


def gene_name(parsed: Column) -> Column:
    """ID (its second part if hyphens split it), else name, Parent, or gene_id without quotes; null if none is there."""
    id_ = value(parsed, "ID")
    part = F.when(F.contains(id_, F.lit("-")), F.split(id_, "-")[1]).otherwise(id_)
    return F.coalesce(part, value(parsed, "name"), value(parsed, "Parent"), F.replace(value(parsed, "gene_id"), F.lit('"'), F.lit("")))
