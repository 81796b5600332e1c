"""Annotation and training files as tables: GFF3/GTF, allow lists, splice tables, region texts, datafiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import seq as Q

#: Columns of an annotation row.
GFF = {"seqid": "string", "source": "string", "feature_type": "string", "start": "bigint", "end": "bigint", "score": "string", "strand": "string", "phase": "string", "attributes": "string"}


def gff_lines(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Annotation rows of text lines (``value``); comments and blank lines are skipped, what isn't there or no number is null."""
    c = F.split(F.regexp_replace("value", "[\\r\\n]+$", ""), "\t")
    data = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim(F.regexp_replace("value", "[\\r\\n\\t]", "")) != ""))
    return data.select(*keep, *[F.get(c, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(GFF.items())])


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows of a file, compressed or not.

    For files with faulty lines see ``operators.bad_rows``, which gives the reason for each.
    """
    return gff_lines(spark.read.text(path))


def allow_list(lines: DataFrame) -> DataFrame:
    """name: the first column without quotes, comments skipped, each once."""
    rows = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return rows.select(F.trim(F.replace(F.split("value", "\t")[0], F.lit('"'), F.lit(""))).alias("name")).distinct()


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    return allow_list(spark.read.text(path))


def splice_rows(lines: DataFrame) -> DataFrame:
    """Rows of a splice table with exons as arrays; ``reason`` is ``invalid_format`` for short lines, else null."""
    c = F.split("value", "\t")
    col = lambda i: F.get(c, F.lit(i))
    return lines.select(
        col(0).alias("name"), col(1).try_cast("int").alias("paralog"), col(2).alias("chrom"), col(3).alias("strand"),
        col(4).try_cast("bigint").alias("flank_start"), col(5).try_cast("bigint").alias("flank_end"),
        Q.int_list(col(6)).alias("exon_ends"), Q.int_list(col(7)).alias("exon_starts"),
        F.when(F.size(c) < 8, "invalid_format").alias("reason"),
    )


def read_splice_table(spark: SparkSession, path: str) -> DataFrame:
    return splice_rows(spark.read.text(path))


def region_rows(lines: DataFrame) -> DataFrame:
    """chrom, region_start, region_end, seq of lines ``chrom:start-end <tab> sequence``; names may hold colons and hyphens."""
    head = r"^(.*):(\d+)-(\d+)\t(.*)$"
    part = lambda i: F.regexp_extract("value", head, i)
    return lines.select(part(1).alias("chrom"), part(2).try_cast("bigint").alias("region_start"), part(3).try_cast("bigint").alias("region_end"), part(4).alias("seq"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return region_rows(spark.read.text(path))


def read_datafiles(spark: SparkSession, *paths: str) -> DataFrame:
    """Training records of parquet datafiles with the file that each comes from."""
    return spark.read.parquet(*paths).withColumn("file", F.input_file_name())
