"""Sequence files as tables: FASTA, GenBank and EMBL, plain or compressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions import seq as Q


#: Where records of a FASTA file part.
FASTA_BREAK = "\n>"


def fasta_records(raw: DataFrame) -> DataFrame:
    """contig_ord, contig_id, seq of text rows split at ``FASTA_BREAK``; works on streams too."""
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\s*>", "")
    head = F.substring_index(body, "\n", 1)
    seq = F.regexp_replace(body.substr(F.length(head) + 1, F.length(body)), r"\s+", "")
    return raw.filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("contig_ord"), F.regexp_extract(head, r"^(\S*)", 1).alias("contig_id"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig_ord, contig_id, seq (as written, lines joined) of every record, in the order of the file.

    Records are split by Spark's text source where a line begins with ``>``; a record is one row.
    """
    return fasta_records(spark.read.option("lineSep", FASTA_BREAK).text(path))


def read_flat(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of a GenBank (``genbank``) or EMBL (``embl``) file, in the same columns.

    Records end at ``//``. The id is the version or accession, else the locus name.
    """
    raw = spark.read.option("lineSep", "\n//").text(path)
    body = F.regexp_replace("value", "\r", "")
    if kind == "genbank":
        start = r"(?m)^ORIGIN[^\n]*\n"
        ids = [r"(?m)^VERSION\s+(\S+)", r"(?m)^ACCESSION\s+(\S+)", r"(?m)^LOCUS\s+(\S+)"]
    else:
        start = r"(?m)^SQ   [^\n]*\n"
        ids = [r"(?m)^SV   (\S+)", r"(?m)^AC   ([^;\s]+)", r"(?m)^ID   ([^;\s]+)"]
    parts = F.split(body, start, 2)
    name = F.coalesce(*[F.nullif(F.regexp_extract(parts[0], i, 1), F.lit("")) for i in ids])
    seq = F.upper(F.regexp_replace(parts[1], r"[\s0-9]+", ""))
    return raw.filter(F.rlike("value", F.lit(start))).select(F.monotonically_increasing_id().alias("contig_ord"), name.alias("contig_id"), seq.alias("seq"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Records of a sequence file, its format told from the first characters."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    head = first[0][0] if first else ""
    if head.startswith("LOCUS"):
        return read_flat(spark, path, "genbank")
    if head.startswith("ID   "):
        return read_flat(spark, path, "embl")
    return read_fasta(spark, path)


def matched(records: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records whose contig_id is asked for, and the asked ids that no record has."""
    return records.join(asked, "contig_id", "left_semi"), asked.join(records.select("contig_id"), "contig_id", "left_anti").distinct()


def contigs(records: DataFrame, wanted: tuple[str, ...] | None = None, check: bool = True) -> DataFrame:
    """contig_ord, contig_id, seq, length: cleaned records, the last of those with one id.

    ``wanted`` are the ids to keep; a ValueError names those that aren't there.  With ``check`` an empty
    sequence or a letter outside the alphabet is an error where the row is computed.
    """
    if wanted is not None:
        asked = records.sparkSession.createDataFrame([(w,) for w in wanted], "contig_id string")
        found, missing = matched(records, F.broadcast(asked))
        absent = sorted(r[0] for r in missing.collect())  # of the command line's names
        if absent:
            raise ValueError(f"no such sequences: {', '.join(absent)}")
        records = found
    last = Window.partitionBy("contig_id").orderBy(F.desc("contig_ord"))
    once = records.withColumn("_r", F.row_number().over(last)).filter("_r = 1")
    seq = Q.checked("seq") if check else F.upper("seq")
    return once.select("contig_ord", "contig_id", seq.alias("seq"), F.length("seq").alias("length"))


def sizes(records: DataFrame, length: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """Bases and number of records, those of repeated ids too, of all or of each group."""
    return records.groupBy(*group).agg(F.sum(length).alias("bases"), F.count(F.lit(1)).alias("contigs"))


def genome_bases(records: DataFrame) -> int:
    return sizes(records, F.length("seq")).first()["bases"] or 0
