"""From annotation rows to genes with flanks: the first half of the training pipeline.

Rows have seqid, feature_type, feat_start, feat_end (from 1, inclusive), strand and attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import attrs as A
from locusframe.functions import seq as Q
from locusframe.operators import intervals, training


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``parsed``, the parts of their attributes; region and CDS rows tell their separator differently."""
    text = F.col("attributes")
    return rows.withColumn("parsed", A.items(text, F.when(F.col("feature_type") == "region", A.region_separator(text)).otherwise(A.cds_separator(text))))


def cds_rows(rows: DataFrame, mitochondrial: DataFrame | None = None) -> DataFrame:
    """CDS rows with all coordinates outside mitochondrial contigs: those in ``mitochondrial`` (seqid) and those that a
    region row calls so."""
    whole = rows.filter(F.col("seqid").isNotNull() & F.col("feat_start").isNotNull() & F.col("feat_end").isNotNull() & F.col("strand").isNotNull())
    out = whole.filter((F.col("feature_type") == "region") & (F.lower(A.value(F.col("parsed"), "genome")) == "mitochondrion")).select("seqid")
    if mitochondrial is not None:
        out = out.union(mitochondrial.select("seqid"))
    return whole.filter("feature_type = 'CDS'").join(out.distinct(), "seqid", "left_anti")


def contig_sizes(cds: DataFrame) -> DataFrame:
    """contig_size as the furthest CDS end, pseudogenes and malformed rows counted too."""
    return cds.groupBy("seqid").agg(F.max("feat_end").alias("contig_size"))


def gene_extents(cds: DataFrame) -> DataFrame:
    """Genes (seqid, strand, name, exons, start, end) of sound CDS rows; the end is that of the last sorted row."""
    p = F.col("parsed")
    good = cds.filter(F.col("attributes").isNotNull() & ~A.malformed(p) & ~A.is_pseudo(p)).withColumn("name", A.gene_name(p)).filter("name is not null")
    genes = good.groupBy("seqid", "strand", "name").agg(F.array_sort(F.collect_list(F.struct(F.col("feat_start").alias("start"), F.col("feat_end").alias("end")))).alias("exons"))
    return genes.withColumn("start", F.element_at("exons", 1)["start"]).withColumn("end", F.element_at("exons", -1)["end"])


def flanked(genes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Genes with their neighbours on the strand and the flanks these leave them."""
    return intervals.flanks(intervals.neighbours(genes, ["seqid", "strand"], "start", "end", "name").join(sizes, "seqid"))


def splice_lines(genes: DataFrame) -> DataFrame:
    """Lines of the splice table for genes with enough flank: eight columns, lists with a trailing comma."""
    text = lambda f: F.concat(F.array_join(F.transform("exons", lambda e: e[f].cast("string")), ","), F.lit(","))
    name = F.replace("name", F.lit('"'), F.lit(""))
    return genes.filter(intervals.enough_flank()).select(F.concat_ws("\t", name, F.lit("0"), "seqid", "strand", F.col("flank_start").cast("string"), F.col("flank_end").cast("string"), text("end"), text("start")).alias("line"))


def training_records(genes: DataFrame, contigs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Validated records: name, chrom, strand, cds_start, cds_end, exons, seq, seq_start, reason, extended.

    The region with flanks is cut from the contig; genes whose region reaches outside have the reason
    ``no_region``.  Missing stops are repaired if they make up ``threshold`` of the faults.
    """
    rows = genes.filter(intervals.enough_flank()).join(contigs.select(F.col("contig_id").alias("seqid"), F.upper("seq").alias("_whole")), "seqid", "left")
    region = Q.slice_between("_whole", F.col("flank_start") - 1, F.col("flank_end"))
    rows = rows.select(F.replace("name", F.lit('"'), F.lit("")).alias("name"), F.col("seqid").alias("chrom"), "strand", F.col("flank_start").alias("cds_start"), F.col("flank_end").alias("cds_end"), "exons", region.alias("seq"), F.col("flank_start").alias("seq_start"))
    judged = training.extend_stops(rows, threshold)
    return judged.withColumn("reason", F.when(F.col("seq").isNull(), "no_region").otherwise(F.col("reason")))
