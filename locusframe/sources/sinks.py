"""Results as files: GFF3, FASTA, score segments, splice tables, datafiles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import seq as Q


def _text(lines: DataFrame, order: list, path: str) -> None:
    """A folder of parts in the given order, sorted and written in parallel; put end to end they are one file."""
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)


GFF_ORDER = ["part", "ord", "gene", "row_no"]


def gff_lines(rows: DataFrame, contigs: DataFrame, mean_score: float | None = None) -> DataFrame:
    """Lines of a GFF3 file (``value``, sorted by GFF_ORDER): version, mean score, regions of contigs with genes, ``genes.gff_rows``."""
    with_genes = contigs.join(rows.select(F.col("seqid").alias("contig_id")).distinct(), "contig_id", "left_semi")
    heads = ["##gff-version 3.1.26"] + ([f"##mean-gene-score {mean_score:.3f}"] if mean_score is not None else [])
    spark = rows.sparkSession
    top = spark.createDataFrame([(0, i, "", 0, h) for i, h in enumerate(heads)], "part int, ord bigint, gene string, row_no bigint, value string")
    regions = with_genes.select(F.lit(1).alias("part"), F.col("contig_ord").alias("ord"), F.lit("").alias("gene"), F.lit(0).cast("bigint").alias("row_no"), F.concat(F.lit("##sequence-region "), "contig_id", F.lit(" 1 "), F.col("length").cast("string")).alias("value"))
    line = F.concat_ws("\t", "seqid", "source", "feature_type", F.col("start").cast("string"), F.col("end").cast("string"), "score", "strand", "phase", "attributes")
    body = rows.join(contigs.select(F.col("contig_id").alias("seqid"), "contig_ord"), "seqid").select(F.lit(2).alias("part"), F.col("contig_ord").alias("ord"), F.col("gene_id").alias("gene"), "row_no", line.alias("value"))
    return top.unionByName(regions).unionByName(body)


def write_gff(rows: DataFrame, contigs: DataFrame, path: str, mean_score: float | None = None) -> None:
    """GFF3 folder ``path``."""
    _text(gff_lines(rows, contigs, mean_score), GFF_ORDER, path)


def cds_of(transcripts: DataFrame, contigs: DataFrame) -> DataFrame:
    """gene_id, place, cds: exons put together in genome order, reversed on the other strand."""
    rows = transcripts.join(contigs.select("contig_id", "seq"), "contig_id")
    joined = F.array_join(F.transform(F.array_sort("exons"), lambda x: F.col("seq").substr(x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))), "")
    return rows.select("gene_id", "place", F.when(F.col("strand") == -1, Q.reverse_complement(joined)).otherwise(joined).alias("cds"))


def fasta_lines(cds: DataFrame, kind: str) -> DataFrame:
    """FASTA records (``value``) of ``cds`` or ``protein`` sequences, unwrapped; another kind is a ValueError."""
    if kind not in ("cds", "protein"):
        raise ValueError(f"unknown kind of sequences: {kind}")
    text: Column = F.col("cds") if kind == "cds" else Q.protein("cds")
    name = F.concat("gene_id", F.lit("_mRNA"), (F.col("place") + 1).cast("string"))
    return cds.select("gene_id", "place", F.concat(F.lit(">"), name, F.lit("\n"), text).alias("value"))


def write_fasta(cds: DataFrame, path: str, kind: str) -> None:
    """FASTA folder of ``fasta_lines``."""
    _text(fasta_lines(cds, kind), ["gene_id", "place"], path)


SEGMENT_ORDER = ["part", "track", "contig_id", "seg_start"]


def segment_lines(segments: DataFrame) -> DataFrame:
    """Rows track, contig_id, seg_start, seg_end, value (as ``value``, sorted by SEGMENT_ORDER) under a heat-map head line."""
    head = segments.sparkSession.createDataFrame([(0, "", "", 0, "#track graphType=heatmap")], "part int, track string, contig_id string, seg_start bigint, value string")
    line = F.concat_ws("\t", "track", F.col("contig_id").cast("string"), F.col("seg_start").cast("string"), F.col("seg_end").cast("string"), F.col("value").cast("string"))
    body = segments.select(F.lit(1).alias("part"), "track", F.col("contig_id").cast("string").alias("contig_id"), F.col("seg_start").cast("bigint").alias("seg_start"), line.alias("value"))
    return head.unionByName(body)


def write_segments(segments: DataFrame, path: str) -> None:
    """Folder of ``segment_lines``."""
    _text(segment_lines(segments), SEGMENT_ORDER, path)


def write_splice_table(lines: DataFrame, path: str) -> None:
    """Splice table lines (``line``) in parallel parts."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_datafile(records: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Training records as parquet."""
    records.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_chunks(points: DataFrame, path: str) -> None:
    """Windows and labels (``training.datapoints`` and ``chunk``) as parquet, a folder for each chunk."""
    points.repartition("chunk").sortWithinPartitions("chunk", "rec_id", "tile_no").write.mode("overwrite").partitionBy("chunk").parquet(path)


def write_validation(judged: DataFrame, path: str) -> None:
    """Under ``path``: table (the valid rows without their sequences), sequences (their regions as text lines), invalid (the others with reasons)."""
    valid = judged.filter("reason = 'valid'")
    valid.drop("seq").write.mode("overwrite").parquet(f"{path}/table")
    last = F.col("seq_start") + F.length("seq") - 1
    valid.select(F.concat("chrom", F.lit(":"), F.col("seq_start").cast("string"), F.lit("-"), last.cast("string"), F.lit("\t"), "seq").alias("value")).write.mode("overwrite").text(f"{path}/sequences")
    judged.filter("reason <> 'valid'").drop("seq").write.mode("overwrite").parquet(f"{path}/invalid")


def report(judged: DataFrame) -> str:
    """Counts and shares of validation reasons as text."""
    counts = {r["reason"]: r["n"] for r in judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}  # a handful of reasons
    total = sum(counts.values())
    lines = [f"entries\t{total}"] + [f"{k}\t{n}\t{n / total:.1%}" for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0] or ""))]
    return "\n".join(lines) + "\n"
