"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import bpe, lookalike, overlap, packing, pieces, topn
from locusframe.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read_table(spark, sf_dir, "transcripts")
    return topn.top_n(calls, ["contig_id", "strand", "group_id"], "score", ["tx_start", "tx_end"], "call_id", 5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split_pairs(read_table(spark, sf_dir, "datafile"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "datafile")
    return overlap.report(records, overlap.cross_split_pairs(records))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_long(read_table(spark, sf_dir, "datafile"), read_table(spark, sf_dir, "model_configs"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_ids(read_table(spark, sf_dir, "documents"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(read_table(spark, sf_dir, "documents"))


def p8_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts in containers of four permitted sizes, none above 2,048."""
    return packing.pack_texts(read_table(spark, sf_dir, "documents"), (256, 512, 1024, 2048))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alikes(read_table(spark, sf_dir, "documents"))


def p9_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.skeletons(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_report, p4_found, p7_ids, p8_pack, p8_sizes, p9_found, p9_form)}
