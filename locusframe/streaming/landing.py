"""A landing folder of FASTA files, predicted file by file as they arrive (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from locusframe import pipeline
from locusframe.params import Params
from locusframe.sources import fasta


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, params: Params, make_scorer: Callable | None = None, once: bool = True) -> StreamingQuery:
    """Starts a query that writes the genes of every new file's contigs as parquet under ``out``.

    Each micro-batch is written under its own number, so that a repeated batch replaces itself.
    """
    stream = spark.readStream.option("lineSep", fasta.FASTA_BREAK).schema("value string").text(folder)

    def each(batch: DataFrame, number: int) -> None:
        rows = fasta.fasta_records(batch)
        if rows.limit(1).count():
            found = pipeline.predict(fasta.contigs(rows), params, make_scorer)
            found.genes.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
