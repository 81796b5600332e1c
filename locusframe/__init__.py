"""locusframe: Spark-first analytics over scored sequences, genomic intervals and annotation tables."""

__version__ = "0.1.0"
