"""Session helpers: a factory for stand-alone use and the place of the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "locusframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, Arrow transfer and UTC; cluster settings given elsewhere win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is named, a session on one machine gets a temporary one; a cluster is a ValueError, since
    executors couldn't read each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if of_context.isDefined():
        return of_context.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="locusframe_ckpt_")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that lost executors lose nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def write_once(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder, removed when the driver ends.

    For what is wide or read more than once: a checkpoint isn't compressed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; what the folder keeps is harmless
            return


def let_workers_import(spark: SparkSession) -> None:
    """Names this package's folder to Python workers, which don't see the driver's ``sys.path``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def workers(spark: SparkSession) -> int:
    """Tasks the cluster runs at once, at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)
