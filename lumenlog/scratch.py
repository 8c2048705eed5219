"""Where jobs keep tables between steps: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's; a temporary one only in local mode (tests), where all tasks share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lumenlog-"))
    return context.getCheckpointDir().rstrip("/")


#: Rows of a batch that goes to a Python worker: rows are whole texts, and both sides hold two batches or so.
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession):
    """While a table is written, Python workers get ``MOST_ROWS`` rows at a time at most; the session's own setting comes back."""
    own = spark.conf.get(ROWS_A_BATCH)
    if 0 < int(own) <= MOST_ROWS:
        yield
        return
    spark.conf.set(ROWS_A_BATCH, MOST_ROWS)
    try:
        yield
    finally:
        spark.conf.set(ROWS_A_BATCH, own)


class Scratch:
    """Parquet tables of one job in the shared folder; reading one back cuts the lineage.

    A table survives lost executors, and each can be dropped once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path  # for drop()
        return kept

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
