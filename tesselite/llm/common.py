"""Shared helpers of the corpus operators: reading, scratch tables, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small tables are broadcast only up to this many rows; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Spark's setting (4.1 on) by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the cluster's shared spark.checkpoint.dir. Where that is unset, a local one serves a local
    master only: executors of a cluster would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/tesselite/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later uses neither recompute it nor
    depend on the executors that made it. Spark deletes the shuffle files behind it once it is written."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of one operator in the shared folder: written once, reread, and deleted once nothing needs them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.paths = spark, scratch(spark, tag), {}

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}-{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables whose successors are written, and let Spark delete the shuffle files behind them."""
        for df in tables:
            path, _ = self.paths[id(df)]
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so when the objects that
    stand for them are collected, which otherwise happens at no set time. Called a few times an operator, where
    large shuffles lie behind."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def trim() -> None:
    """Give memory that this Python process no longer uses back to the system: workers outlive their tasks, and the driver
    outlives the fitting of models."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(spark: SparkSession, size: int = 4_000_000) -> None:
    """Limit batches that go to Python by bytes, not only by rows: texts may be very long."""
    with contextlib.suppress(Exception):  # a setting of Spark 4.1 on
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def mkdirs(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def attach(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Join a table that is usually small. It is broadcast only if its counted rows are within
    BROADCAST_ROWS; otherwise a shuffled join (whose hot keys adaptive execution splits) is used."""
    n = small.count() if rows is None else rows
    return df.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, keys, how)


def text_of(column: str = "text"):
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
