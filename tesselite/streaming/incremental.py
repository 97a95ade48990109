"""Incremental reads with a position per stream, as batches and as Structured Streaming.

A position is a stream's high-water mark and the ids seen within a lookback of it. A cycle reads what is younger than
the mark less the lookback and wasn't seen; the new positions are committed only after the cycle's output is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITION = "stream string, high timestamp, seen array<string>, missing boolean"


def unseen(rows: DataFrame, positions: DataFrame, stream: str, id_: str, at: str, lookback_s: int, initial=None) -> DataFrame:
    """Rows of a cycle: late ones within the lookback are read once, older ones never. A stream without a position
    begins at ``initial`` (a timestamp), or with its first row."""
    p = positions.select(F.col("stream").alias("__stream"), "high", "seen")
    j = rows.join(p, F.col(stream).cast("string") == F.col("__stream"), "left")
    start = F.coalesce(F.col("high") - F.make_dt_interval(secs=F.lit(lookback_s)), F.lit(initial).cast("timestamp") if initial is not None else F.lit(None).cast("timestamp"))
    fresh = start.isNull() | (F.col(at) >= start)
    known = F.coalesce(F.array_contains("seen", F.col(id_).cast("string")), F.lit(False))
    return j.where(fresh & ~known).select(*rows.columns)


def advance(rows: DataFrame, positions: DataFrame, stream: str, id_: str, at: str, lookback_s: int) -> DataFrame:
    """Positions after a cycle that read rows; streams that it didn't touch keep theirs."""
    new = rows.groupBy(F.col(stream).cast("string").alias("stream")).agg(F.max(at).cast("timestamp").alias("h"))
    both = positions.select("stream", F.col("high").alias("h")).unionByName(new).groupBy("stream").agg(F.max("h").alias("high"))
    ids = rows.select(F.col(stream).cast("string").alias("s"), F.struct(F.col(at).cast("timestamp").alias("at"), F.col(id_).cast("string").alias("id")).alias("x"))
    kept = ids.join(both, F.col("s") == F.col("stream")).where(F.col("x.at") >= F.col("high") - F.make_dt_interval(secs=F.lit(lookback_s)))
    seen = kept.groupBy("s").agg(F.collect_set("x.id").alias("now"))
    old = positions.select(F.col("stream").alias("o"), F.col("high").alias("before"), F.col("seen").alias("then"))
    out = both.join(seen, F.col("stream") == F.col("s"), "left").join(old, F.col("stream") == F.col("o"), "left")
    none = F.array().cast("array<string>")
    same = F.when(F.col("before") >= F.col("high") - F.make_dt_interval(secs=F.lit(lookback_s)), F.coalesce("then", none)).otherwise(none)
    return out.select("stream", "high", F.array_sort(F.array_union(F.coalesce("now", none), same)).alias("seen"), F.lit(False).alias("missing"))


def mark_missing(positions: DataFrame, listed: DataFrame, stream: str) -> DataFrame:
    """Streams that aren't listed any more are marked and keep their position."""
    now = listed.select(F.col(stream).cast("string").alias("l")).distinct()
    return positions.join(now, F.col("stream") == F.col("l"), "left").select("stream", "high", "seen", F.col("l").isNull().alias("missing"))


def reset(positions: DataFrame, streams: list[str] | None = None) -> DataFrame:
    return positions.where("false") if streams is None else positions.where(~F.col("stream").isin(streams))


class PositionStore:
    """Positions as a table of generations in a folder; a commit is one new generation, so a failed cycle leaves the
    last one in force."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _generations(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def load(self) -> DataFrame:
        found = self._generations()
        if not found:
            return self.spark.createDataFrame([], POSITION)
        return self.spark.read.schema(POSITION).parquet(f"{self.folder}/{found[-1]}")

    def commit(self, positions: DataFrame) -> None:
        found = self._generations()
        positions.write.mode("overwrite").parquet(f"{self.folder}/{(found[-1] if found else 0) + 1}")


def cycle(store: PositionStore, rows: DataFrame, write: Callable[[DataFrame], None], stream: str, id_: str, at: str, lookback_s: int = 3600, initial=None) -> None:
    """One incremental read: positions move only after ``write`` came back."""
    positions = store.load()
    fresh = unseen(rows, positions, stream, id_, at, lookback_s, initial)
    write(fresh)
    store.commit(advance(fresh, positions, stream, id_, at, lookback_s))


def latest_stream(stream: DataFrame, key: str, at: str, folder: str, checkpoint: str):
    """A stream kept as the latest row per key, upserted each micro-batch into generations of a folder."""
    spark = stream.sparkSession

    def upsert(batch: DataFrame, epoch: int) -> None:
        old = [batch] if epoch == 0 else [batch, spark.read.schema(batch.schema).parquet(f"{folder}/{epoch - 1}")]
        union = old[0] if len(old) == 1 else old[0].unionByName(old[1])
        newest = union.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("__k = 1").drop("__k")
        newest.write.mode("overwrite").parquet(f"{folder}/{epoch}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).outputMode("append")


def distinct_stream(stream: DataFrame, keys: list[str], at: str, lookback: str = "1 hour") -> DataFrame:
    """Repeats within the lookback are dropped; state is bounded by the watermark."""
    return stream.withWatermark(at, lookback).dropDuplicatesWithinWatermark(keys)
