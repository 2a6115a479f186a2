"""Streams: files of rollouts as they arrive, windows over event time, running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_trigger: int = 32) -> DataFrame:
    """Parquet files in the order in which they appear, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed(events: DataFrame, at: str, late: str, length: str, key: str, value: str) -> DataFrame:
    """``begin, key, n, total`` by tumbling window; rows later than ``late`` are left out."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("begin"), key, "n", "total")


def sessions(events: DataFrame, at: str, late: str, gap: str, key: str) -> DataFrame:
    """``begin, finish, key, n`` by sessions that end after ``gap`` without an event."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("s.start").alias("begin"), F.col("s.end").alias("finish"), key, "n")


def fresh(rollouts: DataFrame, at: str, late: str, identifier: str) -> DataFrame:
    """Each rollout once, with state no older than ``late``."""
    return rollouts.withWatermark(at, late).dropDuplicatesWithinWatermark([identifier])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is, written as Parquet; a later call goes on where this one ended."""
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path)
    query.awaitTermination()
    return query


def write_rollouts(frame: DataFrame, path: str, keep: int = 32) -> None:
    """Appends rollouts as one file and leaves the newest ``keep`` files; readers that began earlier have read the others."""
    frame.coalesce(1).write.mode("append").parquet(path)
    spark = frame.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for s in files.listStatus(at) if s.isFile() and s.getPath().getName().startswith("part-")]
    found.sort(key=lambda s: (s.getModificationTime(), s.getPath().getName()))
    for old in found[: max(0, len(found) - keep)]:
        files.delete(old.getPath(), False)
