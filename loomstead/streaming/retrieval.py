"""Retrieval log as a stream, and change-driven re-indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "id long, memory_id string, query string, score double, timestamp timestamp"


def read_log(spark: SparkSession, path: str, schema: str = LOG, format: str = "parquet", files_per_trigger: int = 0) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def running_stats(log: DataFrame) -> DataFrame:
    """Count, mean score and last retrieval of each memory so far; for update or complete mode."""
    return log.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.max("timestamp").alias("last"))


def windowed_stats(log: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The same by event-time window; state older than the watermark is dropped."""
    window = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return log.withWatermark("timestamp", late).groupBy(window.alias("w"), "memory_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"))


def in_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run handle(batch, number) on each micro-batch; a batch is seen again after a failure, so handle must be idempotent."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
