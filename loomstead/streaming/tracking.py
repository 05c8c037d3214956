"""Retrieval tracking as keyed state: counts, running means and last retrievals that survive restarts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATS = "memory_id string, n long, avg_score double, last timestamp"
#: What a run needs: the store of keyed state that transformWithState asks for; and no batches without data, of which a processor with a time to live never has enough.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _tracker(keep_ms: int) -> StatefulProcessor:
    """A processor that travels with the query: workers need no installed copy of this module."""

    class Tracker(StatefulProcessor):
        """For each memory its count, running mean and last retrieval, and for a while the log ids that it was told by."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.stats = handle.getValueState("stats", "n long, mean double, last long")
            self.seen = handle.getMapState("seen", "id long", "told boolean", ttlDurationMs=keep_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            n, mean, last = self.stats.get() if self.stats.exists() else (0, None, None)
            fresh = False
            for row in sorted(rows, key=lambda r: (r["id"] is None, r["id"] or 0)):
                if row["id"] is not None:
                    if self.seen.containsKey((row["id"],)):
                        continue
                    self.seen.updateValue((row["id"],), (True,))
                fresh, n = True, n + 1
                if row["score"] is not None:
                    mean = row["score"] if mean is None else mean + (row["score"] - mean) / n
                if row["micros"] is not None and (last is None or row["micros"] > last):
                    last = row["micros"]
            if fresh:
                self.stats.update((n, mean, last))
                yield Row(memory_id=key[0], n=n, avg_score=mean, micros=last)

        def close(self) -> None:
            pass

    return Tracker()


def track(log: DataFrame, keep_ids_days: float = 7) -> DataFrame:
    """(memory_id, n, avg_score, last): a row for each memory that new rows of the log stream (id, memory_id, score, timestamp) change, as it is after them.

    State is keyed by memory, in RocksDB: the count, the running mean, the last
    retrieval, and the ids of log rows for keep_ids_days, so that a row that is
    delivered again within that time counts once. Rows without an id count
    always; rows without a memory are left out; a null score counts as a
    retrieval and leaves the mean; other columns are ignored.
    """
    rows = log.select(F.col("id").cast("long").alias("id"), F.col("memory_id").cast("string").alias("memory_id"), F.col("score").cast("double").alias("score"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"))
    named = rows.where("memory_id is not null")
    told = named.groupBy("memory_id").transformWithState(_tracker(int(keep_ids_days * 86_400_000)), "memory_id string, n long, avg_score double, micros long", "Update", "ProcessingTime")
    return told.select("memory_id", "n", "avg_score", F.timestamp_micros("micros").alias("last"))


def run_tracking(log: DataFrame, stats: str, checkpoint: str, keep_ids_days: float = 7) -> None:
    """Track all of the log that is there, and stop. stats and checkpoint are folders that all executors share.

    Each micro-batch writes the memories that it changed under its own number,
    so one that is run again after a failure writes the same files; a run that
    starts on the same checkpoint goes on where the last one stopped.
    """
    spark = log.sparkSession
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{stats}/batch={number}")
        writer = track(log, keep_ids_days).writeStream.outputMode("update").foreachBatch(put)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def tracked(spark: SparkSession, stats: str) -> DataFrame:
    """(memory_id, n, avg_score, last) of every memory, as the last batch that changed it left it."""
    rows = spark.read.schema(f"{STATS}, batch long").parquet(stats)
    return rows.groupBy("memory_id").agg(F.max_by(F.struct("n", "avg_score", "last"), "batch").alias("x")).select("memory_id", "x.*")
