"""Sinks: an append log that survives replays, and a version table that refuses stale results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_log(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream to Parquet; the file sink's own log makes every batch appear exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_epoch(batch: DataFrame, epoch: int, folder: str) -> None:
    """One folder per micro-batch, overwritten when the batch is replayed."""
    batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def commit_results(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Results with (key, version, value); replays replace their own epoch only."""
    return (
        stream.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, folder))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_state(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every key."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("key").agg(F.max("version").alias("version"), F.max_by("value", F.struct("version", "epoch")).alias("value"))


def judge_results(results: DataFrame, expected: DataFrame) -> DataFrame:
    """applied when a result was computed for the key's current version, discarded otherwise.

    ``results`` (key, version, value), ``expected`` (key, current).
    """
    verdict = F.when(F.col("version") == F.col("current"), "applied").otherwise("discarded")
    return results.join(expected, "key", "left").withColumn("verdict", F.coalesce(verdict, F.lit("discarded")))
