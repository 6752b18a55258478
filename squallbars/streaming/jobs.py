"""Structured Streaming jobs: incremental bars, idempotent event intake, pre-event alerts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars.functions.times import ordered_rank
from squallbars.sources.merge_store import MergeStore

col = F.col


def read_ticks(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of the tick files of a folder, oldest first; the schema is declared from the stored files' footer."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.select(col("event_type").alias("ticker"), col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def hourly_bars(ticks: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Hourly OHLC per ticker with bounded lateness; state holds one row per open bar."""
    rank = ordered_rank("ts", "event_id")
    return (ticks.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "ticker")
            .agg(F.min_by("value", rank).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                 F.max_by("value", rank).alias("close"), F.count(F.lit(1)).alias("volume"))
            .select("ticker", col("window.start").alias("datetime"), "open", "high", "low", "close", "volume"))


def new_events(ticks: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the lateness."""
    return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def due_alerts(ticks: DataFrame, buckets: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """One alert per upcoming bucket when the stream reaches its due hour (stream-static join on the hour)."""
    hours = (ticks.withWatermark("ts", lateness).withColumn("time_to_check", F.date_trunc("hour", "ts"))
             .dropDuplicatesWithinWatermark(["time_to_check"]))
    return hours.select("time_to_check").join(buckets, "time_to_check")


def run_once(stream: DataFrame, store: MergeStore, checkpoint: str, mode: str = "append",
             change: Callable[[DataFrame], DataFrame] | None = None) -> list[dict]:
    """Process all available input in micro-batches, each merged into the store; returns the progress of every batch.

    A batch that is run again after a failure merges the same rows into the same keys, so nothing is stored twice, and there
    are no folders of batches to be compacted: a merge rewrites the partitions that it touches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store.merge(change(batch) if change else batch)

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    return [dict(p) if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
