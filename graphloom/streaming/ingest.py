"""Streamed events as run counts: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_counts(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(started_at, event_type, n) of a stream of (ts, event_type); rows later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("started_at"), "event_type", "n")


def run_to(counts: DataFrame, path: str, checkpoint: str):
    """Append finished windows to Parquet; stops once what is there has been read."""
    return counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
