"""Streams of readers' events (an extension: batch results, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n: events (ts, event_type) in tumbling windows; later ones than ``late`` are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n")


def unlocks(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first event of each user and type within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])
