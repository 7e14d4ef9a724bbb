"""Event-time counts and values per window, for a stream or a bounded table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total) per window; rows later than ``late`` are left out of a stream's result."""
    frame = F.window("ts", length, slide) if slide else F.window("ts", length)
    sums = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
