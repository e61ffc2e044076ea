"""Event-time windows over a stream of events (event_type, ts, value): an extension, as the batch operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(events: DataFrame, length: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by window; events later than `late` after the newest don't count on a stream."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    sums = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeats of their id within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
