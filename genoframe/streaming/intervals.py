"""Streaming forms of interval operators: islands of events as session windows, and windowed counts under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_islands(events: DataFrame, gap: str = "10 minutes", key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Islands (key, start, end, n) of events closer than ``gap``: merge with a gap, over a stream or a table with a ``ts`` column."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    by = x.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return by.select(key, "start", "end", "n")


def windowed_counts(events: DataFrame, width: str = "1 hour", step: str | None = None, key: str = "event_type", late: str = "1 hour") -> DataFrame:
    """(key, start, n, value) over tumbling or sliding windows."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return x.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(key, F.col("w.start").alias("start"), "n", "value")
