"""Incremental counts over a stream of events; the same functions give the same counts in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, key: str = "event_type") -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts per window and key; a stream drops events later than the watermark, a batch has none."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
