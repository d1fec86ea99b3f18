"""Windowed counts and latest states, the same for a stream and for a batch.

A stream's time column is a timestamp with zone, as watermarks need; a batch's may be either kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..compat import safe_sum


def windowed(events: DataFrame, time: str, by: list[str], value: str, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows and sums for each window and key; on a stream, rows later than ``late`` are dropped and states freed."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return timed.groupBy(w, *by).agg(F.count("*").alias("n"), safe_sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with no gap as long as ``gap``."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *by, "n")


def first_of(events: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """One row for each key; on a stream within the lateness, without unbounded state."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)
