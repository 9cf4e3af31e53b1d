"""Windowed activity over event streams, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def tumbling(events: DataFrame, key: str, size: str = "1 day", delay: str = "2 hours", time: str = "ts", slide: str | None = None) -> DataFrame:
    """(start, end, key, n): counts per window; with ``slide`` the windows overlap."""
    window = F.window(time, size) if slide is None else F.window(time, size, slide)
    out = _timed(events, time, delay).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def activity_sessions(events: DataFrame, key: str, gap: str = "6 hours", delay: str = "2 hours", time: str = "ts") -> DataFrame:
    """(key, start, end, n): sessions that close after ``gap`` without an event."""
    out = _timed(events, time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_content(rows: DataFrame, content: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose content was not seen before; with ``time`` only as long as the watermark reaches back."""
    hashed = rows.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    if time is None:
        return hashed.dropDuplicates(["content_hash"])
    return _timed(hashed, time, delay).dropDuplicatesWithinWatermark(["content_hash"])
