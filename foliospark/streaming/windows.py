"""Event-time windows with a bound on lateness; each works on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of a key's events in which each follows the last within ``gap``."""
    kind = events.schema[time].dataType
    n = _timed(events, time).withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return n.select(key, F.col("session_window.start").cast(kind).alias("start"), F.col("session_window.end").cast(kind).alias("end"), "n")


def sliding(events: DataFrame, key: str, time: str, size: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, n): counts of overlapping windows."""
    n = _timed(events, time).withWatermark(time, late).groupBy(key, F.window(time, size, slide)).agg(F.count("*").alias("n"))
    return n.select(key, F.col("window.start").cast(events.schema[time].dataType).alias("start"), "n")


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks want a timestamp with a zone; one without is taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp"))
