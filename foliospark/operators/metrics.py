"""Operational metrics over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def duration_series(events: DataFrame, key: str, value: str, order: list[str], last: int = 512) -> DataFrame:
    """Per key: lifetime count, mean and maximum; nearest-rank p50 and p95 over the last ``last`` samples."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))
    recent = events.withColumn("_k", newest).where(F.col("_k") <= last).groupBy(key).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"))
    whole = events.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("longest"))
    return whole.join(recent, key)


def counters(events: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a, by b and in all, as grouping sets; the grouping id tells them apart."""
    return events.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


#: Length of the cells of time below, in the unit of the spans (an hour in microseconds).
GRAIN = 3_600_000_000


def _cell(t: str, grain: int) -> Column:
    return F.floor(F.col(t) / F.lit(grain)).cast("long").alias("_cell")


def in_flight(spans: DataFrame, key: str, grain: int = GRAIN) -> DataFrame:
    """(key, most): the most spans (start, stop) that are open at once; one that ends as another starts is closed. A span
    without an end or a start is left out.

    Edges of one time are added up before they move. Each cell of a key's time then has its own net change and peak, so a
    key of any number of spans is dealt out; only one row a cell (the time covered by ``grain``) meets in one task.
    """
    whole = spans.where(F.col("start").isNotNull() & F.col("stop").isNotNull())
    edges = whole.select(key, F.inline(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("t"), F.lit(-1).alias("d")))))
    net = edges.groupBy(key, _cell("t", grain), "t").agg(F.sum("d").alias("d"))
    inside = F.sum("d").over(Window.partitionBy(key, "_cell").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    cells = net.withColumn("_open", inside).groupBy(key, "_cell").agg(F.max("_open").alias("_peak"), F.sum("d").alias("_net"))
    before = F.coalesce(F.sum("_net").over(Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("_peak", before + F.col("_peak")).groupBy(key).agg(F.max("_peak").cast("long").alias("most"))


def busy(spans: DataFrame, key: str, length: Column, grain: int = GRAIN) -> DataFrame:
    """(key, busy): the length of the union of spans (start, stop); ``length`` is that of one span and adds up over
    parts. A span without an end or a start is left out.

    What a span adds lies beyond the furthest stop before it: that of earlier cells of its key's time, one row each, and
    that of earlier spans of its own cell.
    """
    whole = spans.where(F.col("start").isNotNull() & F.col("stop").isNotNull())
    longest = whole.groupBy(key, _cell("start", grain), "start").agg(F.max("stop").alias("stop"))
    cells = longest.groupBy(F.col(key).alias("_key"), F.col("_cell").alias("_at")).agg(F.max("stop").alias("_stop"))
    earlier = F.max("_stop").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    carried = cells.select("_key", "_at", earlier.alias("_carried"))
    near = F.max("stop").over(Window.partitionBy(key, "_cell").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    joined = longest.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_at")))
    start = F.greatest("start", near, "_carried")
    added = joined.select(key, start.alias("start"), F.greatest(F.col("stop"), start).alias("stop"))
    return added.groupBy(key).agg(F.sum(length).alias("busy"))


def over_limit(events: DataFrame, key: str, ts: str, limit: int, window: str = "1 minute") -> DataFrame:
    """(key, window start, n): tumbling windows with more events than the limit."""
    return events.groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")
