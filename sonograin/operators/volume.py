"""Listening volume by calendar period, zero-filled, with rolling and prior-year values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import label, local_time, period_start, prior_year_label

METRICS = ("play_count", "play_count_at_least_ms", "listened_ms")
_STEP = {"day": "1 day", "week": "7 day", "month": "1 month", "quarter": "3 month", "year": "1 year"}


def listening_volume(events: DataFrame, grain: str = "month", metric: str = "play_count", rolling: int = 1, minimum_ms: int = 30_000, include_unresolved: bool = True, start_ms: int | None = None, end_ms: int | None = None, tz: str = "America/Chicago") -> DataFrame:
    """period, value, rolling_value, prior_year_value, absolute_change, relative_change.

    Bounds come in pairs and are half-open; without them the axis runs from the first to the last event.  The prior-year
    value is null when that period had no event, even inside the axis.
    """
    e = events.where(F.col("event_status").isin("current", "unresolved") if include_unresolved else F.col("event_status") == "current")
    if start_ms is not None:
        e = e.where((F.col("instant_ms") >= start_ms) & (F.col("instant_ms") < end_ms))
    value = {
        "play_count": F.count("*"),
        "play_count_at_least_ms": F.sum(F.when(F.col("listened_ms") >= minimum_ms, 1)),
        "listened_ms": F.sum("listened_ms"),
    }[metric]
    at = period_start(local_time(F.col("instant_ms"), tz), grain)
    counted = e.groupBy(at.alias("start")).agg(value.alias("v"))
    if start_ms is None:
        ends = counted.agg(F.min("start").alias("a"), F.max("start").alias("b")).where("a is not null")
    else:
        edge = lambda ms: period_start(local_time(F.lit(ms), tz), grain)
        ends = events.sparkSession.range(1).select(edge(start_ms).alias("a"), edge(end_ms - 1).alias("b"))
    axis = ends.select(F.explode(F.expr(f"sequence(a, b, interval {_STEP[grain]})")).alias("start"))
    # from here on one row per period: a window over all of them is small
    rows = axis.join(counted, "start", "left").select("start", label(F.col("start"), grain).alias("period"), F.coalesce("v", F.lit(0)).alias("value"))
    rows = rows.withColumn("rolling_value", F.sum("value").over(Window.orderBy("start").rowsBetween(-(rolling - 1), 0)))
    before = counted.select(label(F.col("start"), grain).alias("_p"), F.col("v").alias("prior_year_value")).where("prior_year_value is not null")
    out = rows.join(before, prior_year_label(F.col("period"), grain) == F.col("_p"), "left")
    change = F.col("value") - F.col("prior_year_value")
    return out.select("period", "value", "rolling_value", "prior_year_value", change.alias("absolute_change"), F.when(F.col("prior_year_value") != 0, change / F.col("prior_year_value")).alias("relative_change"))
