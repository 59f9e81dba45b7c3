"""Calendar columns of an instant in an explicit time zone; the host's zone never matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")
DAY_MS = 86_400_000


def local_time(instant_ms: Column, tz: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(instant_ms), tz)


def period_start(local: Column, grain: str) -> Column:
    return F.date_trunc(grain, local).cast("date")


def label(start: Column, grain: str) -> Column:
    """2024-03-10, 2024-W10, 2024-03, 2024-Q1 or 2024 for a period's first day; weeks are ISO weeks."""
    if grain == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), start).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(start).cast("string"), 2, "0"))
    if grain == "quarter":
        return F.concat(F.year(start).cast("string"), F.lit("-Q"), F.quarter(start).cast("string"))
    return F.date_format(start, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[grain])


def prior_year_label(text: Column, grain: str) -> Column:
    """The same label one year earlier: none for 29 February, and a week 53 that may not exist."""
    earlier = F.concat(F.lpad((F.substring(text, 1, 4).cast("int") - 1).cast("string"), 4, "0"), F.substring(text, 5, 10))
    return F.when(~text.endswith("-02-29"), earlier) if grain == "day" else earlier


def month_index(local: Column) -> Column:
    """Months since the year 0, so that window arithmetic is integer arithmetic."""
    return (F.year(local) * 12 + F.month(local) - 1).cast("int")


def window_start(month: Column, size: int) -> Column:
    """The first month of the window of ``size`` months, anchored at January 1970, that holds the month."""
    return (month - F.pmod(month - 1970 * 12, F.lit(size))).cast("int")


def month_label(month: Column) -> Column:
    return F.concat(F.lpad(F.floor(month / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.pmod(month, F.lit(12)) + 1).cast("string"), 2, "0"))


def iso_millis(ms: Column) -> Column:
    """2024-03-10T07:59:59.999Z; the session's zone must be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def capped_ratio(x: Column, y) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / y))
