"""Coverage of the evidence and data-quality checks; each check is a query for violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import DAY_MS, local_time


def by_year(records: DataFrame, instant: str, tz: str = "America/Chicago") -> DataFrame:
    """source, year, n."""
    return records.groupBy("source", F.year(local_time(F.col(instant), tz)).alias("year")).agg(F.count("*").alias("n"))


def observed_ranges(records: DataFrame, instant: str, *by: str) -> DataFrame:
    """The first and last instant and the number of records of each source, or of what ``by`` names."""
    return records.groupBy(*by or ("source",)).agg(F.min(instant).alias("first_ms"), F.max(instant).alias("last_ms"), F.count("*").alias("n"))


def duplicate_totals(records: DataFrame, *same: str) -> DataFrame:
    """duplicate_groups and extra_records of exact duplicates; zero without any."""
    g = records.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_records"))


def missing_fields(records: DataFrame, *fields: str) -> DataFrame:
    """field, missing, total, rate; all fields in one pass."""
    one = records.agg(F.count("*").alias("total"), *(F.sum(F.col(f).isNull().cast("long")).alias(f"m_{f}") for f in fields))
    rows = one.select("total", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"m_{f}"), F.lit(0)).alias("missing")) for f in fields))))
    return rows.select("field", "missing", "total", F.when(F.col("total") == 0, 0.0).otherwise(F.col("missing") / F.col("total")).alias("rate"))


def long_gaps(records: DataFrame, instant: str, days: int = 365) -> DataFrame:
    """source, from_ms, to_ms of silences of at least ``days`` exact days.

    Records are first reduced per source and month; gaps inside a month are found there (a window per month), those between
    months on the small table of months, so no task sees all records of a source.
    """
    month = F.date_trunc("month", F.timestamp_millis(instant))
    r = records.select("source", month.alias("month"), F.col(instant).alias("at"))
    # a gap of more than a month's days has its ends in two months
    inside = r.limit(0).select("source", F.col("at").alias("from_ms"), F.col("at").alias("to_ms")) if days > 31 else r.select("source", F.lag("at").over(Window.partitionBy("source", "month").orderBy("at")).alias("from_ms"), F.col("at").alias("to_ms"))
    months = r.groupBy("source", "month").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    between = months.select("source", F.lag("b").over(Window.partitionBy("source").orderBy("month")).alias("from_ms"), F.col("a").alias("to_ms"))
    return inside.unionByName(between).where(F.col("to_ms") - F.col("from_ms") >= days * DAY_MS)


def backing(events: DataFrame) -> DataFrame:
    """backing (interval_only, instant_only, both), n of canonical events with has_interval and has_instant."""
    kind = F.when(F.col("has_interval") & F.col("has_instant"), "both").when(F.col("has_interval"), "interval_only").otherwise("instant_only")
    return events.groupBy(kind.alias("backing")).agg(F.count("*").alias("n"))


def input_files(records: DataFrame) -> DataFrame:
    """source, file_sha256, records: the files that evidence comes from, in the order of source and hash."""
    return records.groupBy("source", "file_sha256").agg(F.count("*").alias("records")).orderBy("source", "file_sha256")


def unresolved(events: DataFrame) -> DataFrame:
    """events, unresolved, rate (0 without events)."""
    open_ = F.coalesce(F.sum((F.col("event_status") == "unresolved").cast("long")), F.lit(0)).alias("unresolved")
    return events.agg(F.count("*").alias("events"), open_).withColumn("rate", F.when(F.col("events") == 0, 0.0).otherwise(F.try_divide("unresolved", "events")))


def overlap_by_year(events: DataFrame, instant: str, tz: str = "America/Chicago") -> DataFrame:
    """year, n of the canonical events that both sources tell of."""
    return events.where("status = 'cross_source_reconciled'").groupBy(F.year(local_time(F.col(instant), tz)).alias("year")).agg(F.count("*").alias("n"))


def baseline_differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """metric, actual, expected where they differ or one is missing."""
    return actual.alias("a").join(expected.alias("e"), "metric", "full").select("metric", "actual", "expected").where(~F.col("actual").eqNullSafe(F.col("expected")))


def violations(**checks: DataFrame) -> DataFrame:
    """code, violations: the number of rows of each check."""
    return reduce(DataFrame.unionByName, (d.agg(F.lit(c).alias("code"), F.count("*").alias("violations")) for c, d in checks.items()))


def not_unique(t: DataFrame, *key: str) -> DataFrame:
    return t.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def outside(t: DataFrame, ok: Column) -> DataFrame:
    """Rows that break a rule; unknown counts as broken."""
    return t.where(~F.coalesce(ok, F.lit(False)))


def ordinal_gaps(records: DataFrame, file: str, ordinal: str) -> DataFrame:
    """Files whose ordinals don't run from 0 without gaps or repeats."""
    g = records.groupBy(file).agg(F.count("*").alias("n"), F.countDistinct(ordinal).alias("d"), F.min(ordinal).alias("a"), F.max(ordinal).alias("b"))
    return g.where((F.col("a") != 0) | (F.col("b") != F.col("n") - 1) | (F.col("d") != F.col("n")))


def page_faults(pages: DataFrame) -> DataFrame:
    """Pages (scope, page, per_page, total, total_pages, rows, now_playing) that contradict their own or the scope's metadata."""
    # aggregates joined back, not windows: a scope may hold most pages
    same = pages.groupBy(F.col("scope").alias("_scope")).agg(((F.min("total") == F.max("total")) & (F.min("per_page") == F.max("per_page"))).alias("steady"))
    again = pages.groupBy(F.col("scope").alias("_s"), F.col("page").alias("_p")).agg((F.count("*") > 1).alias("repeated"))
    p = pages.join(same, F.col("scope").eqNullSafe(F.col("_scope"))).join(again, F.col("scope").eqNullSafe(F.col("_s")) & F.col("page").eqNullSafe(F.col("_p"))).drop("_scope", "_s", "_p")
    due = F.when(F.col("page") < F.col("total_pages"), F.col("per_page")).otherwise(F.col("total") - (F.col("total_pages") - 1) * F.col("per_page"))
    ok = (F.col("total_pages") == F.ceil(F.col("total") / F.col("per_page"))) & F.col("steady") & ~F.col("repeated") & (F.col("rows") == due) & (F.col("now_playing") <= 1)
    return outside(p, ok).drop("steady", "repeated")


def outcome_totals(records: DataFrame) -> DataFrame:
    """source, accepted, duplicates (of accepted), excluded, rejected, total of records (source, kind, is_keeper), and a row for all with source null."""
    is_ = lambda k: F.col("kind") == k
    return records.rollup("source").agg(
        F.count_if(is_("accepted")).alias("accepted"), F.count_if(is_("accepted") & ~F.col("is_keeper")).alias("duplicates"),
        F.count_if(is_("excluded")).alias("excluded"), F.count_if(is_("rejected")).alias("rejected"), F.count("*").alias("total"),
    )


def merge_counts(events: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: duplicate_events and duplicate_links of exact duplicates (record_id, keeper), cross_events and cross_links of merged events."""
    d = duplicates.agg(F.countDistinct("keeper").alias("duplicate_events"), F.count("*").alias("duplicate_links"))
    x = events.where("status = 'cross_source_reconciled'").agg(F.countDistinct("event_id").alias("cross_events"), F.count("scrobble_id").alias("cross_links"))
    return d.crossJoin(x)  # one row each
