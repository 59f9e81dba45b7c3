"""Result envelopes, content digests and published datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank


def digest(rows: DataFrame) -> DataFrame:
    """One row: n and a SHA-256 of the rows as a multiset.

    Each row's SHA-256 is cut into four numbers of 64 bits that are summed up; the digest is over the number of rows and the
    sums.  Sums don't depend on order or partitions and are added up where the rows are, so nothing is collected.
    """
    h = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    lanes = [F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    total = h.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{i}") for i, x in enumerate(lanes)))
    return total.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(f"s{i}" for i in range(4))), 256).alias("digest"))


def population(events: DataFrame, fallback: str = "none") -> DataFrame:
    """One row: the distinct rule versions of the events in order, blank ones left out, or ``fallback``; the sources that back them; events with each known field."""
    known = [c for c in ("artist_id", "track_id", "listened_ms", "started_ms", "ended_ms") if c in events.columns]
    versions = F.array_sort(F.collect_set(F.when(~blank(F.col("rule_version")), F.col("rule_version"))))
    sources = F.array_compact(F.array(F.when(F.max("has_instant"), F.lit("instant")), F.when(F.max("has_interval"), F.lit("interval"))))
    one = events.agg(versions.alias("versions"), sources.alias("sources"), *(F.count(c).alias(c) for c in known))
    return one.select(F.when(F.size("versions") == 0, F.array(F.lit(fallback))).otherwise(F.col("versions")).alias("versions"), "sources", F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.col, known))).alias("coverage"))


def envelope(events: DataFrame, analysis: str, parameters: dict[str, str], tz: str) -> DataFrame:
    """One row describing an analysis' population: counts, half-open range, coverage and unresolved rate."""
    e = events.where(F.col("event_status").isin("current", "unresolved"))
    rate = lambda c: F.when(F.col("event_count") == 0, 0.0).otherwise(c / F.col("event_count"))
    one = e.agg(F.count("*").alias("event_count"), F.min("instant_ms").alias("start_ms"), (F.max("instant_ms") + 1).alias("end_ms"), F.count("listened_ms").alias("with_duration"), F.sum((F.col("event_status") == "unresolved").cast("long")).alias("unresolved"))
    return one.select(
        F.lit(analysis).alias("analysis"), F.lit("analytical-result-v2").alias("version"), F.lit(tz).alias("timezone"), F.to_json(F.create_map(*(F.lit(x) for kv in sorted(parameters.items()) for x in kv))).alias("parameters"),
        "event_count", "start_ms", "end_ms", rate(F.col("with_duration")).alias("duration_coverage"), rate(F.coalesce("unresolved", F.lit(0))).alias("unresolved_rate"),
    )


def envelope_faults(envelopes: DataFrame) -> DataFrame:
    """analysis, fault for envelopes (analysis, event_count, coverage_total, available, unresolved, unresolved_rate, start_ms, end_ms, as_of_ms).

    coverage: its total is not the event count; available: more than there are; rate: not unresolved / event_count (0 without
    events); range: a null range with events, or one without; order: the end before the start; as_of: before the end.
    """
    n = F.col("event_count")
    rate = F.when(n == 0, 0.0).otherwise(F.try_divide("unresolved", n))
    ranged = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    faults = {
        "coverage": ~F.col("coverage_total").eqNullSafe(n), "available": F.col("available") > n, "rate": ~rate.eqNullSafe(F.col("unresolved_rate")),
        "range": ranged != (n > 0), "order": F.col("end_ms") < F.col("start_ms"), "as_of": F.col("as_of_ms") < F.col("end_ms"),
    }
    return envelopes.select("analysis", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in faults.items())))).alias("fault"))


def count_differences(coverage_count: DataFrame, **counts: DataFrame) -> DataFrame:
    """analysis, event_count, coverage_count, agrees: each analysis' own one-row event_count against the canonical one."""
    rows = reduce(DataFrame.unionByName, (c.select(F.lit(a).alias("analysis"), "event_count") for a, c in counts.items()))
    one = coverage_count.select(F.col("event_count").alias("coverage_count"))
    return rows.crossJoin(F.broadcast(one)).withColumn("agrees", F.col("event_count").eqNullSafe(F.col("coverage_count")))  # one row


def publish(datasets: dict[str, DataFrame], state: DataFrame, path: str) -> DataFrame:
    """Write each dataset to path/name and return the manifest: dataset, n, digest, state_digest; the manifest is written last."""
    spark = state.sparkSession
    for name, d in datasets.items():
        d.write.parquet(f"{path}/{name}")
    rows = [digest(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("dataset"), "n", "digest") for name in datasets]
    manifest = reduce(DataFrame.unionByName, rows).crossJoin(digest(state).select(F.col("digest").alias("state_digest")))  # one row
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def verify(path: str, state: DataFrame, recomputed: dict[str, DataFrame] | None = None) -> DataFrame:
    """dataset, status of published datasets: invalid (content changed, or not what is computed now from the same state), stale (the state moved on) or valid."""
    spark = state.sparkSession
    manifest = spark.read.parquet(f"{path}/manifest")
    names = [r.dataset for r in manifest.select("dataset").collect()]  # one per analysis
    each = lambda rows, name: reduce(DataFrame.unionByName, (digest(d).select(F.lit(x).alias("dataset"), F.col("digest").alias(name)) for x, d in rows.items()))
    j = manifest.join(each({x: spark.read.parquet(f"{path}/{x}") for x in names}, "now"), "dataset").crossJoin(digest(state).select(F.col("digest").alias("state_now")))  # one row
    j = j.join(each(recomputed, "fresh"), "dataset", "left") if recomputed else j.withColumn("fresh", F.lit(None).cast("string"))
    stale = F.col("state_now") != F.col("state_digest")
    return j.select("dataset", F.when(F.col("now") != F.col("digest"), "invalid").when(stale, "stale").when(F.col("fresh") != F.col("digest"), "invalid").otherwise("valid").alias("status"))
