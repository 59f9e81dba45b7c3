"""The five published datasets, each with its envelope: written and digested in one pass, committed as a bundle, verified later."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import coverage, eras, returns, volume
from . import envelope
from .storage import stored

# The schema version, and for each analysis its name, version, parameter schema, query version and definition.
SCHEMA = "analytical-result-v2"
ANALYSES = {
    "volume": ("listening_volume", "listening-volume-v1", "listening-volume-parameters-v1", "canonical-volume-v1", "Listening per calendar period, with rolling and prior-year values."),
    "artist-eras": ("artist_eras", "artist-era-v1", "artist-era-parameters-v1", "canonical-artist-era-v1", "Runs of windows in which an artist leads the listening."),
    "rediscovery": ("rediscovery", "rediscovery-v1", "rediscovery-parameters-v1", "canonical-rediscovery-v1", "Returns to an artist after a long absence, and what became of them."),
    "abandonment": ("abandonment", "abandonment-v1", "abandonment-parameters-v1", "canonical-abandonment-v1", "Artists that were listened to regularly and then no more."),
    "coverage": ("coverage", "coverage-v2", "coverage-parameters-v1", "canonical-analytical-base-v1", "Evidence by source and year."),
}
FIELDS = ("artist_id", "track_id", "listened_ms")


def full_envelope(events: DataFrame, name: str, parameters: dict, tz: str, identity_rules: list[str], fallback: str = "none") -> DataFrame:
    """One row that says what an analysis looked at.

    events: event_status, instant_ms, has_interval, has_instant, rule_version and the known FIELDS.  The range is half-open and null
    without events, and the result holds as of its end; coverage has, for each field, the events that have it, their rate and all events.
    """
    analysis, version, parameter_schema, query, definition = ANALYSES[name]
    e = events.where(F.col("event_status").isin("current", "unresolved"))
    count = F.count("*")
    rate = lambda part: F.when(F.col("event_count") == 0, 0.0).otherwise(part / F.col("event_count"))
    rules = F.array_sort(F.collect_set(F.when(F.trim("rule_version") != "", F.col("rule_version"))))
    one = e.agg(
        count.alias("event_count"), F.min("instant_ms").alias("start_ms"), (F.max("instant_ms") + 1).alias("end_ms"), F.coalesce(F.sum((F.col("event_status") == "unresolved").cast("long")), F.lit(0)).alias("unresolved"), rules.alias("rules"),
        F.array_compact(F.array(F.when(F.max("has_instant"), F.lit("instant")), F.when(F.max("has_interval"), F.lit("interval")))).alias("sources"), *(F.count(f).alias(f) for f in FIELDS),
    )
    known = F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*(F.struct(F.col(f).alias("available"), rate(F.col(f)).alias("rate"), F.col("event_count").alias("total")) for f in FIELDS)))
    versions = F.struct(F.lit(version).alias("analysis"), F.lit(parameter_schema).alias("parameter_schema"), F.lit(query).alias("query"), F.array(*map(F.lit, sorted(set(identity_rules)))).alias("identity_rules"), F.when(F.size("rules") == 0, F.array(F.lit(fallback))).otherwise(F.col("rules")).alias("reconciliation_rules"))
    stated = F.to_json(F.create_map(*(F.lit(str(x)) for kv in sorted(parameters.items()) for x in kv))) if parameters else F.lit("{}")
    return one.select(
        F.lit(name).alias("dataset"), F.lit(analysis).alias("analysis"), F.lit(SCHEMA).alias("schema_version"), F.lit(definition).alias("definition"), F.lit(tz).alias("timezone"), stated.alias("parameters"),
        "event_count", "start_ms", "end_ms", F.col("end_ms").alias("as_of_ms"), "sources", known.alias("coverage"), "unresolved", rate(F.col("unresolved")).alias("unresolved_rate"), versions.alias("versions"),
    )


class Analyses(NamedTuple):
    datasets: dict[str, DataFrame]
    envelopes: DataFrame


def analyses(events: DataFrame, evidence: DataFrame, tz: str, identity_rules: list[str]) -> Analyses:
    """The five datasets with their production parameters out of events, and of evidence (source, at_ms) for coverage."""
    found = eras.era_intervals(eras.era_windows(events, tz=tz)).drop("evidence")
    datasets = {
        "volume": volume.listening_volume(events, "month", "play_count", 12, tz=tz),
        "artist-eras": found,
        "rediscovery": returns.rediscoveries(events, found, "artist", tz=tz),
        "abandonment": returns.abandonments(events),
        "coverage": coverage.by_year(evidence, "at_ms", tz),
    }
    parameters = {"volume": {"grain": "month", "metric": "play_count", "rolling": 12}, "rediscovery": {"scope": "artist"}}
    rows = [full_envelope(events, n, parameters.get(n, {}), tz, identity_rules) for n in datasets]
    return Analyses(datasets, reduce(DataFrame.unionByName, rows))


def _lanes(columns: list[str]) -> list[Column]:
    """The sums that ``envelope.digest`` is made of, as aggregates."""
    h = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return [F.coalesce(F.sum(F.conv(F.substring(h, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)]


def written(rows: DataFrame, path: str) -> tuple[int, list[str]]:
    """Write rows to path; their number and the four sums of their hashes, observed while they are written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n"), *_lanes(rows.columns)).write.parquet(path)
    got = seen.get
    return got["n"], [str(int(got[f"s{i}"])) for i in range(4)]


def publish(found: Analyses, state: DataFrame, path: str, version: int) -> DataFrame:
    """Write a bundle to path/bundle-<version> and return its manifest: dataset, n, digest, state_digest.

    Every dataset is read once, by the write that also digests it.  The manifest comes last: a bundle without one does
    not count, so a failed run leaves the newest whole bundle in force.
    """
    spark, bundle = state.sparkSession, f"{path}/bundle-{version:012d}"
    rows = []
    for name, d in [*found.datasets.items(), ("envelopes", found.envelopes)]:
        n, sums = written(d, f"{bundle}/{name}")
        rows.append((name, n, sums))
    of = spark.createDataFrame(rows, "dataset string, n long, sums array<string>")  # six rows
    digest = F.sha2(F.concat_ws(":", F.col("n").cast("string"), "sums"), 256)
    manifest = of.select("dataset", "n", digest.alias("digest")).crossJoin(envelope.digest(state).select(F.col("digest").alias("state_digest")))
    stored(manifest).coalesce(1).write.parquet(f"{bundle}/manifest")
    return spark.read.parquet(f"{bundle}/manifest")


def newest(spark, path: str) -> str:
    """The newest bundle under path that has a manifest."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().startswith("bundle-"))
    whole = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{n}/manifest/_SUCCESS"))]
    if not whole:
        raise ValueError("no bundle with a manifest")
    return whole[-1]


def verify(path: str, state: DataFrame, fresh: Analyses | None = None) -> DataFrame:
    """dataset, status of the newest bundle: invalid (its content changed, or is not what the same state gives now), stale (the state moved on) or valid."""
    recomputed = {**fresh.datasets, "envelopes": fresh.envelopes} if fresh else None
    return envelope.verify(newest(state.sparkSession, path), state, recomputed)
