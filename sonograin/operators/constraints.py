"""The rules of the stored tables, declared once and checked a table at a time.

Rules on rows of one table are counted in one aggregate over it, each unique key in one grouped pass, each reference in one anti
join with its parent's keys.  As in SQL a rule that is unknown for a row holds, and a key with a null part repeats nothing.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rules(NamedTuple):
    required: tuple[str, ...]
    checks: dict[str, str]
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, tuple[str, str]] = {}


def _one_of(column: str, *values) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


def _hash(column: str) -> str:
    return f"{column} rlike '^[0-9a-f]{{64}}$'"


def _part(column: str) -> str:
    return f"{column} between 0 and 1"


def _filled(*columns: str) -> dict[str, str]:
    return {f"{c}_filled": f"length({c}) > 0" for c in columns}


def _whole(*columns: str) -> dict[str, str]:
    return {f"{c}_not_negative": f"{c} >= 0" for c in columns}


# Tables, columns, states and kinds of the stored model, and what must hold of them.
RULES = {
    "ingest_run": Rules(
        ("id", "source_type", "status", "started_ms", "discovered_count", "accepted_count", "rejected_count", "unsupported_count"),
        {"status": _one_of("status", "running", "succeeded", "failed"), "completion": "(status = 'running') = (completed_ms is null)", **_whole("started_ms", "completed_ms", "discovered_count", "accepted_count", "rejected_count", "unsupported_count"),
         "run_counts": "status <> 'succeeded' or discovered_count = accepted_count + rejected_count + unsupported_count"},
        (("id",),),
    ),
    "source_file": Rules(
        ("id", "relative_path", "source_type", "byte_size", "content_sha256", "first_run_id", "last_run_id"),
        {**_filled("relative_path"), "relative": "substr(relative_path, 1, 1) <> '/'", "source_type": _one_of("source_type", "spotify_export", "lastfm_export"), "content_sha256": _hash("content_sha256"), **_whole("byte_size", "observed_start_ms", "observed_end_ms"), "observed_order": "observed_end_ms >= observed_start_ms"},
        (("id",), ("relative_path",), ("content_sha256",)), {"first_run_id": ("ingest_run", "id"), "last_run_id": ("ingest_run", "id")},
    ),
    "source_record": Rules(
        ("id", "source_kind", "run_id", "accepted_ms"), {"source_kind": _one_of("source_kind", "spotify", "lastfm"), **_whole("source_ordinal", "accepted_ms"), "file_and_ordinal": "(file_id is null) = (source_ordinal is null)"},
        (("id",), ("file_id", "source_ordinal")), {"run_id": ("ingest_run", "id"), "file_id": ("source_file", "id")},
    ),
    "interval_play": Rules(
        ("record_id", "stopped_ms", "ms_played", "track_uri", "artist", "track", "shuffle", "fingerprint"),
        {**_whole("stopped_ms", "ms_played", "offline_ms"), **_filled("track_uri", "artist", "track"), **{c: _one_of(c, 0, 1) for c in ("shuffle", "skipped", "offline")}, "fingerprint": _hash("fingerprint")},
        (("record_id",),), {"record_id": ("source_record", "id")},
    ),
    "instant_scrobble": Rules(
        ("record_id", "origin", "instant_ms", "artist", "track", "fingerprint"),
        {"origin": _one_of("origin", "export", "api"), **_whole("instant_ms"), **_filled("artist", "track"), "loved": _one_of("loved", 0, 1), "fingerprint": _hash("fingerprint"), "api_id": "origin = 'api' or api_id is null"},
        (("record_id",), ("fingerprint",), ("api_id",)), {"record_id": ("source_record", "id")},
    ),
    "rejected_record": Rules(
        ("id", "run_id", "source_kind", "error_code", "summary", "rejected_ms"), {"source_kind": _one_of("source_kind", "spotify", "lastfm"), **_filled("error_code", "summary"), **_whole("source_ordinal", "rejected_ms")},
        (("id",), ("run_id", "file_id", "source_ordinal", "error_code")), {"run_id": ("ingest_run", "id"), "file_id": ("source_file", "id")},
    ),
    "listening_event": Rules(
        ("id", "track_id", "time_basis", "event_status", "rule_version"),
        {"time_basis": _one_of("time_basis", "observed_start", "observed_end", "derived_start"), "event_status": _one_of("event_status", "current", "unresolved", "superseded"), **_whole("started_ms", "ended_ms", "listened_ms"), "has_time": "started_ms is not null or ended_ms is not null",
         "time_order": "ended_ms >= started_ms", "successor": "(event_status = 'superseded') = (superseded_by is not null)", "not_its_own": "superseded_by <> id"},
        (("id",),), {"superseded_by": ("listening_event", "id")},
    ),
    "candidate": Rules(
        ("id", "play_id", "scrobble_id", "artist_score", "track_score", "delta_ms", "ambiguity_score", "confidence", "rule_version", "state"),
        {"identifier": _one_of("identifier_agreement", 0, 1), **{c: _part(c) for c in ("artist_score", "track_score", "album_score", "duration_score", "ordering_score", "ambiguity_score", "confidence")},
         "state": _one_of("state", "pending", "auto_accepted", "auto_rejected", "manually_accepted", "manually_rejected", "superseded"), "resolution": "(state = 'pending') = (resolved_ms is null)", **_whole("resolved_ms")},
        (("id",), ("play_id", "scrobble_id", "rule_version")), {"play_id": ("interval_play", "record_id"), "scrobble_id": ("instant_scrobble", "record_id"), "supersedes": ("candidate", "id")},
    ),
    "event_source": Rules(
        ("event_id", "record_id", "role"), {"role": _one_of("role", "primary", "exact_duplicate", "cross_source_match", "manual"), "match_score": _part("match_score"), "match_has_candidate": "role <> 'cross_source_match' or candidate_id is not null"},
        (("event_id", "record_id"), ("record_id",)), {"event_id": ("listening_event", "id"), "record_id": ("source_record", "id"), "candidate_id": ("candidate", "id")},
    ),
    "genre_tag": Rules(("id", "tag_name", "normalized_tag", "tag_kind"), {**_filled("tag_name", "normalized_tag"), "tag_kind": _one_of("tag_kind", "raw", "curated")}, (("id",), ("normalized_tag", "tag_kind"))),
    "genre_mapping": Rules(
        ("id", "source_tag_id", "curated_tag_id", "mapping_version", "confidence", "rationale"), {"confidence": _part("confidence"), **_filled("rationale"), "two_tags": "source_tag_id <> curated_tag_id"},
        (("id",), ("source_tag_id", "curated_tag_id", "mapping_version")), {"source_tag_id": ("genre_tag", "id"), "curated_tag_id": ("genre_tag", "id")},
    ),
    "sync_cursor": Rules(
        ("id", "source_type", "scope_sha256", "boundary_ms", "updated_ms", "run_id"), {"source_type": _one_of("source_type", "lastfm_api"), "scope_sha256": _hash("scope_sha256"), **_whole("boundary_ms"), "updated": "updated_ms >= boundary_ms"},
        (("id",), ("source_type", "scope_sha256")), {"run_id": ("ingest_run", "id")},
    ),
}


def violations(tables: dict[str, DataFrame], rules: dict[str, Rules] = RULES) -> DataFrame:
    """table, rule, violations of every rule of the given tables; references to tables that are not given are left out.

    violations counts rows; of a repeated key all rows but one.  A table without rows breaks nothing.
    """
    out = []
    for name, t in tables.items():
        r = rules[name]
        counted = {f"{c}_required": f"{c} is not null" for c in r.required} | r.checks
        one = t.agg(*(F.count_if(~F.coalesce(F.expr(e), F.lit(True))).alias(f"c{i}") for i, e in enumerate(counted.values())))
        out.append(one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("table"), F.lit(rule).alias("rule"), F.col(f"c{i}").alias("violations")) for i, rule in enumerate(counted))))))
        for key in r.unique:
            again = t.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
            out.append(again.select(F.lit(name).alias("table"), F.lit("_".join(key) + "_unique").alias("rule"), "violations"))
        for column, (parent, key) in r.references.items():
            if parent in tables:
                known = tables[parent].select(F.col(key).alias("_key"))
                lost = t.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_key"), "left_anti").agg(F.count("*").alias("violations"))
                out.append(lost.select(F.lit(name).alias("table"), F.lit(f"{column}_known").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, out)


def findings(broken: DataFrame, deviations: DataFrame | None = None) -> DataFrame:
    """code, severity, n: an error for each rule that is broken, a warning for each deviation (metric, actual, expected) from a baseline, n the difference."""
    errors = broken.where("violations > 0").select(F.concat_ws(".", "table", "rule").alias("code"), F.lit("error").alias("severity"), F.col("violations").alias("n"))
    if deviations is None:
        return errors
    gap = F.abs(F.coalesce("actual", F.lit(0)) - F.coalesce("expected", F.lit(0)))
    return errors.unionByName(deviations.select(F.concat(F.lit("baseline."), "metric").alias("code"), F.lit("warning").alias("severity"), gap.alias("n")))
