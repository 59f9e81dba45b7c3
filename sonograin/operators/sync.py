"""Incremental synchronization: which window to fetch, the cursor, and appends that overlap safely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERLAP_MS = 5 * 60 * 1000


def sync_plan(scopes: DataFrame, cursors: DataFrame, evidence: DataFrame, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """scope, from_ms, to_ms, basis, advances for scopes (scope, explicit_from_ms, explicit_to_ms, initial_ms), cursors (scope, boundary_ms), evidence (scope, instant_ms).

    Explicit start, else cursor less the overlap, else the initial boundary, else the latest evidence less the overlap;
    never below 0.  A scope with none of them has basis 'none', one whose end lies before its start 'invalid_bounds'; neither
    is fetched.  An explicit start or end leaves the cursor alone.
    """
    latest = evidence.groupBy("scope").agg(F.max("instant_ms").alias("latest_ms"))
    s = scopes.join(cursors, "scope", "left").join(latest, "scope", "left")
    start = F.greatest(F.lit(0), F.coalesce("explicit_from_ms", F.col("boundary_ms") - overlap_ms, "initial_ms", F.col("latest_ms") - overlap_ms))
    start = F.when(F.coalesce("explicit_from_ms", "boundary_ms", "initial_ms", "latest_ms").isNotNull(), start)
    basis = F.when(F.col("explicit_from_ms").isNotNull(), "explicit").when(F.col("boundary_ms").isNotNull(), "cursor").when(F.col("initial_ms").isNotNull(), "initial").when(F.col("latest_ms").isNotNull(), "evidence").otherwise("none")
    basis = F.when(F.col("explicit_to_ms") < start, "invalid_bounds").otherwise(basis)
    return s.select("scope", start.alias("from_ms"), F.col("explicit_to_ms").alias("to_ms"), basis.alias("basis"), (F.col("explicit_from_ms").isNull() & F.col("explicit_to_ms").isNull()).alias("advances"))


def advanced_cursors(cursors: DataFrame, plan: DataFrame, fetched: DataFrame) -> DataFrame:
    """scope, boundary_ms after a run that succeeded: the latest fetched instant, not below the plan's start, and never back."""
    top = fetched.groupBy("scope").agg(F.max("instant_ms").alias("top_ms"))
    moved = plan.where("advances").join(top, "scope", "left").select("scope", F.greatest("top_ms", "from_ms").alias("to_ms"))
    return cursors.join(moved, "scope", "full").select("scope", F.greatest("boundary_ms", "to_ms").alias("boundary_ms"))


IDENTIFIERS = ["artist_mbid", "release_mbid", "recording_mbid"]


def append_plan(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming (scope, instant_ms, artist, track, album and identifiers) with outcome: existing, matched or inserted.

    existing: a stored record is equal in all of these; matched: exactly one stored record of this scope, instant, artist
    and track has no other identifier where both have one.  Repeated incoming rows count once.
    """
    keys, rest = ["scope", "instant_ms", "artist", "track"], ["album", *IDENTIFIERS]
    new = incoming.select(*keys, *rest).distinct()
    old = stored.select(*keys, *(F.col(c).alias(f"_{c}") for c in rest)).distinct()
    j = new.join(old.withColumn("_there", F.lit(True)), keys, "left")
    exact, agrees = F.col("_there"), F.col("_there")
    for c in rest:
        exact = exact & F.col(c).eqNullSafe(F.col(f"_{c}"))
    for c in IDENTIFIERS:
        agrees = agrees & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(True))
    g = j.groupBy(*keys, *rest).agg(F.count_if(exact).alias("exact"), F.count_if(agrees).alias("agree"))
    outcome = F.when(F.col("exact") > 0, "existing").when(F.col("agree") == 1, "matched").otherwise("inserted")
    return g.select(*keys, *rest, outcome.alias("outcome"))


def append_summary(outcomes: DataFrame, fetched: DataFrame) -> DataFrame:
    """scope, fetched, ignored (repeated within the fetch), existing, matched, inserted; one row per scope that fetched anything."""
    n = fetched.groupBy("scope").agg(F.count("*").alias("fetched"))
    o = outcomes.groupBy("scope").agg(F.count("*").alias("_own"), *(F.count_if(F.col("outcome") == k).alias(k) for k in ("existing", "matched", "inserted")))
    return n.join(o, "scope", "left").fillna(0).select("scope", "fetched", (F.col("fetched") - F.col("_own")).alias("ignored"), "existing", "matched", "inserted")
