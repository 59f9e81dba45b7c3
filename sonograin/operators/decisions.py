"""Manual decisions on candidate pairs and entities: validity, import, precedence, lineage and the review export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Rounds, stored

# The forms of decision ids, reason codes and content hashes, and the decision types.
ID_FORM, REASON_FORM, HASH_FORM = "^[a-z0-9][a-z0-9._-]{0,127}$", "^[a-z][a-z0-9_-]{0,63}$", "^[0-9a-f]{64}$"
TYPES = ("accept", "reject", "merge", "split", "alias")


def faults(decisions: DataFrame) -> DataFrame:
    """decision_id, fault of every unusable row of decision_id, type, reason_code, file_sha256, ordinal, alias; unknown counts as broken."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    size = F.length("alias")
    fault = (
        F.when(bad(F.col("decision_id").rlike(ID_FORM)), "decision_id").when(bad(F.col("type").isin(*TYPES)), "type").when(bad(F.col("reason_code").rlike(REASON_FORM)), "reason_code")
        .when(bad(F.col("file_sha256").rlike(HASH_FORM) & (F.col("ordinal") >= 0)), "reference").when((F.col("type") == "alias") & bad((size >= 1) & (size <= 500)), "alias")
    )
    rows = decisions.select("decision_id", fault.alias("fault")).where("fault is not null")
    return rows.unionByName(decisions.groupBy("decision_id").agg(F.count("*").alias("n")).where("n > 1").select("decision_id", F.lit("repeated_id").alias("fault")))


def import_plan(offered: DataFrame, known: DataFrame) -> DataFrame:
    """offered (decision_id, payload) with outcome: imported, already_applied (same payload) or conflict (other payload)."""
    k = known.select(F.col("decision_id").alias("_id"), F.col("payload").alias("_p"))
    outcome = F.when(F.col("_id").isNull(), "imported").when(F.col("_p").eqNullSafe(F.col("payload")), "already_applied").otherwise("conflict")
    return offered.join(k, offered["decision_id"] == k["_id"], "left").withColumn("outcome", outcome).drop("_id", "_p")


def with_manual(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """play_id, scrobble_id, decision, origin: manual accepts and rejects stand before automatic decisions on the same pair."""
    pair = ["play_id", "scrobble_id"]
    left = automatic.select(*pair, "decision").join(manual.select(*pair), pair, "left_anti").withColumn("origin", F.lit("automatic"))
    return left.unionByName(manual.select(*pair, "decision").withColumn("origin", F.lit("manual")))


def first_claims(claims: DataFrame, order: list[str], sides: list[str]) -> DataFrame:
    """The claims that hold when they are made one after another by ``order`` (a total order) and each needs its sides free.

    Claims that come first on all their sides hold; what shares a side with them falls; the rest is looked at again.  With
    one side this takes one round, with two as many as the longest chain of claims that wait for each other.
    """
    place, rounds = F.struct(*order), Rounds(claims.sparkSession)
    left, held = rounds.keep(claims), None
    while True:
        first = left
        for side in sides:
            least = left.groupBy(side).agg(F.min(place).alias("_first"))
            first = first.join(least, side).where(place == F.col("_first")).drop("_first")
        first = stored(first.select(*claims.columns)) if len(sides) > 1 else first.select(*claims.columns)
        held = first if held is None else held.unionByName(first)
        if len(sides) == 1:
            return held
        for side in sides:
            left = left.join(first.select(side), side, "left_anti")
        left = rounds.keep(left)
        if not left.take(1):
            return held


def arbitrated(automatic: DataFrame, manual: DataFrame | None = None, one_to_one: bool = False) -> DataFrame:
    """play_id, scrobble_id, decision, origin, stale per candidate pair: what holds of policy decisions and manual ones (play_id, scrobble_id, decision, ordinal).

    A manual decision stands in the place of the policy's on its pair.  Accepts are claims on a scrobble, manual ones first
    by ordinal, then those of the policy by pair; a scrobble goes to its first claim.  Later claims are stale: their evidence has
    moved, so they go to review and move nothing.  A play may take several scrobbles unless ``one_to_one``.  Manual decisions on
    pairs that are no candidates are not used; ``stale_references`` has them.
    """
    pair = ["play_id", "scrobble_id"]
    if manual is None:
        manual = automatic.select(*pair, "decision", F.lit(0).alias("ordinal")).limit(0)
    known = manual.join(automatic.select(*pair), pair, "left_semi")
    both = with_manual(automatic, known).join(known.groupBy(*pair).agg(F.min("ordinal").alias("ordinal")), pair, "left")
    both = stored(both.withColumn("ordinal", F.when(F.col("origin") == "manual", F.col("ordinal"))))
    # manual claims have an ordinal, which sorts after none
    claims = both.where("decision = 'accept'").select(*pair, F.col("ordinal").isNull().alias("later"), "ordinal")
    held = first_claims(claims, ["later", "ordinal", *pair], ["scrobble_id", "play_id"] if one_to_one else ["scrobble_id"]).select(*pair, F.lit(True).alias("_held"))
    stale = (F.col("decision") == "accept") & F.col("_held").isNull()
    j = both.join(held, pair, "left").withColumn("stale", stale)
    return j.select(*pair, F.when(F.col("stale"), "review").otherwise(F.col("decision")).alias("decision"), "origin", "stale")


def stale_references(manual: DataFrame, candidates: DataFrame) -> DataFrame:
    """Manual decisions on pairs that are no candidates."""
    return manual.join(candidates.select("play_id", "scrobble_id"), ["play_id", "scrobble_id"], "left_anti")


def superseded(prior: DataFrame, replacing: DataFrame, version: str) -> DataFrame:
    """The history of decisions after a new policy version: play_id, scrobble_id, version, decision, state, superseded_by.

    An active prior decision on a pair that is decided anew becomes superseded; pairs that are not decided anew keep it.
    Events are derived from active decisions only, so what an earlier accept had merged comes apart again by itself.
    """
    pair = ["play_id", "scrobble_id"]
    now = replacing.select(*pair).distinct().withColumn("_new", F.lit(True))
    over = F.col("_new") & (F.col("state") == "active")
    old = prior.select(*pair, "version", "decision", "state", "superseded_by").join(now, pair, "left")
    old = old.select(*pair, "version", "decision", F.when(over, "superseded").otherwise(F.col("state")).alias("state"), F.when(over, version).otherwise(F.col("superseded_by")).alias("superseded_by"))
    return old.unionByName(replacing.select(*pair, F.lit(version).alias("version"), "decision", F.lit("active").alias("state"), F.lit(None).cast("string").alias("superseded_by")))


def lineage_faults(history: DataFrame) -> DataFrame:
    """play_id, scrobble_id, fault: pairs without exactly one active decision, and superseded ones that name no successor or themselves."""
    pair = ["play_id", "scrobble_id"]
    active = history.groupBy(*pair).agg(F.sum((F.col("state") == "active").cast("long")).alias("n")).where("n != 1").select(*pair, F.lit("active_count").alias("fault"))
    ok = F.when(F.col("state") == "active", F.col("superseded_by").isNull()).otherwise(F.coalesce(F.col("superseded_by") != F.col("version"), F.lit(False)))
    return active.unionByName(history.where(~F.coalesce(ok, F.lit(False))).select(*pair, F.lit("successor").alias("fault")))


def review_export(scored: DataFrame, references: DataFrame) -> DataFrame:
    """Every candidate with portable references of both records (record_id -> kind, file_sha256, ordinal), its decision and confidence."""
    r = lambda side: references.select(F.col("record_id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("kind", "file_sha256", "ordinal")))
    found = scored.join(r("play"), "play_id").join(r("scrobble"), "scrobble_id")
    return found.select("play_kind", "play_file_sha256", "play_ordinal", "scrobble_kind", "scrobble_file_sha256", "scrobble_ordinal", "decision", "confidence")


def referenced(decisions: DataFrame, references: DataFrame) -> DataFrame:
    """decisions with record_id, the record that (kind, file_sha256, ordinal) refers to; null where there is none."""
    known = references.select("kind", "file_sha256", "ordinal", "record_id").dropDuplicates(["kind", "file_sha256", "ordinal"])
    return decisions.join(known, ["kind", "file_sha256", "ordinal"], "left")
