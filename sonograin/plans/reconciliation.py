"""The whole way from evidence of two sources to canonical events; nothing is written, so every run is a dry run until its result is stored."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import with_match_text
from ..operators import decisions, identity, reconcile
from .storage import stored


class Reconciled(NamedTuple):
    resolutions: DataFrame
    duplicates: DataFrame
    pairs: DataFrame
    scores: DataFrame
    decided: DataFrame
    events: DataFrame
    links: DataFrame


def evidence_records(plays: DataFrame, scrobbles: DataFrame) -> DataFrame:
    """record_id, artist, track, album and strong identifiers of both sources; identifiers of different kinds never meet."""
    none = F.lit(None).cast("string")
    p = plays.select("record_id", "artist", "track", "album", none.alias("artist_mbid"), F.concat(F.lit("uri:"), "track_uri").alias("recording_id"), none.alias("release_mbid"))
    s = scrobbles.select("record_id", "artist", "track", "album", "artist_mbid", F.concat(F.lit("mbid:"), "recording_mbid").alias("recording_id"), none.alias("release_mbid"))
    return p.unionByName(s)


def duplicates_of(plays: DataFrame, scrobbles: DataFrame, same_play: list[str], same_scrobble: list[str]) -> DataFrame:
    """source, record_id, keeper of the records that repeat another one."""
    each = ((plays, "interval", same_play), (scrobbles, "instant", same_scrobble))
    p, s = (reconcile.keepers(r, *same).where("not is_keeper").select(F.lit(name).alias("source"), "record_id", "keeper") for r, name, same in each)
    return p.unionByName(s)


def candidates(plays: DataFrame, scrobbles: DataFrame, same_play: list[str], same_scrobble: list[str], window_ms: int = reconcile.WINDOW_MS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(resolutions, plays and scrobbles without exact duplicates and with names and entities, pairs)."""
    resolutions = stored(identity.resolved(evidence_records(plays, scrobbles)))
    entities = resolutions.select("record_id", "artist_id", "track_id", "kind")
    keep = lambda r, same: reconcile.keepers(r, *same).where("is_keeper").drop("keeper", "is_keeper")
    named = lambda r: with_match_text(r, artist_key="artist", track_key="track", album_key="album").withColumn("has_album", F.col("album").isNotNull()).join(entities, "record_id")
    p, s = stored(named(keep(plays, same_play))), stored(named(keep(scrobbles, same_scrobble)))
    names = ["artist_id", "track_id", "artist_key", "track_key"]
    pairs = reconcile.candidate_pairs(p, s, reconcile.name_keys(p.select(names).unionByName(s.select(names)).distinct()), window_ms)
    return resolutions, p, s, pairs


def decided_events(p: DataFrame, s: DataFrame, pairs: DataFrame, duplicates: DataFrame, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scores, decisions, events, links) of records with names and entities, their pairs and their exact duplicates."""
    scores = stored(reconcile.scored(pairs, reconcile.nearest_independent(pairs)))
    # the policy never accepts one of several pairs of a record, so without manual decisions no claim meets another
    decided = scores.select("play_id", "scrobble_id", "decision", F.lit("automatic").alias("origin"), F.lit(False).alias("stale")) if manual is None else stored(decisions.arbitrated(scores, manual))
    events = reconcile.canonical_events(p, s, decided)
    return scores, decided, events, reconcile.event_links(events, duplicates, decided)


def reconciled(plays: DataFrame, scrobbles: DataFrame, same_play: list[str], same_scrobble: list[str], window_ms: int = reconcile.WINDOW_MS, manual: DataFrame | None = None) -> Reconciled:
    """Identities, exact duplicates, pairs, features, decisions (manual ones of play_id, scrobble_id, decision, ordinal first), events and their links to evidence."""
    resolutions, p, s, pairs = candidates(plays, scrobbles, same_play, same_scrobble, window_ms)
    pairs = stored(pairs)
    again = duplicates_of(plays, scrobbles, same_play, same_scrobble)
    return Reconciled(resolutions, again, pairs, *decided_events(p, s, pairs, again, manual))
