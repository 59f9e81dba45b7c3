"""Who a record is about: artist, track and release out of names and strong identifiers, by aggregations and joins.

All rules look at the whole set of records, so the result does not depend on the order of arrival; an entity is named by
the first record that tells of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_text, with_match_text
from ..plans.storage import stored
from .reconcile import merge_roots


def owners(records: DataFrame, identifier: str, entity: str = "record_id") -> DataFrame:
    """identifier, owner: the entity of the first record that carries a strong identifier."""
    return records.where(F.col(identifier).isNotNull()).groupBy(identifier).agg(F.min_by(entity, "record_id").alias("owner"))


def aliases(records: DataFrame, entity: str, display: str) -> DataFrame:
    """entity, alias, display, record_id: the first display form of each name (as match text) of each entity."""
    named = with_match_text(records.select(F.col(entity).alias("entity"), F.col(display).alias("display"), "record_id"), alias="display").where("alias is not null")
    return named.groupBy("entity", "alias").agg(F.min_by("display", "record_id").alias("display"), F.min("record_id").alias("record_id"))


def unique_aliases(known: DataFrame, alias: str = "alias", entity: str = "entity") -> DataFrame:
    """alias, entity of the names that one entity alone bears; a shared name tells nothing."""
    g = known.groupBy(alias).agg(F.min(entity).alias("entity"), F.max(entity).alias("_last"))
    return g.where(F.col("entity") == F.col("_last")).select(F.col(alias).alias("alias"), "entity")


def resolved(records: DataFrame, manual_aliases: DataFrame | None = None) -> DataFrame:
    """record_id, artist_id, track_id, release_id, kind, conflicts per record.

    records: record_id (unique), artist, track, album, artist_mbid, recording_id, release_mbid.  An artist is the owner of
    the strong identifier, else of a manual alias (alias, entity), else the only strongly known bearer of the name, else
    new under that name.  A track goes by its strong identifier, else by the only strongly known track of artist, title
    and album, else new under these.  The track's first record gives its artist and release; a null album gives none.
    Names without match text are never compared: each such record stands for itself.  conflicts holds
    (entity_type, strong_id, other_id).
    """
    named = with_match_text(records, artist_key="artist", track_key="track", album_key="album")
    r = stored(named.select("record_id", "artist_mbid", "recording_id", "release_mbid", F.col("album").isNotNull().alias("has_album"), "artist_key", "track_key", "album_key"))
    r = r.withColumn("name", F.when(F.col("track_key").isNotNull(), F.col("artist_key"))).withColumn("title", F.when(F.col("name").isNotNull(), F.col("track_key")))

    r = r.join(owners(r, "artist_mbid").withColumnRenamed("owner", "strong_artist"), "artist_mbid", "left")
    source = unique_aliases(r.where("name is not null and strong_artist is not null"), "name", "strong_artist").toDF("name", "source_artist")
    fresh = r.where("name is not null and artist_mbid is null").groupBy("name").agg(F.min("record_id").alias("fresh_artist"))
    r = r.join(source, "name", "left").join(fresh, "name", "left")
    if manual_aliases is None:
        r = r.withColumn("manual_artist", F.lit(None).cast(dict(r.dtypes)["record_id"]))
    else:
        manual = unique_aliases(manual_aliases.select(match_text(F.col("alias")).alias("alias"), "entity")).toDF("name", "manual_artist")
        r = r.join(manual, "name", "left")
    known = F.coalesce("manual_artist", "source_artist")
    r = r.withColumn("alias_artist", known).withColumn("own_artist", F.coalesce("strong_artist", "alias_artist", "fresh_artist", "record_id"))

    has_release = F.col("has_album") | F.col("release_mbid").isNotNull()
    tracks = r.where("recording_id is not null").groupBy("recording_id").agg(F.min("record_id").alias("strong_track"), F.min_by(has_release, "record_id").alias("track_has_release"))
    r = r.join(tracks, "recording_id", "left").withColumn("on_album", F.coalesce("album_key", F.lit("")))
    composite = ["own_artist", "title", "on_album"]
    named = r.where("title is not null")
    fits = F.when(F.col("track_has_release") == (F.col("on_album") != ""), F.col("strong_track"))  # a track with a release is not met without an album, nor the other way
    groups = named.groupBy(*composite).agg(F.min(fits).alias("low"), F.max(fits).alias("high"), F.min(F.when(F.col("recording_id").isNull(), F.col("record_id"))).alias("fresh_track"))
    r = r.join(groups, composite, "left").withColumn("composite_track", F.when(F.col("low") == F.col("high"), F.col("low")))
    r = r.withColumn("track_id", F.coalesce("strong_track", "composite_track", "fresh_track", "record_id"))
    r = r.join(owners(r, "release_mbid").withColumnRenamed("owner", "strong_release"), "release_mbid", "left")
    r = stored(r)

    first = r.where("track_id = record_id").select("track_id", F.col("own_artist").alias("artist_id"), F.coalesce("strong_release", F.when(F.col("has_album"), F.col("record_id"))).alias("release_id"))
    r = r.join(first, "track_id")
    kind = (
        F.when(F.col("recording_id").isNotNull(), "trusted_identifier").when(F.col("track_id") != F.col("record_id"), "conservative_composite").when(F.col("artist_mbid").isNotNull(), "trusted_identifier")
        .when(F.col("manual_artist").isNotNull(), "manual_decision").when(F.col("own_artist") != F.col("record_id"), "known_alias").otherwise("new_unresolved")
    )
    clash = lambda what, strong, other: F.when(F.col(strong) != F.col(other), F.struct(F.lit(what).alias("entity_type"), F.col(strong).alias("strong_id"), F.col(other).alias("other_id")))
    conflicts = F.array_compact(F.array(clash("artist", "strong_artist", "alias_artist"), clash("track", "strong_track", "low"), clash("artist", "artist_id", "own_artist"), clash("release", "strong_release", "release_id")))
    return r.select("record_id", "artist_id", "track_id", "release_id", kind.alias("kind"), conflicts.alias("conflicts"))


def conflicts(resolutions: DataFrame) -> DataFrame:
    """record_id, entity_type, strong_id, other_id: where a strong identifier and another rule disagree."""
    return resolutions.select("record_id", F.inline("conflicts")).distinct()


def merged(rows: DataFrame, entity: str, merges: DataFrame) -> DataFrame:
    """rows with ``entity`` followed through merges (subject, object: the object is seen as the subject), and before_merge, what it was.

    before_merge is the snapshot that a split restores; it is null where nothing changed.
    """
    roots = merge_roots(merges.select(F.col("object").alias("subject"), F.col("subject").alias("object"))).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    j = rows.join(roots, rows[entity] == F.col("_n"), "left")
    old, new = F.col(entity), F.coalesce("_r", entity)
    return j.select(*(new.alias(c) if c == entity else F.col(c) for c in rows.columns), F.when(old != new, old).alias("before_merge"))


def split(rows: DataFrame, entity: str, splits: DataFrame, event: str) -> tuple[DataFrame, DataFrame]:
    """(rows after the splits, refused splits) for rows of ``merged`` and splits (subject, object).

    A split gives the object back its rows.  It is refused where one event holds rows of both sides, which would tear it.
    That is so for all objects of an event whose rows of the subject have more than one before_merge, so events are looked at
    once, not once for each object of the subject.
    """
    s = splits.select(F.col("subject").alias("_s"), F.col("object").alias("_o")).distinct()
    held = rows.groupBy(entity, event).agg(F.min("before_merge").alias("_low"), F.max("before_merge").alias("_high"), F.count("*").alias("_n"), F.count("before_merge").alias("_known"))
    mixed = held.where("_low != _high or _known between 1 and _n - 1").select(entity, event)
    torn = rows.join(mixed, [entity, event], "left_semi").select(F.col(entity).alias("_e"), F.col("before_merge").alias("_b")).distinct()
    refused = s.join(torn, (torn["_e"] == s["_s"]) & (torn["_b"] == s["_o"]), "left_semi").select(F.col("_s").alias("subject"), F.col("_o").alias("object"))
    safe = s.join(refused, (s["_s"] == refused["subject"]) & (s["_o"] == refused["object"]), "left_anti")
    j = rows.join(safe, (rows[entity] == safe["_s"]) & (rows["before_merge"] == safe["_o"]), "left")
    undone = F.col("_o").isNotNull()
    made = {entity: F.when(undone, F.col("_o")).otherwise(F.col(entity)), "before_merge": F.when(~undone, F.col("before_merge"))}
    return j.select(*(made.get(c, F.col(c)).alias(c) for c in rows.columns)), refused
