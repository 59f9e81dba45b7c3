"""Identities as they come about record by record: a name or title is unique for a record by what came before it.

Whoever first bears a name is met by it until a second bearer comes; from then on the name tells nothing, and records without a
strong identifier make entities of their own.  What a record finds depends on earlier records only, so the rules have one
solution.  It is looked for in rounds over all records at once: each round takes the bearers that the round before implies,
reduced to the first and second one of each name by time, and the rounds end when no record changes.  A round settles all
records whose grounds are settled, so their number is the longest chain of such grounds and not the number of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_text, with_match_text
from ..plans.storage import Rounds, stored


def first_two(rows: DataFrame, keys: list[str], bearer: str, time: str, opens: str) -> DataFrame:
    """keys (nulls are equal), first (the earliest bearer), since (its time) and until (the time of the next other one, null if none); rows: one per bearer and key.

    ``opens`` is the time from which a bearer can be the second one: null for those that only came about because there were
    two already.  Without this a mistaken second bearer would keep itself alive through all records after it.
    """
    first = rows.groupBy(*keys).agg(F.min(F.struct(time, bearer)).alias("_f")).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(f"_f.{bearer}").alias("first"), F.col(f"_f.{time}").alias("since"))
    j = rows.join(first, [rows[k].eqNullSafe(first[f"_{k}"]) for k in keys])
    return j.groupBy(*keys, "first", "since").agg(F.min(F.when(F.col(bearer) != F.col("first"), F.col(opens))).alias("until"))


def met(rows: DataFrame, bearers: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with ``name``: the only bearer of keys (nulls are equal) before the row's record_id."""
    b = bearers.select(*(F.col(k).alias(f"_{k}") for k in keys), "first", "since", "until")
    same = [rows[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    unique = (F.col("since") < F.col("record_id")) & (F.col("until").isNull() | (F.col("until") >= F.col("record_id")))
    return rows.join(b, same, "left").withColumn(name, F.when(unique, F.col("first"))).drop("first", "since", "until", *(f"_{k}" for k in keys))


def _following(rows: DataFrame, entity: str, pointer: str, name: str) -> DataFrame:
    """rows with ``name``: the ``entity`` of the record that ``pointer`` names."""
    of = rows.select(F.col("record_id").alias("_at"), F.col(entity).alias(name))
    return rows.join(of, rows[pointer] == of["_at"], "left").drop("_at")


def _settled(rows: DataFrame, step, values: list[str]) -> DataFrame:
    """rows after as many rounds of ``step`` (which gives new_<value> for each value) as change anything."""
    rounds = Rounds(rows.sparkSession)
    while True:
        new = rounds.keep(step(rows))
        changed = F.lit(False)
        for v in values:
            changed |= ~F.col(v).eqNullSafe(F.col(f"new_{v}"))
        moved = new.where(changed).limit(1).count()
        rows = new.drop(*values).withColumnsRenamed({f"new_{v}": v for v in values})
        if not moved:
            return rows


def _artists(r: DataFrame, manual_aliases: DataFrame | None) -> DataFrame:
    """r with own_artist, alias_artist and manual_artist; r: record_id, artist_mbid, artist_key, name (artist_key, where the title has match text too)."""
    known = r.where("artist_mbid is not null").groupBy("artist_mbid").agg(F.min("record_id").alias("first_of"))
    r = r.join(known, "artist_mbid", "left").withColumn("first_of", F.when(F.col("first_of") < F.col("record_id"), F.col("first_of")))
    if manual_aliases is None:
        r = r.withColumn("manual_artist", F.lit(None).cast("long"))
    else:
        m = manual_aliases.select(match_text(F.col("alias")).alias("name"), "entity", "since").where("name is not null")
        r = met(r, first_two(m.groupBy("name", "entity").agg(F.min("since").alias("at")), ["name"], "entity", "at", "at"), ["name"], "manual_artist")
    start = F.first("record_id", ignorenulls=True).over(Window.partitionBy("artist_key").orderBy("record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    guess = F.coalesce("first_of", F.when(F.col("name").isNotNull(), F.coalesce("manual_artist", start)), "record_id")
    r = stored(r.withColumn("own_artist", guess).withColumn("alias_artist", F.lit(None).cast("long")))

    def step(rows):
        # a record that had to find its artist by this name is another bearer only of a name with two
        sure = F.col("first_of").isNotNull() | F.col("name").isNull() | F.col("manual_artist").isNotNull()
        bearers = rows.where("artist_key is not null").groupBy("artist_key", "own_artist").agg(F.min("record_id").alias("at"), F.min(F.when(sure, F.col("record_id"))).alias("opens")).withColumnRenamed("artist_key", "name")
        found = met(rows.drop("alias_artist"), first_two(bearers, ["name"], "own_artist", "at", "opens"), ["name"], "source_artist")
        found = _following(found, "own_artist", "first_of", "strong_artist").withColumn("alias_artist", F.coalesce("manual_artist", "source_artist"))
        return found.withColumn("new_own_artist", F.coalesce("strong_artist", "alias_artist", "record_id")).drop("source_artist", "strong_artist")

    return _settled(r, step, ["own_artist"])


def _tracks(r: DataFrame) -> DataFrame:
    """r with track_id, composite (the track that artist, title and album lead to) and release_id."""
    firsts = r.where("recording_id is not null").groupBy("recording_id").agg(F.min("record_id").alias("first_track"))
    r = r.join(firsts, "recording_id", "left").withColumn("first_track", F.when(F.col("first_track") < F.col("record_id"), F.col("first_track")))
    same = Window.partitionBy("own_artist", "title", "album_key", F.col("title").isNull(), F.when(F.col("title").isNull(), F.col("record_id")))
    r = r.withColumn("track_id", F.coalesce("first_track", F.min("record_id").over(same), "record_id"))
    r = stored(r.withColumn("release_id", F.when(F.col("has_album"), F.col("track_id"))).withColumn("composite", F.lit(None).cast("long")))
    # a record whose title or album has no match text leaves no such alias
    key = ["own_artist", "title", "on_album"]

    def step(rows):
        rows = rows.drop("composite")
        tracks = rows.where("track_id = record_id").select(F.col("record_id").alias("track"), F.col("own_artist").alias("by"), F.col("release_id").alias("on"), F.col("title").alias("own_title"), F.col("album_key").alias("own_album"))
        titles = rows.where("track_key is not null").groupBy(F.col("track_id").alias("track"), "track_key").agg(F.min("record_id").alias("titled"))
        albums = rows.where("release_id is not null and album_key is not null").groupBy(F.col("release_id").alias("on"), "album_key").agg(F.min("record_id").alias("named"))
        b = titles.join(tracks, "track").join(albums, "on", "left").where("on is null or album_key is not null")
        b = b.withColumn("at", F.greatest("titled", F.coalesce("named", "titled")))
        # a track that its first record made under this very key is another bearer only of a key with two
        itself = (F.col("at") == F.col("track")) & F.col("track_key").eqNullSafe(F.col("own_title")) & F.col("album_key").eqNullSafe(F.col("own_album"))
        b = b.select(F.col("by").alias("own_artist"), F.col("track_key").alias("title"), F.col("album_key").alias("on_album"), "track", "at", F.when(~itself, F.col("at")).alias("opens"))
        found = met(rows.withColumn("on_album", F.col("album_key")), first_two(b, key, "track", "at", "opens"), key, "composite").drop("on_album")
        found = found.withColumn("composite", F.when(F.col("title").isNotNull(), F.col("composite")))
        found = _following(found, "track_id", "first_track", "strong_track")
        found = found.withColumn("new_track_id", F.coalesce("strong_track", "composite", "record_id")).drop("strong_track")
        # the release of a record's track: what the track's first record had of it
        given = rows.where("release_mbid is not null and release_id is not null").groupBy("release_mbid").agg(F.min(F.struct("record_id", "release_id")).alias("g"))
        made = rows.where("track_id = record_id").join(given, "release_mbid", "left").select(
            F.col("record_id").alias("made"), F.when(F.col("g.record_id") < F.col("record_id"), F.col("g.release_id")).otherwise(F.when(F.col("has_album"), F.col("record_id"))).alias("new_release_id"))
        return found.join(made, found["track_id"] == made["made"], "left").drop("made")

    return _settled(r, step, ["track_id", "release_id"])


def replayed(records: DataFrame, manual_aliases: DataFrame | None = None) -> DataFrame:
    """record_id, artist_id, track_id, release_id, kind, conflicts per record, as if records had come one by one in the order of record_id.

    records: record_id (a unique number), artist, track, album, artist_mbid, recording_id, release_mbid.  manual_aliases: alias,
    entity, since (in force for records after it).  An artist is the one of the strong identifier, else of the
    manual alias, else the only one that bore the name before, else new; a track that of the strong identifier, else the only
    one of that artist that bore the title and whose release bore the album name (or has no release, without a name), else
    new.  Strong identifiers stay with the entity of their first record, so a second one of a title joins its
    track.  Entities are named by the record that made them.  Records without match text of artist or title never meet by name.
    """
    named = with_match_text(records, artist_key="artist", track_key="track", album_key="album")
    usable = F.col("artist_key").isNotNull() & F.col("track_key").isNotNull()
    r = named.select(
        "record_id", "artist_mbid", "recording_id", "release_mbid", F.col("album").isNotNull().alias("has_album"), "artist_key", "track_key", "album_key",
        F.when(usable, F.col("artist_key")).alias("name"), F.when(usable, F.col("track_key")).alias("title"),
    )
    r = _tracks(_artists(stored(r), manual_aliases))
    of = r.where("track_id = record_id").select(F.col("record_id").alias("_t"), F.col("own_artist").alias("artist_id"))
    r = r.join(of, r["track_id"] == of["_t"]).drop("_t")
    given = r.where("release_mbid is not null and release_id is not null").groupBy("release_mbid").agg(F.min_by("release_id", "record_id").alias("strong_release"))
    r = r.join(given, "release_mbid", "left")
    r = r.withColumn("strong_artist", F.when(F.col("first_of").isNotNull(), F.col("own_artist"))).withColumn("strong_track", F.when(F.col("first_track").isNotNull(), F.col("track_id")))
    kind = (
        F.when(F.col("recording_id").isNotNull() & (F.col("first_track").isNotNull() | F.col("composite").isNull()), "trusted_identifier").when(F.col("composite").isNotNull(), "conservative_composite")
        .when(F.col("artist_mbid").isNotNull(), "trusted_identifier").when(F.col("manual_artist").isNotNull(), "manual_decision").when(F.col("alias_artist").isNotNull(), "known_alias").otherwise("new_unresolved")
    )
    clash = lambda what, strong, other: F.when(F.col(strong) != F.col(other), F.struct(F.lit(what).alias("entity_type"), F.col(strong).alias("strong_id"), F.col(other).alias("other_id")))
    conflicts = F.array_compact(F.array(clash("artist", "strong_artist", "alias_artist"), clash("track", "strong_track", "composite"), clash("artist", "artist_id", "own_artist"), clash("release", "strong_release", "release_id")))
    return r.select("record_id", "artist_id", "track_id", "release_id", kind.alias("kind"), F.array_distinct(conflicts).alias("conflicts"))
