"""Raw records: read, classify with a reason, fingerprint, register files, count outcomes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank

# The names of the accepted fields, their order of checks and the reason codes belong to the input format.
MARKERS = ["episode_name", "episode_show_name", "spotify_episode_uri", "audiobook_title", "audiobook_uri", "audiobook_chapter_uri", "audiobook_chapter_title"]
TEXTS = ["master_metadata_album_artist_name", "master_metadata_album_album_name", "master_metadata_track_name", "reason_start", "reason_end"]
BOOLEANS = ["skipped", "offline"]
INSTANT = {n: n for n in ("timestamp", "artist_name", "track_name", "album_name", "artist_musicbrainz_id", "release_musicbrainz_id", "recording_musicbrainz_id", "loved")}
#: The same fields by their names inside a wrapper object; others don't occur there.
WRAPPED = {"timestamp": "date", "artist_name": "artist", "track_name": "track", "album_name": "album", "release_musicbrainz_id": "albumId"}
MOST = (1 << 53) - 1
TRACK_URI = "^spotify:track:[A-Za-z0-9]{22}$"
UTC = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{1,3})?Z$"


def json_texts(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """file, value: whole files."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def json_members(texts: DataFrame, wrapper: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """file, further columns named in ``carry``, ordinal, record (VARIANT), wrapped for each member of the JSON arrays in texts (file, value).

    With ``wrapper`` the array may be that field of an object instead.  Anything else in a file gives no rows.
    """
    raw = texts.select("file", *carry, F.try_parse_json("value").alias("v")).select("*", F.expr("try_variant_get(v, '$', 'array<variant>')").alias("root"))
    if wrapper:
        inner = F.when(F.col("root").isNull(), F.expr(f"try_variant_get(v, '$.{wrapper}', 'array<variant>')"))
    else:
        inner = F.lit(None).cast("array<variant>")
    return raw.select("file", *carry, F.posexplode(F.coalesce("root", inner)).alias("ordinal", "record"), F.col("root").isNull().alias("wrapped"))


def file_faults(texts: DataFrame, wrapper: str | None = None) -> DataFrame:
    """file: those that hold no such array."""
    v = F.try_parse_json("value")
    found = texts.select("file", v.alias("v"))
    inner = F.expr(f"try_variant_get(v, '$.{wrapper}', 'array<variant>') is null") if wrapper else F.lit(True)
    return found.where(F.expr("try_variant_get(v, '$', 'array<variant>') is null") & inner).select("file")


def utc_millis(c: Column) -> Column:
    """Epoch milliseconds of a strict UTC timestamp with up to three fraction digits; null for anything else or before 1970."""
    ms = F.unix_millis(F.try_to_timestamp(c))
    return F.when(c.rlike(UTC) & (ms >= 0), ms)


def _kind(name: str) -> Column:
    return F.expr(f"schema_of_variant(variant_get(record, '$.{name}', 'variant'))")


def _absent(name: str) -> Column:
    return F.expr(f"variant_get(record, '$.{name}', 'variant') is null or is_variant_null(variant_get(record, '$.{name}', 'variant'))")


def _of(name: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(record, '$.{name}', '{kind}')")


def _whole(name: str) -> Column:
    """A number without fraction, however it is written, that a double holds exactly; else null."""
    d = _of(name, "double")
    return F.when(_kind(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (d == F.floor(d)) & (F.abs(d) <= MOST), d.cast("long"))


def classify_interval(members: DataFrame) -> DataFrame:
    """Adds kind (track, excluded, malformed) and reason to members, with the allowed fields only; the first failing check names the reason."""
    wrong = lambda names, kind: F.coalesce(*(F.when(~_absent(n) & (_kind(n) != kind), F.lit(True)) for n in names), F.lit(False))
    ts = F.when(_kind("ts") == "STRING", utc_millis(_of("ts", "string")))
    played = _whole("ms_played")
    bad_shuffle = _absent("shuffle") | (_kind("shuffle") != "BOOLEAN")
    bad_offline = ~_absent("offline_timestamp") & (F.coalesce(_whole("offline_timestamp") < 0, F.lit(True)))
    marked = F.coalesce(*(F.when(~blank(_of(n, "string")), F.lit(True)) for n in MARKERS), F.lit(False))
    reason = (
        F.when(~F.expr("schema_of_variant(record) like 'OBJECT%'"), "invalid_record")
        .when(ts.isNull(), "invalid_timestamp")
        .when(played.isNull() | (played < 0), "invalid_duration")
        .when(ts - played < 0, "invalid_time_arithmetic")
        .when(wrong(["spotify_track_uri", *MARKERS, *TEXTS], "STRING") | wrong(BOOLEANS, "BOOLEAN") | bad_offline | bad_shuffle, "invalid_field_type")
        .when(_absent("spotify_track_uri"), F.when(marked, "episode_or_audiobook").otherwise("video_or_unsupported"))
        .when(~_of("spotify_track_uri", "string").rlike(TRACK_URI), "invalid_track_uri")
        .when(blank(_of("master_metadata_album_artist_name", "string")) | blank(_of("master_metadata_track_name", "string")), "invalid_track_metadata")
    )
    kind = F.when(reason.isNull(), "track").when(reason.isin("episode_or_audiobook", "video_or_unsupported"), "excluded").otherwise("malformed")
    keep = [c for c in members.columns if c != "record"]
    return members.select(
        *keep, kind.alias("kind"), reason.alias("reason"), ts.alias("stopped_at_ms"), played.alias("ms_played"), _of("spotify_track_uri", "string").alias("track_uri"), _of("master_metadata_album_artist_name", "string").alias("artist"),
        _of("master_metadata_album_album_name", "string").alias("album"), _of("master_metadata_track_name", "string").alias("track"), _of("skipped", "boolean").alias("skipped"), _of("shuffle", "boolean").alias("shuffle"),
    )


def classify_instant(members: DataFrame, names: dict[str, str] = INSTANT) -> DataFrame:
    """Adds kind (scrobble, malformed) and reason; blank optional text becomes null.  names: the records' own names of the fields."""
    field = lambda n: names.get(n, n)
    there = lambda n: n in names
    at = _whole(field("timestamp"))
    optional = [n for n in ("album_name", "artist_musicbrainz_id", "release_musicbrainz_id", "recording_musicbrainz_id") if there(n)]
    need = ["artist_name", "track_name"]
    no = F.lit(None).cast("boolean")
    wrong = [F.when(~_absent(field(n)) & (_kind(field(n)) != "STRING"), F.lit(True)) for n in optional]
    wrong.append(F.when(~_absent("loved") & (_kind("loved") != "BOOLEAN"), F.lit(True)) if there("loved") else no)
    reason = (
        F.when(~F.expr("schema_of_variant(record) like 'OBJECT%'"), "invalid_record")
        .when(at.isNull() | (at < 0), "invalid_timestamp")
        .when(F.coalesce(*(F.when(_absent(field(n)) | (_kind(field(n)) != "STRING"), F.lit(True)) for n in need), F.lit(False)), "invalid_field_type")
        .when(blank(_of(field("artist_name"), "string")) | blank(_of(field("track_name"), "string")), "invalid_required_text")
        .when(F.coalesce(*wrong, F.lit(False)), "invalid_field_type")
    )
    text = lambda n: F.when(~blank(_of(field(n), "string")), _of(field(n), "string")) if there(n) else F.lit(None).cast("string")
    keep = [c for c in members.columns if c != "record"]
    return members.select(
        *keep, F.when(reason.isNull(), "scrobble").otherwise("malformed").alias("kind"), reason.alias("reason"), at.alias("instant_ms"), _of(field("artist_name"), "string").alias("artist"), _of(field("track_name"), "string").alias("track"),
        text("album_name").alias("album"), text("artist_musicbrainz_id").alias("artist_mbid"), text("release_musicbrainz_id").alias("release_mbid"), text("recording_musicbrainz_id").alias("recording_mbid"),
    )


def classify_export(texts: DataFrame) -> DataFrame:
    """classify_instant over files of either form: an array, or an object whose ``scrobbles`` is one with names of its own."""
    members = json_members(texts, "scrobbles")
    return classify_instant(members.where("not wrapped")).unionByName(classify_instant(members.where("wrapped"), WRAPPED)).drop("wrapped")


# The form of a landed page of recent tracks.
_PAGE = "recenttracks struct<`@attr`:struct<page:string,perPage:string,total:string,totalPages:string>,track:array<struct<name:string,mbid:string,artist:struct<`#text`:string,mbid:string>,album:struct<`#text`:string,mbid:string>,loved:string,date:struct<uts:string>,`@attr`:struct<nowplaying:string>>>>"


def landed_tracks(pages: DataFrame) -> DataFrame:
    """file, page, per_page, total, total_pages, now_playing, at, artist, track, album, ids, loved, instant_ms, fault of landed pages (file, value).

    One row per track; the one that is playing now has no instant and is marked.  fault tells of a track without an artist,
    a name or a whole number of seconds.
    """
    p = pages.select("file", F.from_json("value", _PAGE).alias("j")).select("file", "j.recenttracks.*")
    number = lambda c: F.when(c.rlike("^[0-9]{1,15}$"), c.cast("long"))
    attr = lambda n: number(F.col("`@attr`")[n])
    t = p.select("file", attr("page").alias("page"), attr("perPage").alias("per_page"), attr("total").alias("total"), attr("totalPages").alias("total_pages"), F.posexplode("track").alias("at", "t"))
    text = lambda c: F.when(~blank(c), c)
    now = F.coalesce(F.col("t")["@attr"]["nowplaying"] == "true", F.lit(False))
    seconds = number(F.col("t.date.uts"))
    t = t.select(
        "file", "page", "per_page", "total", "total_pages", "at", now.alias("now_playing"), text(F.col("t.artist")["#text"]).alias("artist"), text(F.col("t.name")).alias("track"), text(F.col("t.album")["#text"]).alias("album"),
        text(F.col("t.artist.mbid")).alias("artist_mbid"), text(F.col("t.album.mbid")).alias("release_mbid"), text(F.col("t.mbid")).alias("recording_mbid"), (F.col("t.loved") == "1").alias("loved"), F.when(~now, ms_of_seconds(seconds)).alias("instant_ms"),
    )
    return t.withColumn("fault", ~F.col("now_playing") & (F.col("artist").isNull() | F.col("track").isNull() | F.col("instant_ms").isNull()))


def ms_of_seconds(c: Column) -> Column:
    return c * 1000


def seconds_of_ms(c: Column) -> Column:
    """Whole seconds, rounded down, as a page's lower bound wants them."""
    return F.floor(c / 1000).cast("long")


# The prefixes of hashed names belong to the format.
SCOPE, LOCATOR, FOLDER = "lastfm-sync-scope-v1", "lastfm-path-v1", "lastfm/path-"


def scope_hash(user: Column) -> Column:
    """A one-way name for an account."""
    return F.sha2(F.concat(F.lit(f"{SCOPE}\0"), user), 256)


def file_locator(path: Column) -> Column:
    """A name for a file that doesn't give its path away."""
    return F.concat(F.lit(FOLDER), F.sha2(F.concat(F.lit(f"{LOCATOR}\0"), path), 256), F.lit(".json"))


def outcome_counts(classified: DataFrame) -> DataFrame:
    """kind, reason, n: accepted, excluded and rejected records."""
    return classified.groupBy("kind", "reason").agg(F.count("*").alias("n"))


# The two-character escapes of canonical JSON; other control characters are \\u and four hex digits.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
# Versions and kinds of fingerprints, and the fields of each.
INTERVAL_PRINT = ("spotify-source-v1", "spotify", ("albumName", "artistName", "msPlayed", "offline", "offlineTimestamp", "reasonEnd", "reasonStart", "shuffle", "skipped", "spotifyTrackUri", "startedAtEpochMs", "stoppedAtEpochMs", "trackName"))
INSTANT_PRINT = ("lastfm-source-v1", "lastfm", ("albumName", "artistMusicbrainzId", "artistName", "loved", "recordingMusicbrainzId", "releaseMusicbrainzId", "scrobbledAtEpochMs", "trackName"))
OVERLAP_PRINT = ("lastfm-overlap-v1", "lastfm", ("artistName", "scrobbledAtEpochMs", "trackName"))


def json_text(c: Column) -> Column:
    """A JSON string with no escapes but the necessary ones."""
    out = c
    for raw, escaped in [*_ESCAPES.items(), *((chr(i), f"\\u{i:04x}") for i in range(32) if chr(i) not in _ESCAPES)]:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), F.when(c.rlike('[\\x00-\\x1f"\\\\]'), out).otherwise(c), F.lit('"'))


def canonical_record(version: str, source_kind: str, **fields: Column) -> Column:
    """The bytes that a fingerprint is made of: fields in code-unit order of their names, each with its type and value; text, booleans and whole numbers."""
    if not version or not all(fields):
        raise ValueError("version and field names must not be empty")
    parts = []
    for name, c in sorted(fields.items(), key=lambda f: f[0].encode("utf-16-be")):
        kind, text = F.typeof(c), c.cast("string")
        number = F.when(F.abs(c.try_cast("decimal(20,0)")) <= MOST, text).otherwise(F.raise_error(F.lit(f"fingerprint field {name} must be a safe integer")))
        value = F.when(kind == "string", F.concat(F.lit('"string",'), json_text(text))).when(kind == "boolean", F.concat(F.lit('"boolean",'), text)).otherwise(F.concat(F.lit('"number",'), number))
        parts.append(F.concat(F.lit(f"[{json.dumps(name, ensure_ascii=False)},"), F.when(c.isNull(), F.lit('"null",null')).otherwise(value), F.lit("]")))
    tail = f'],"sourceKind":{json.dumps(source_kind, ensure_ascii=False)},"version":{json.dumps(version, ensure_ascii=False)}}}'
    return F.concat(F.lit('{"fields":['), F.concat_ws(",", *parts), F.lit(tail))


def fingerprint(version: str, source_kind: str, **fields: Column) -> Column:
    """SHA-256 of the canonical record; null differs from empty text, and text from numbers."""
    return F.sha2(canonical_record(version, source_kind, **fields), 256)


def record_fingerprint(form: tuple, **fields: Column) -> Column:
    """The fingerprint of one of the forms above; fields that are not given are null."""
    version, source_kind, names = form
    if set(fields) - set(names):
        raise ValueError(f"unknown fields {sorted(set(fields) - set(names))}")
    return fingerprint(version, source_kind, **{n: fields.get(n, F.lit(None).cast("string")) for n in names})


def overlap_fingerprint(at: Column, artist: Column, track: Column) -> Column:
    """Of artist, track and instant alone, equal for exported and fetched evidence of one listen."""
    return record_fingerprint(OVERLAP_PRINT, artistName=artist, scrobbledAtEpochMs=at, trackName=track)


#: Fixed value: the names of interval-source files.
INTERVAL_NAMES = "^Streaming_History_Audio_\\d{4}(-\\d{4})?_\\d+\\.json$"


def scanned_files(spark: SparkSession, paths: list[str], family: str = INTERVAL_NAMES) -> DataFrame:
    """file, name, byte_size, content_sha256, value of the regular files below ``paths`` whose name matches ``family``, each opened once.

    A path offered twice, or lying below another one, adds nothing.  Names are told apart before a file is opened; value is
    the content as text, for ``json_members``.  Content that is not UTF-8 is hashed as it stands and counts as U+FFFD in value.
    """
    offered = {p.rstrip("/") or "/" for p in paths}
    roots = sorted(p for p in offered if not any(p != q and p.startswith(f"{q.rstrip('/')}/") for q in offered))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    kept = raw.where(F.col("_metadata.file_name").rlike(family))
    return kept.select(F.col("path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("content_sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("value"))


def file_registry(spark: SparkSession, path: str) -> DataFrame:
    """path, byte_size, content_sha256 of exact bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("content_sha256"))


def registration(found: DataFrame, known: DataFrame) -> DataFrame:
    """path, source_type, content_sha256, outcome of files (path, source_type, byte_size, content_sha256) against a registry of the same columns.

    changed: a known path has other content; malformed: the known file has another type or size; known; known_elsewhere:
    this type and content are there under another path; new.  Paths are registered once, and so are contents of a type.
    """
    found = found.distinct()
    k = known.groupBy(F.col("path").alias("_p")).agg(F.min(F.struct("content_sha256", "source_type", "byte_size")).alias("k"))
    h = known.groupBy(F.col("source_type").alias("_t"), F.col("content_sha256").alias("_g")).agg(F.min("byte_size").alias("_size"))
    j = found.join(k, found["path"] == k["_p"], "left").join(h, (found["source_type"] == h["_t"]) & (found["content_sha256"] == h["_g"]), "left")
    outcome = (
        F.when(F.col("k.content_sha256") != F.col("content_sha256"), "changed")
        .when(F.col("k").isNotNull(), F.when((F.col("k.source_type") != F.col("source_type")) | (F.col("k.byte_size") != F.col("byte_size")), "malformed").otherwise("known"))
        .when(F.col("_g").isNotNull(), F.when(F.col("_size") != F.col("byte_size"), "malformed").otherwise("known_elsewhere"))
        .otherwise("new")
    )
    return j.select("path", "source_type", "content_sha256", outcome.alias("outcome"))


def missing_files(registry: DataFrame, found: DataFrame) -> DataFrame:
    """path, fault of registered files (path, byte_size, content_sha256) that are missing or changed by now."""
    f = found.select(F.col("path").alias("_p"), F.col("byte_size").alias("_size"), F.col("content_sha256").alias("_hash"))
    j = registry.join(f, registry["path"] == f["_p"], "left")
    fault = F.when(F.col("_p").isNull(), "missing").when(F.col("_size") != F.col("byte_size"), "size").when(F.col("_hash") != F.col("content_sha256"), "content")
    return j.select("path", fault.alias("fault")).where("fault is not null")


def accepted(classified: DataFrame, kind: str) -> DataFrame:
    """The rows to append as evidence; exact duplicates stay rows of their own."""
    return classified.where(F.col("kind") == kind).drop("kind", "reason")


def rejected(classified: DataFrame, *provenance: str) -> DataFrame:
    """Where a rejected record stood and the code of its reason, nothing of what it held."""
    return classified.where("kind = 'malformed'").select(*provenance, F.col("reason").alias("error_code"))


def append_evidence(classified: DataFrame, kind: str, path: str, *provenance: str) -> None:
    """Append accepted rows to path/accepted and rejections to path/rejected."""
    accepted(classified, kind).write.mode("append").parquet(f"{path}/accepted")
    rejected(classified, *provenance).write.mode("append").parquet(f"{path}/rejected")


def unprocessed(evidence: DataFrame, *done: DataFrame, key: str = "record_id") -> DataFrame:
    """Evidence that none of ``done`` knows by key."""
    for d in done:
        evidence = evidence.join(d.select(key).distinct(), key, "left_anti")
    return evidence
