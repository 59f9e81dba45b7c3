"""More registered queries: files of several names scanned from the shared folder, manual aliases and splits, bounded volume."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _BASE, _IDENTITY, _LOCAL, _RECORDS, ORACLES, TZ, _merged, _records, register
from .operators import coverage, evidence, identity, volume
from .plans.storage import shared_dir
from .sources import history


# Scanned files --------------------------------------------------------------------------------------------------------
def _written(spark: SparkSession, d: str) -> str:
    """The folder of a JSON array file for every 25 listeners; every fourth file has a name of another family, every other one lies a level deeper."""
    e, u = history.table(spark, d, "events"), F.col("user_id")
    record = F.format_string(
        '{"ts":"%s","ms_played":%d,"spotify_track_uri":%s,"master_metadata_track_name":"%s","master_metadata_album_artist_name":"Artist %d","shuffle":false}',
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.floor(F.col("value") * 1000).cast("long"),
        F.when(F.col("event_id") % 10 == 0, F.lit("null")).otherwise(F.format_string('"spotify:track:%022d"', F.col("event_id"))), "event_type", u,
    )
    k = F.floor(u / 25).cast("long")
    name = F.when(k % 4 == 3, F.format_string("Streaming_History_Video_2024_%d.json", k)).when(k % 2 == 0, F.format_string("Streaming_History_Audio_2023-2024_%d.json", k)).otherwise(F.format_string("Streaming_History_Audio_2024_%d.json", k))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", record.alias("x")))), lambda s: s["x"]), ",")
    files = e.groupBy(name.alias("name"), F.when(k % 2 == 1, F.lit("more")).otherwise(F.lit("top")).alias("level")).agg(F.concat(F.lit("["), rows, F.lit("]")).alias("value"))
    folder = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    files.write.partitionBy("level", "name").option("lineSep", "\n").text(f"{folder}/parts")
    # a writer names its files itself: each gets its name by a rename, which moves no data
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for level, inner in (("top", ""), ("more", "/more")):
        fs.mkdirs(path(f"{folder}/in{inner}"))
        if fs.exists(path(f"{folder}/parts/level={level}")):
            for named in fs.listStatus(path(f"{folder}/parts/level={level}")):
                (part,) = [f.getPath() for f in fs.listStatus(named.getPath()) if f.getPath().getName().startswith("part-")]
                fs.rename(part, path(f"{folder}/in{inner}/{named.getPath().getName().removeprefix('name=')}"))
    return f"{folder}/in"


def _scan(spark: SparkSession, d: str) -> DataFrame:
    folder = _written(spark, d)
    return evidence.scanned_files(spark, [folder, f"{folder}/more", folder])


def _scanned_tracks(spark: SparkSession, d: str) -> DataFrame:
    members = evidence.json_members(_scan(spark, d), carry=("name",))
    return evidence.classify_interval(members.drop("wrapped"))


_FILES = """r as (select event_id, user_id // 25 as k, event_id % 10 > 0 as track, cast(floor(value * 1000) as bigint) as ms, epoch_us(ts) // 1000 as stop,
  '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","ms_played":' || cast(floor(value * 1000) as bigint) || ',"spotify_track_uri":' || case when event_id % 10 = 0 then 'null' else '"spotify:track:' || lpad(event_id::varchar, 22, '0') || '"' end
  || ',"master_metadata_track_name":"' || event_type || '","master_metadata_album_artist_name":"Artist ' || user_id || '","shuffle":false}' as x from events),
f as (select *, case when k % 4 = 3 then 'Streaming_History_Video_2024_' when k % 2 = 0 then 'Streaming_History_Audio_2023-2024_' else 'Streaming_History_Audio_2024_' end || k || '.json' as name from r)"""
_SCANNED = f"with {_FILES}, s as (select * from f where name like '%Audio%')"
register("s3_scanned_files", lambda spark, d: _scan(spark, d).select("name", "byte_size", "content_sha256"), f"""{_SCANNED}, t as (select name, '[' || string_agg(x, ',' order by event_id) || ']' || chr(10) as value from s group by 1)
select name, cast(strlen(value) as bigint) as byte_size, sha256(value) as content_sha256 from t""")
register("s1_scanned_members", lambda spark, d: _scanned_tracks(spark, d).groupBy("name", "kind", "reason").agg(F.count("*").alias("n"), F.max("ordinal").cast("long").alias("last_ordinal"), F.sum("stopped_at_ms").alias("instants"), F.sum("ms_played").alias("played")), f"""{_SCANNED},
o as (select *, row_number() over (partition by name order by event_id) - 1 as nr from s) select name, case when track then 'track' else 'excluded' end as kind, case when not track then 'video_or_unsupported' end as reason, count(*) as n, max(nr) as last_ordinal, sum(stop) as instants, sum(ms) as played from o group by all""")
register("a8_file_ranges", lambda spark, d: coverage.observed_ranges(_scanned_tracks(spark, d).where("kind = 'track'"), "stopped_at_ms", "name"), f"{_SCANNED} select name, min(stop) as first_ms, max(stop) as last_ms, count(*) as n from s where track group by 1")


# Manual aliases and splits --------------------------------------------------------------------------------------------
def _aliased(spark: SparkSession, d: str) -> DataFrame:
    """Names given by hand to artists of their own: one by name for every third name, and two for the seventh, which then tells nothing."""
    u = F.col("user_id") % 50
    names = history.table(spark, d, "events").select(u.alias("u")).distinct()
    one = names.where("u % 3 = 0").select(F.concat(F.lit("Artist "), "u").alias("alias"), (F.col("u") - 1000).alias("entity"))
    return one.unionByName(names.where("u % 21 = 0").select(F.concat(F.lit("aRTIST "), "u").alias("alias"), (F.col("u") - 2000).alias("entity")))


_BY_HAND = (
    _IDENTITY.replace("fr as (select name", "mn as (select name, case when u % 3 = 0 then u - 1000 end as manual_artist from (select distinct name, cast(substr(name, 8) as bigint) as u from a1) where u % 21 <> 0), fr as (select name", 1)
    .replace("a1.*, alias_artist, coalesce(strong_artist, alias_artist,", "a1.*, manual_artist, coalesce(manual_artist, alias_artist) as alias_artist, coalesce(strong_artist, manual_artist, src.alias_artist,", 1)
    .replace("left join src using (name)", "left join src using (name) left join mn using (name)", 1)
    .replace("when own_artist <> record_id", "when manual_artist is not null then 'manual_decision' when own_artist <> record_id", 1)
)
register("i14_manual_aliases", lambda spark, d: identity.resolved(_records(spark, d), _aliased(spark, d)).groupBy("kind", "artist_id").agg(F.count("*").alias("n"), F.sum("track_id").alias("tracks")), f"with {_RECORDS}, {_BY_HAND} select kind, artist_id, count(*) as n, cast(sum(track_id) as bigint) as tracks from res group by all")


_splits = lambda rows: rows.where(F.col("before_merge") % 5 == 0).select(F.col("artist_id").alias("subject"), F.col("before_merge").alias("object")).distinct()


def _split(part: int):
    """Every fifth merged artist is split off again, where no block of 64 order keys, which stands for a shared event, holds rows of both sides."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _merged(spark, d).withColumn("event", F.floor(F.col("event_id") / 64))
        return identity.split(rows, "artist_id", _splits(rows), "event")[part].drop("event")

    return query


_UNDONE = f"""{ORACLES["i12_merged"].replace(") select event_id, coalesce(root", "), mg as (select event_id, coalesce(root")}), mv as (select *, event_id // 64 as event from mg),
sp as (select distinct artist_id as subject, before_merge as object from mv where before_merge % 5 = 0),
rf as (select subject, object from sp where exists (select 1 from mv a join mv b using (event) where a.artist_id = subject and a.before_merge = object and b.artist_id = subject and b.before_merge is distinct from object)),
sf as (select * from sp except select * from rf)"""
register("i13_split", _split(0), f"{_UNDONE} select event_id, coalesce(object, artist_id) as artist_id, case when object is null then before_merge end as before_merge from mv left join sf on artist_id = subject and before_merge = object")
register("i13_refused", _split(1), f"{_UNDONE} select * from rf")


# Volume between bounds ------------------------------------------------------------------------------------------------
FROM_MS, TO_MS = 820_454_400_123, 883_612_800_456
register("p8_bounded_volume", lambda spark, d: volume.listening_volume(history.canonical_base(spark, d), "month", include_unresolved=False, start_ms=FROM_MS, end_ms=TO_MS, tz=TZ).select("period", "value"), f"""{_BASE}, e as (select cast(date_trunc('month', {_LOCAL}) as date) as s from base where event_status = 'current' and instant_ms >= {FROM_MS} and instant_ms < {TO_MS}), ends as (select {FROM_MS} as instant_ms union all select {TO_MS - 1}),
axis as (select unnest(generate_series(min(date_trunc('month', {_LOCAL})), max(date_trunc('month', {_LOCAL})), interval 1 month))::date as s from ends) select strftime(axis.s, '%Y-%m') as period, count(e.s) as value from axis left join e on e.s = axis.s group by axis.s""")
