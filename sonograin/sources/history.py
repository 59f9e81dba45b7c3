"""Listening history out of the driver's tables: one canonical event per order, two sources of evidence from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, artist_id, track_id, instant_ms, listened_ms, event_status: an event for each order.

    Every fourth belongs to one of five artists in fashion, each for eight months and again years later; the others go by
    customer.
    """
    o = table(spark, sf_dir, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    artist = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, 1_000_000 + F.pmod(F.floor(month / 8), F.lit(5))).otherwise(F.col("o_custkey"))
    return o.select(
        F.col("o_orderkey").alias("event_id"), artist.alias("artist_id"), (artist * 10 + F.pmod("o_orderkey", F.lit(10))).alias("track_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("instant_ms"),
        F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("long")).alias("listened_ms"), F.when(F.pmod("o_orderkey", F.lit(25)) == 0, "unresolved").otherwise("current").alias("event_status"),
    )


BASE_SQL = """oa as (select *, case when o_orderkey % 4 = 0 then 1000000 + (year(o_orderdate) * 12 + month(o_orderdate) - 1) // 8 % 5 else o_custkey end as artist from orders),
base as (select o_orderkey as event_id, artist as artist_id, artist * 10 + o_orderkey % 10 as track_id, epoch_us(o_orderdate) // 1000 as instant_ms,
  case when o_orderstatus <> 'P' then cast(floor(o_totalprice) as bigint) end as listened_ms, case when o_orderkey % 25 = 0 then 'unresolved' else 'current' end as event_status from oa)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("stopped_at_ms"), F.floor(F.col("value") * 1000).cast("long").alias("ms_played"))


#: What makes two records of one source the same listen told twice.
SAME_PLAY = ["listener", "stopped_at_ms", "ms_played", "artist", "track", "album", "track_uri"]
SAME_SCROBBLE = ["listener", "instant_ms", "artist", "track", "album", "artist_mbid", "recording_mbid"]


def interval_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays with a stop time and a duration; every fiftieth is there twice."""
    e, i = _events(spark, sf_dir), F.col("event_id")
    a, t = F.pmod(i, F.lit(40)).cast("string"), F.pmod(F.floor(i / 40), F.lit(3)).cast("string")
    plays = e.select(
        (2 * i).alias("record_id"), F.col("user_id").alias("listener"), "stopped_at_ms", "ms_played", F.concat(F.lit("Artist "), a).alias("artist"), F.concat(F.lit("Track "), t).alias("track"),
        F.when(i % 7 != 0, F.concat(F.lit("Album "), t)).alias("album"), F.concat(F.lit("track-"), a, F.lit("-"), t).alias("track_uri"), F.when(i % 9 != 0, i % 10 == 0).alias("skipped"),
    )
    again = plays.where(F.pmod("record_id", F.lit(100)) == 0).withColumn("record_id", F.col("record_id") + 1_000_000_000)
    return plays.unionByName(again)


def instant_scrobbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrobbles with a start and no duration, for two events in three; some names are spelled otherwise, some listens are told twice."""
    e, i = _events(spark, sf_dir).where(F.pmod("event_id", F.lit(3)) != 0), F.col("event_id")
    a, t = F.pmod(i, F.lit(40)).cast("string"), F.pmod(F.floor(i / 40), F.lit(3)).cast("string")
    s = e.select(
        (2 * i + 1).alias("record_id"), F.col("user_id").alias("listener"), (F.col("stopped_at_ms") - F.col("ms_played") + F.pmod(i * 7919, F.lit(90000)) - 45000).alias("instant_ms"),
        F.concat(F.when(i % 11 == 1, F.lit("The Artist, ")).otherwise(F.lit("ARTIST ")), a).alias("artist"), F.concat(F.when(i % 13 == 1, F.lit("Trk ")).otherwise(F.lit("Track: ")), t).alias("track"),
        F.when(i % 17 == 1, F.lit("Other")).when(i % 5 != 0, F.concat(F.lit("Album "), t)).alias("album"), F.when(i % 2 == 1, F.concat(F.lit("artist-"), a)).alias("artist_mbid"),
        F.when(i % 8 == 3, F.concat(F.lit("recording-"), a, F.lit("-"), t)).alias("recording_mbid"),
    )
    near = s.where(F.pmod("record_id", F.lit(50)) == 3).withColumn("record_id", F.col("record_id") + 2_000_000_000).withColumn("instant_ms", F.col("instant_ms") + 4000)
    again = s.where(F.pmod("record_id", F.lit(70)) == 5).withColumn("record_id", F.col("record_id") + 1_000_000_000)
    return s.unionByName(near).unionByName(again)


EVIDENCE_SQL = r"""ev as (select event_id, user_id, event_id % 40 as a, (event_id // 40) % 3 as t, epoch_us(ts) // 1000 as stopped_at_ms, cast(floor(value * 1000) as bigint) as ms_played from events),
plays1 as (select 2 * event_id as record_id, user_id as listener, stopped_at_ms, ms_played, 'Artist ' || a as artist, 'Track ' || t as track, case when event_id % 7 <> 0 then 'Album ' || t end as album, 'track-' || a || '-' || t as track_uri,
  case when event_id % 9 <> 0 then event_id % 10 = 0 end as skipped from ev),
plays as (select * from plays1 union all select record_id + 1000000000, * exclude (record_id) from plays1 where record_id % 100 = 0),
scrobbles1 as (select 2 * event_id + 1 as record_id, user_id as listener, stopped_at_ms - ms_played + (event_id * 7919) % 90000 - 45000 as instant_ms, case when event_id % 11 = 1 then 'The Artist, ' else 'ARTIST ' end || a as artist,
  case when event_id % 13 = 1 then 'Trk ' else 'Track: ' end || t as track, case when event_id % 17 = 1 then 'Other' when event_id % 5 <> 0 then 'Album ' || t end as album, case when event_id % 2 = 1 then 'artist-' || a end as artist_mbid,
  case when event_id % 8 = 3 then 'recording-' || a || '-' || t end as recording_mbid from ev where event_id % 3 <> 0),
scrobbles as (select * from scrobbles1 union all select record_id + 2000000000, listener, instant_ms + 4000, * exclude (record_id, listener, instant_ms) from scrobbles1 where record_id % 50 = 3
  union all select record_id + 1000000000, * exclude (record_id) from scrobbles1 where record_id % 70 = 5),
pk as (select *, min(record_id) over (partition by listener, stopped_at_ms, ms_played, artist, track, album, track_uri) as keeper from plays),
sk as (select *, min(record_id) over (partition by listener, instant_ms, artist, track, album, artist_mbid, recording_mbid) as keeper from scrobbles),
kp as (select * from pk where record_id = keeper), ks as (select * from sk where record_id = keeper)"""
