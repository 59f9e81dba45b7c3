"""The registered queries of the listening-history engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.calendar import GRAINS, iso_millis
from .functions.text import match_text
from .operators import coverage, decisions, eras, evidence, identity, integrity, reconcile, returns, sync, volume
from .plans import envelope, ordering, reconciliation
from .sources import history
from .streaming import plays as streams

QUERIES: dict = {}
ORACLES: dict = {}
TZ = "America/Chicago"
_BASE = "with " + history.BASE_SQL
_EVIDENCE = "with " + history.EVIDENCE_SQL
_LOCAL = f"timezone('{TZ}', timezone('UTC', make_timestamp(instant_ms * 1000)))"


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# Volume ---------------------------------------------------------------------------------------------------------------
_LABEL = {"day": "strftime(s, '%Y-%m-%d')", "week": "strftime(s, '%G-W%V')", "month": "strftime(s, '%Y-%m')", "quarter": "year(s) || '-Q' || quarter(s)", "year": "strftime(s, '%Y')"}
_STEP = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def _volume_sql(grain: str, metric: str, rolling: int) -> str:
    value = {"play_count": "1", "play_count_at_least_ms": "case when listened_ms >= 100000 then 1 end", "listened_ms": "listened_ms"}[metric]
    prior = "substr(period, 1, 4)::int - 1 || substr(period, 5)"
    return f"""{_BASE}, e as (select cast(date_trunc('{grain}', {_LOCAL}) as date) as s, {value} as v from base where event_status in ('current', 'unresolved')),
c as (select s, sum(v) as v from e group by s), axis as (select unnest(generate_series(min(s)::timestamp, max(s)::timestamp, interval {_STEP[grain]}))::date as s from c),
r as (select a.s, {_LABEL[grain].replace('(s', '(a.s')} as period, coalesce(c.v, 0) as value from axis a left join c on a.s = c.s),
p as (select {_LABEL[grain]} as period, v from c where v is not null),
w as (select *, sum(value) over (order by s rows between {rolling - 1} preceding and current row) as rolling_value from r)
select w.period, cast(w.value as bigint) as value, cast(rolling_value as bigint) as rolling_value, cast(p.v as bigint) as prior_year_value, cast(w.value - p.v as bigint) as absolute_change,
  case when p.v <> 0 then (w.value - p.v) / p.v end as relative_change from w left join p on p.period = {prior.replace('period', 'w.period')}"""


def _volume(grain: str, metric: str, rolling: int):
    return lambda spark, d: volume.listening_volume(history.canonical_base(spark, d), grain, metric, rolling, minimum_ms=100_000, tz=TZ)


for _grain in GRAINS:
    register(f"n1_volume_{_grain}", _volume(_grain, "play_count", 3), _volume_sql(_grain, "play_count", 3))
register("n1_volume_at_least_ms", _volume("month", "play_count_at_least_ms", 12), _volume_sql("month", "play_count_at_least_ms", 12))
register("n1_volume_listened_ms", _volume("quarter", "listened_ms", 4), _volume_sql("quarter", "listened_ms", 4))

# Eras -----------------------------------------------------------------------------------------------------------------
_ERAS = f"""e as (select artist_id, year({_LOCAL}) * 12 + month({_LOCAL}) - 1 as m from base),
k as (select artist_id, m - (m - 23640) % 3 as m, count(*) as n from e group by all), ends as (select min(m) as m0, max(m) as m1 from k),
grid as (select artist_id, i, m0, m0 + 3 * i as m from (select distinct artist_id from k), (select m0, unnest(range(0, (m1 - m0) // 3 + 1)) as i from ends)),
g as (select grid.*, coalesce(n, 0) as plays from grid left join k using (artist_id, m)),
r as (select *, sum(plays) over (partition by artist_id order by i rows between 3 preceding and current row) as rolling,
  case when i >= 7 then sum(plays) over (partition by artist_id order by i rows between 7 preceding and 4 preceding) end as baseline from g),
s as (select *, rolling / sum(rolling) over (partition by i) as share, dense_rank() over (partition by i order by rolling desc) as rank, plays >= 3 and rolling >= 12 as active from r),
f as (select *, max(case when not active then i end) over (partition by artist_id order by i) as stop from s),
c as (select *, case when active then i - coalesce(stop, -1) else 0 end as consecutive from f),
q as (select artist_id, cast(i as int) as window_index, cast(m as int) as start_month, cast(plays as bigint) as plays, cast(rolling as bigint) as rolling, share, rank, consecutive, cast(baseline as bigint) as baseline,
  active and share >= 0.02 and rank <= 20 and consecutive >= 2 and coalesce(rolling - baseline >= -12, true) as is_qualified,
  (least(1, plays / 3) + least(1, rolling / 12) + least(1, share / 0.02) + greatest(0, least(1, (21 - rank) / 20)) + least(1, consecutive / 2) + case when baseline is null then 0 else greatest(0, least(1, (rolling - baseline + 12) / 12)) end) / case when baseline is null then 5 else 6 end as strength
  from c where rolling > 0)"""
_INTERVALS = """isl as (select *, window_index - row_number() over (partition by artist_id order by window_index) as island from q where is_qualified),
era as (select artist_id, min(start_month) as start_month, max(start_month) + 3 as end_month, cast(sum(plays) as bigint) as play_count, avg(share) as share, max(strength) as strength, arg_max(start_month, (strength, rolling, -start_month)) as peak from isl group by artist_id, island)"""
_MONTH = "lpad(cast({0} // 12 as varchar), 4, '0') || '-' || lpad(cast({0} % 12 + 1 as varchar), 2, '0')"


def _windows(spark, d):
    return eras.era_windows(history.canonical_base(spark, d), tz=TZ)


register("n2_era_windows", lambda spark, d: _windows(spark, d).drop("window_start"), f"{_BASE}, {_ERAS} select * from q")
register(
    "n3_era_intervals", lambda spark, d: eras.era_intervals(_windows(spark, d)).drop("evidence"),
    f"{_BASE}, {_ERAS}, {_INTERVALS} select artist_id, start_month, end_month, {_MONTH.format('start_month')} as window_start, {_MONTH.format('end_month')} as window_end_exclusive, play_count, share, strength, {_MONTH.format('peak')} as peak_start from era",
)
register(
    "n3_era_evidence", lambda spark, d: eras.era_intervals(_windows(spark, d)).select("artist_id", "window_start", F.explode("evidence").alias("e")).select("artist_id", "window_start", "e.window_index", "e.plays", "e.rolling"),
    f"{_BASE}, {_ERAS}, isl as (select *, window_index - row_number() over (partition by artist_id order by window_index) as island from q where is_qualified), b as (select *, min(start_month) over (partition by artist_id, island) as b from isl) select artist_id, {_MONTH.format('b')} as window_start, window_index, plays, rolling from b",
)


# Rediscovery and abandonment ------------------------------------------------------------------------------------------
def _rediscoveries(scope: str):
    def query(spark, d):
        base = history.canonical_base(spark, d)
        return returns.rediscoveries(base, eras.era_intervals(eras.era_windows(base, tz=TZ)), scope, prior_plays=5 if scope == "artist" else 1, tz=TZ)

    return query


def _rediscovery_sql(entity: str, prior: int) -> str:
    day = 86_400_000
    local = lambda x: f"year(timezone('{TZ}', timezone('UTC', make_timestamp(({x}) * 1000)))) * 12 + month(timezone('{TZ}', timezone('UTC', make_timestamp(({x}) * 1000)))) - 1"
    return f"""{_BASE}, {_ERAS}, {_INTERVALS}, obs as (select max(instant_ms) as observed from base),
o as (select {entity} as entity_id, artist_id, event_id, instant_ms, lag(instant_ms) over w as prior_ms, row_number() over w - 1 as prior_play_count from base window w as (partition by {entity} order by instant_ms, event_id)),
h as (select o.*, observed, {local('instant_ms')} as month, {local(f'instant_ms + {120 * day}')} as horizon,
  (select count(*) from base b where b.{entity} = o.entity_id and b.instant_ms >= o.instant_ms and b.instant_ms < o.instant_ms + {30 * day}) as return_intensity,
  (select count(*) from base b where b.{entity} = o.entity_id and b.instant_ms >= o.instant_ms + {30 * day} and b.instant_ms < o.instant_ms + {120 * day}) as persistence_play_count
  from o, obs where instant_ms - prior_ms >= {180 * day} and prior_play_count >= {prior}),
p as (select *, case when observed < instant_ms + {120 * day} then 'open' when persistence_play_count >= 2 then 'persistent' else 'not_persistent' end as persistence,
  (select min(start_month) from era where era.artist_id = h.artist_id and ((start_month <= month and month < end_month) or start_month between month and horizon)) as era_start from h)
select entity_id, event_id, instant_ms, prior_ms, (instant_ms - prior_ms) / {day}.0 as gap_days, prior_play_count, return_intensity, persistence_play_count, persistence, observed >= instant_ms + {30 * day} as return_window_complete, era_start,
  case when era_start >= month then 'return_beginning_new_era' when persistence = 'persistent' then 'sustained_rediscovery' else 'one_off_return' end as classification from p"""


register("n4_rediscovery_artist", _rediscoveries("artist"), _rediscovery_sql("artist_id", 5))
register("n4_rediscovery_track", _rediscoveries("track"), _rediscovery_sql("track_id", 1))
_ABANDON = """{base}, b as (select * from base where instant_ms <= {end}), obs as (select {observed} as observed from b),
s as (select *, max(instant_ms) over (partition by artist_id) as last_ms, case when instant_ms - lag(instant_ms) over (partition by artist_id order by instant_ms, event_id) > 7776000000 then 1 else 0 end as split from b),
p as (select *, sum(split) over (partition by artist_id order by instant_ms, event_id) as period from s),
g as (select artist_id, period, min(instant_ms) as a, max(instant_ms) as z, count(*) as n, sum(case when instant_ms >= last_ms - 15552000000 then 1 else 0 end) as cad from p group by artist_id, period),
x as (select artist_id, sum(n) as hist, sum(cad) as cad, count(*) as periods, arg_max(a, period) as a, arg_max(z, period) as z, arg_max(n, period) as n from g group by artist_id),
y as (select *, (observed - z) / 86400000.0 as absence from x, obs)
select artist_id, absence as absence_days, periods as active_period_count, cast(hist as bigint) as historical_play_count, cast(cad as bigint) as cadence_play_count, cast(cad as double) * 30 / 180 as cadence_per_30_days, a as period_start_ms, z as last_listen_ms, n as period_play_count,
  (least(1.0, hist / 10) + least(1.0, cad / 6) + least(1.0, absence / 365)) / 3 as confidence, case when absence >= 365 then 'likely_abandoned_as_of' else 'dormant' end as status from y where hist >= 5 and absence >= 180 and cad >= 3"""
register("n5_abandonment", lambda spark, d: returns.abandonments(history.canonical_base(spark, d)), _ABANDON.format(base=_BASE, end="9e18", observed="max(instant_ms)"))
_ASOF = 946_684_800_000
register("n5_abandonment_as_of", lambda spark, d: returns.abandonments(history.canonical_base(spark, d), as_of_ms=_ASOF), _ABANDON.format(base=_BASE, end=_ASOF, observed=f"any_value({_ASOF}::bigint)"))

# Evidence -------------------------------------------------------------------------------------------------------------
def _interval_members(spark, d) -> DataFrame:
    e = history.table(spark, d, "events")
    uri = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit("spotify:track:short")).otherwise(F.concat(F.lit("spotify:track:"), F.lpad(F.col("event_id").cast("string"), 22, "0")))
    record = F.struct(
        F.when(F.col("event_id") % 13 == 0, F.lit("2024-02-30T00:00:00Z")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"), F.when(F.col("event_id") % 17 == 0, F.lit(-1)).otherwise(F.floor(F.col("value") * 1000)).cast("long").alias("ms_played"),
        uri.alias("spotify_track_uri"), F.when(F.col("event_id") % 14 == 0, F.lit("An episode")).alias("episode_name"), F.when(F.col("event_id") % 19 == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("master_metadata_album_artist_name"),
        F.lit("t").alias("master_metadata_track_name"), F.when(F.col("event_id") % 23 != 0, F.lit(False)).alias("shuffle"),
    )
    return e.select("event_id", F.parse_json(F.to_json(record)).alias("record"))


register(
    "p1_classify_interval", lambda spark, d: evidence.classify_interval(_interval_members(spark, d)).select("event_id", "kind", "reason", "ms_played"),
    """with r as (select event_id, case when event_id % 13 = 0 then 'invalid_timestamp' when event_id % 17 = 0 then 'invalid_duration' when event_id % 23 = 0 then 'invalid_field_type' when event_id % 7 = 0 then case when event_id % 14 = 0 then 'episode_or_audiobook' else 'video_or_unsupported' end
when event_id % 11 = 0 then 'invalid_track_uri' when event_id % 19 = 0 then 'invalid_track_metadata' end as reason, case when event_id % 17 = 0 then -1 else cast(floor(value * 1000) as bigint) end as ms_played from events)
select event_id, case when reason is null then 'track' when reason in ('episode_or_audiobook', 'video_or_unsupported') then 'excluded' else 'malformed' end as kind, reason, ms_played from r""",
)
register("p12_outcome_counts", lambda spark, d: evidence.outcome_counts(evidence.classify_interval(_interval_members(spark, d))), ORACLES["p1_classify_interval"].replace("select event_id, case when reason is null", ", c as (select event_id, case when reason is null") + ") select kind, reason, count(*) as n from c group by all")


def _instant_members(spark, d) -> DataFrame:
    e = history.table(spark, d, "events")
    record = F.struct(
        F.when(F.col("event_id") % 5 == 0, F.lit("soon")).otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("timestamp"), F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("artist_name"),
        F.when(F.col("event_id") % 11 != 0, F.lit("t")).alias("track_name"), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("album")).alias("album_name"),
    )
    text = F.regexp_replace(F.to_json(record), '"timestamp":"(\\d+)"', '"timestamp":$1')
    return e.select("event_id", F.parse_json(text).alias("record"))


register(
    "p2_classify_instant", lambda spark, d: evidence.classify_instant(_instant_members(spark, d)).select("event_id", "kind", "reason", "instant_ms", "album"),
    """with r as (select event_id, case when event_id % 5 = 0 then 'invalid_timestamp' when event_id % 11 = 0 then 'invalid_field_type' when event_id % 7 = 0 then 'invalid_required_text' end as reason,
case when event_id % 5 <> 0 then epoch_us(ts) // 1000 end as instant_ms, case when event_id % 3 <> 0 then 'album' end as album from events)
select event_id, case when reason is null then 'scrobble' else 'malformed' end as kind, reason, instant_ms, album from r""",
)
_SPACED = "trim(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[\\p{{P}}\\p{{S}}]', '', 'g'), '\\s+', ' ', 'g'))"
register("f1_match_text_parts", lambda spark, d: history.table(spark, d, "part").select("p_partkey", match_text(F.concat(F.upper("p_name"), F.lit(" - ("), F.col("p_brand"), F.lit(")"))).alias("key")), f"select p_partkey, {_SPACED.format("upper(p_name) || ' - (' || p_brand || ')'")} as key from part")
register("f1_match_text_documents", lambda spark, d: history.table(spark, d, "documents").select("doc_id", F.sha2(match_text(F.col("text")), 256).alias("key_hash")), r"""with k as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '\b(?:feat(?:\.|uring)?|ft\.?)\b', ' feat ', 'g'), '[\p{P}\p{S}]', '', 'g'), '[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) as k from documents)
select doc_id, sha256(nullif(k, '')) as key_hash from k""")
register("f2_fingerprints", lambda spark, d: history.interval_plays(spark, d).select("record_id", evidence.fingerprint("play-v1", "interval", at=F.col("stopped_at_ms"), ms=F.col("ms_played"), artist=F.col("artist"), track=F.col("track"), listener=F.col("listener")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("fingerprints")), f"{_EVIDENCE}, g as (select count(*) as n from plays group by stopped_at_ms, ms_played, artist, track, listener) select n, count(*) as fingerprints from g group by n")
register("f3_overlap_fingerprints", lambda spark, d: history.instant_scrobbles(spark, d).groupBy(evidence.overlap_fingerprint(F.col("instant_ms"), F.col("artist"), F.col("track")).alias("fp")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("fingerprints")), f"{_EVIDENCE}, g as (select count(*) as n from scrobbles group by instant_ms, artist, track) select n, count(*) as fingerprints from g group by n")
register("f14_scopes", lambda spark, d: history.table(spark, d, "customer").select("c_custkey", evidence.scope_hash(F.col("c_name")).alias("scope"), evidence.file_locator(F.col("c_name")).alias("locator")), """select c_custkey, sha256('lastfm-sync-scope-v1' || chr(0) || c_name) as scope, 'lastfm/path-' || sha256('lastfm-path-v1' || chr(0) || c_name) || '.json' as locator from customer""")


def _files(spark, d, known: bool) -> DataFrame:
    """Files named by parts: known ones of every second part, of which some have other content, type or size, and some another name."""
    k = F.col("p_partkey")
    p = history.table(spark, d, "part")
    p = p.where("p_partkey % 2 = 0") if known else p
    return p.select(
        F.concat(F.when((k % 3 == 0) & F.lit(known), F.lit("old-")).otherwise(F.lit("file-")), k.cast("string")).alias("path"), F.when((k % 10 == 4) & F.lit(known), F.lit("other")).otherwise(F.lit("export")).alias("source_type"),
        (k + F.when((k % 14 == 6) & F.lit(known), 1).otherwise(0)).alias("byte_size"), F.sha2(F.concat(k.cast("string"), F.when((k % 22 == 8) & F.lit(known), F.lit("x")).otherwise(F.lit(""))), 256).alias("content_sha256"),
    )


register("s4_registration", lambda spark, d: evidence.registration(_files(spark, d, False), _files(spark, d, True)), """with p as (select p_partkey as k from part)
select 'file-' || k as path, 'export' as source_type, sha256(k::varchar) as content_sha256, case when k % 2 = 1 then 'new' when k % 3 <> 0 then case when k % 22 = 8 then 'changed' when k % 10 = 4 or k % 14 = 6 then 'malformed' else 'known' end
  when k % 22 = 8 or k % 10 = 4 then 'new' when k % 14 = 6 then 'malformed' else 'known_elsewhere' end as outcome from p""")
register("v1_missing_files", lambda spark, d: evidence.missing_files(_files(spark, d, True), _files(spark, d, False)), """with p as (select p_partkey as k from part where p_partkey % 2 = 0), f as (select case when k % 3 = 0 then 'old-' else 'file-' end || k as path, case when k % 3 = 0 then 'missing' when k % 14 = 6 then 'size' when k % 22 = 8 then 'content' end as fault from p)
select * from f where fault is not null""")


def _export_files(spark, d) -> DataFrame:
    """A file of scrobbles for each user: an array, for every third user a wrapper object, for every seventh neither."""
    e = history.table(spark, d, "events")
    flat = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_type").alias("artist_name"), F.when(F.col("event_id") % 5 != 0, F.lit("t")).otherwise(F.lit("\t")).alias("track_name"), F.lit(None).cast("string").alias("album_name"))
    inner = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("date"), F.col("event_type").alias("artist"), F.when(F.col("event_id") % 5 != 0, F.lit("t")).otherwise(F.lit("\t")).alias("track"), F.lit("album").alias("album"), F.lit("rel").alias("albumId"))
    g = e.groupBy("user_id").agg(F.to_json(F.collect_list(flat)).alias("flat"), F.to_json(F.struct(F.lit("me").alias("user"), F.collect_list(inner).alias("scrobbles"))).alias("wrapped"))
    return g.select(F.concat(F.lit("user-"), "user_id").alias("file"), F.when(F.col("user_id") % 7 == 0, F.lit("{}")).when(F.col("user_id") % 3 == 0, F.col("wrapped")).otherwise(F.col("flat")).alias("value"))


register("s2_export_members", lambda spark, d: evidence.classify_export(_export_files(spark, d)).groupBy("file", "kind", "reason", "album", "release_mbid").agg(F.count("*").alias("n"), F.sum("instant_ms").alias("instants")), """select 'user-' || user_id as file, case when event_id % 5 = 0 then 'malformed' else 'scrobble' end as kind, case when event_id % 5 = 0 then 'invalid_required_text' end as reason,
case when user_id % 3 = 0 then 'album' end as album, case when user_id % 3 = 0 then 'rel' end as release_mbid, count(*) as n, cast(sum(epoch_us(ts) // 1000) as bigint) as instants from events where user_id % 7 <> 0 group by all""")
register("s2_file_faults", lambda spark, d: evidence.file_faults(_export_files(spark, d), "scrobbles"), "select distinct 'user-' || user_id as file from events where user_id % 7 = 0")
register("s9_rejections", lambda spark, d: evidence.rejected(evidence.classify_export(_export_files(spark, d)), "file", "ordinal").groupBy("file", "error_code").agg(F.count("*").alias("n")), "select 'user-' || user_id as file, 'invalid_required_text' as error_code, count(*) as n from events where user_id % 7 <> 0 and event_id % 5 = 0 group by all")


def _landed_pages(spark, d) -> DataFrame:
    """A page of recent tracks for each order, its lines being tracks; line 1 of every fifth order plays now, some miss their time."""
    l = history.table(spark, d, "lineitem")
    now = (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 5 == 0)
    uts = F.when((F.col("l_partkey") % 17 != 0) & ~now, F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string"))
    track = F.struct(
        F.concat(F.lit("Track "), "l_partkey").alias("name"), F.lit("").alias("mbid"), F.struct(F.concat(F.lit("Artist "), "l_suppkey").alias("#text"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("a"), "l_suppkey")).otherwise(F.lit("")).alias("mbid")).alias("artist"),
        F.struct(F.lit(" ").alias("#text"), F.lit("").alias("mbid")).alias("album"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("1")).alias("loved"), F.when(~now, F.struct(uts.alias("uts"))).alias("date"), F.when(now, F.struct(F.lit("true").alias("nowplaying"))).alias("@attr"),
    )
    head = F.struct(F.lit("1").alias("page"), F.lit("200").alias("perPage"), F.count("*").cast("string").alias("total"), F.lit("1").alias("totalPages"))
    return l.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(head.alias("@attr"), F.collect_list(track).alias("track")).alias("recenttracks"))).alias("value")).select(F.col("l_orderkey").alias("file"), "value")


register("s6_landed_tracks", lambda spark, d: evidence.landed_tracks(_landed_pages(spark, d)).groupBy("file", "now_playing", "fault").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.sum("instant_ms").alias("instants"), F.count("artist_mbid").alias("mbids"), F.count_if("loved").alias("loved"), F.count("album").alias("albums")), """with t as (select l_orderkey as file, l_linenumber = 1 and l_orderkey % 5 = 0 as now_playing, l_partkey % 17 = 0 as bad, l_suppkey, l_linenumber, epoch_us(l_shipdate) // 1000000 * 1000 as ms, count(*) over (partition by l_orderkey) as total from lineitem)
select file, now_playing, bad and not now_playing as fault, count(*) as n, max(total) as total, cast(sum(case when not bad and not now_playing then ms end) as bigint) as instants, count(case when l_suppkey % 2 = 0 then 1 end) as mbids, count(case when l_linenumber % 2 = 0 then 1 end) as loved, cast(0 as bigint) as albums from t group by file, now_playing, bad and not now_playing""")

# Reconciliation -------------------------------------------------------------------------------------------------------
_IDENTITY = """a1 as (select *, case when artist_mbid is not null then min(record_id) over (partition by artist_mbid) end as strong_artist, case when recording_id is not null then min(record_id) over (partition by recording_id) end as strong_track, first_value(album is not null or release_mbid is not null) over (partition by recording_id order by record_id) as with_release,
  case when release_mbid is not null then min(record_id) over (partition by release_mbid) end as strong_release from rec),
src as (select name, min(strong_artist) as alias_artist from a1 group by name having count(distinct strong_artist) = 1), fr as (select name, min(record_id) as fresh_artist from a1 where artist_mbid is null group by name),
a2 as (select a1.*, alias_artist, coalesce(strong_artist, alias_artist, fresh_artist) as own_artist from a1 left join src using (name) left join fr using (name)),
cp as (select own_artist, title, album, min(case when with_release = (album is not null) then strong_track end) as low, max(case when with_release = (album is not null) then strong_track end) as high, min(case when recording_id is null then record_id end) as fresh_track from a2 group by all),
a3 as (select a2.*, low, coalesce(strong_track, case when low = high then low end, fresh_track) as track_id from a2 join cp on a2.own_artist = cp.own_artist and a2.title = cp.title and a2.album is not distinct from cp.album),
fst as (select track_id, own_artist as artist_id, coalesce(strong_release, case when album is not null then record_id end) as release_id from a3 where track_id = record_id),
res as (select a3.*, artist_id, release_id, case when recording_id is not null then 'trusted_identifier' when track_id <> record_id then 'conservative_composite' when artist_mbid is not null then 'trusted_identifier' when own_artist <> record_id then 'known_alias' else 'new_unresolved' end as kind from a3 join fst using (track_id))"""
_MT = "trim(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[\\p{{P}}\\p{{S}}]', '', 'g'), '\\s+', ' ', 'g'))"
_PAIRS = f"""rec as (select record_id, {_MT.format("artist")} as name, {_MT.format("track")} as title, {_MT.format("album")} as album, null::varchar as artist_mbid, 'uri:' || track_uri as recording_id, null::varchar as release_mbid from plays
  union all select record_id, {_MT.format("artist")}, {_MT.format("track")}, {_MT.format("album")}, artist_mbid, 'mbid:' || recording_mbid, null from scrobbles), {_IDENTITY},
tk as (select distinct t.track_id, n.name as kn, m.title as kt from (select distinct track_id, artist_id from res) t join (select distinct artist_id, name from res) n using (artist_id) join (select distinct track_id, title from res) m using (track_id)),
tp as (select distinct a.track_id as x, b.track_id as y from tk a join tk b on a.kn = b.kn and a.kt = b.kt),
pr as (select p.record_id as play_id, s.record_id as scrobble_id, p.listener, ms_played, skipped, stopped_at_ms - ms_played as start_ms, instant_ms, recording_mbid, rp.artist_id as pa, rs.artist_id as sa, rp.track_id as pt, rs.track_id as st, rp.name as pn, rs.name as sn, rp.title as ptt, rs.title as stt, rp.album as pal, rs.album as sal
  from kp p join res rp on rp.record_id = p.record_id join ks s on s.listener = p.listener and abs(instant_ms - (stopped_at_ms - ms_played)) <= 30000 join res rs on rs.record_id = s.record_id join tp on tp.x = rp.track_id and tp.y = rs.track_id)"""
# Pairs in the order of ids; at the least distance a walk meets, in this order: the later start's pairs below the earlier start's highest (0), the earlier start's backwards (1), the rest of the later start's (2).
_NEAR = """px as (select *, row_number() over (order by play_id, scrobble_id) as ix from pr), mx as (select listener, start_ms, max(ix) as top from px group by all),
nc as (select a.play_id, a.scrobble_id, a.listener, a.ix as own, a.start_ms as s0, b.ix, b.start_ms as near_start, b.instant_ms as near_instant, abs(b.start_ms - a.start_ms) as dist from px a join px b on a.listener = b.listener and a.play_id <> b.play_id and a.scrobble_id <> b.scrobble_id
  qualify rank() over (partition by a.ix order by abs(b.start_ms - a.start_ms)) = 1),
nv as (select nc.*, case when dist = 0 then case when ix < own then 1 else 2 end when near_start < s0 then 1 when ix < top then 0 else 2 end as phase from nc left join mx on mx.listener = nc.listener and mx.start_ms = s0 - dist),
nr as (select play_id, scrobble_id, near_start, near_instant from nv qualify row_number() over (partition by play_id, scrobble_id order by phase desc, case when phase = 1 then ix else -ix end) = 1)"""
_SCORES = _NEAR + """, dg as (select pr.*, near_start, near_instant, instant_ms - start_ms as delta_ms, count(*) over (partition by pr.play_id) as play_degree, count(*) over (partition by pr.scrobble_id) as scrobble_degree from pr left join nr on pr.play_id = nr.play_id and pr.scrobble_id = nr.scrobble_id),
sc as (select *, case when recording_mbid is not null then case when pt = st then 1.0 else 0.0 end end as identifier_score, case when pn = sn then 1.0 when pa = sa then 0.75 else 0.0 end as artist_score, case when ptt = stt then 1.0 when pt = st then 0.75 else 0.0 end as track_score,
  case when pal is not null and sal is not null then case when pal = sal then 1.0 else 0.0 end end as album_score, 1 - least(1.0, abs(delta_ms) / 30000) as time_score, greatest(0.0, 1 - abs(delta_ms) / greatest(ms_played, 30000)) as duration_score,
  case when near_start <> start_ms and near_instant <> instant_ms then case when (near_start > start_ms) = (near_instant > instant_ms) then 1.0 else 0.0 end end as ordering_score,
  1.0 / greatest(play_degree, scrobble_degree)::double as competing_score, case when ms_played >= 30000 and not coalesce(skipped, false) then 1.0 else 0.0 end as short_score from dg),
cf as (select *, (coalesce(identifier_score * 0.25, 0) + artist_score::double * 0.15 + track_score::double * 0.2 + coalesce(album_score * 0.1, 0) + time_score * 0.15 + duration_score * 0.05 + coalesce(ordering_score * 0.05, 0) + competing_score * 0.05 + short_score * 0.05)
  / (0.65 + case when identifier_score is not null then 0.25 else 0 end + case when album_score is not null then 0.1 else 0 end + case when ordering_score is not null then 0.05 else 0 end)::double as confidence from sc),
dc as (select *, case when identifier_score = 0 then 'review' when competing_score <> 1 then 'review' when confidence >= 0.95 then 'accept' when confidence >= 0.7 then 'review' else 'ignore' end as decision from cf)"""


def _sources(spark, d):
    return history.interval_plays(spark, d), history.instant_scrobbles(spark, d), history.SAME_PLAY, history.SAME_SCROBBLE


def _chain(spark, d) -> reconciliation.Reconciled:
    return reconciliation.reconciled(*_sources(spark, d))


def _pairs(spark, d):
    return reconciliation.candidates(*_sources(spark, d))[-1]


def _scored(spark, d):
    return _chain(spark, d).scores


_FEATURES = ["identifier_score", "artist_score", "track_score", "album_score", "time_score", "duration_score", "ordering_score", "competing_score", "short_score"]
register("r1_candidate_pairs", lambda spark, d: _pairs(spark, d).select("play_id", "scrobble_id", "start_ms", "instant_ms", "reason"), f"{_EVIDENCE}, {_PAIRS} select play_id, scrobble_id, start_ms, instant_ms, case when pt = st then 'shared_track_identity' else 'matching_normalized_artist_track' end as reason from pr")
register("r7_scored_pairs", lambda spark, d: _scored(spark, d).select("play_id", "scrobble_id", "delta_ms", "play_degree", "scrobble_degree", *(F.round(f, 9).alias(f) for f in _FEATURES), F.round("confidence", 9).alias("confidence"), "decision"), f"{_EVIDENCE}, {_PAIRS}, {_SCORES} select play_id, scrobble_id, delta_ms, play_degree, scrobble_degree, {', '.join(f'round(cast({f} as double), 9) as {f}' for f in _FEATURES)}, round(confidence, 9) as confidence, decision from dc")
register("r6_nearest_neighbours", lambda spark, d: reconcile.nearest_independent(_pairs(spark, d)), f"{_EVIDENCE}, {_PAIRS}, {_NEAR} select * from nr")
register("r6_ordering_scores", lambda spark, d: _scored(spark, d).select("play_id", "scrobble_id", "ordering_score", F.round("confidence", 9).alias("confidence"), "decision"), f"{_EVIDENCE}, {_PAIRS}, {_SCORES} select play_id, scrobble_id, cast(ordering_score as double) as ordering_score, round(confidence, 9) as confidence, decision from dc")
_EVENTS = f"""{_EVIDENCE}, {_PAIRS}, {_SCORES}, mg as (select play_id, scrobble_id from dc where decision = 'accept'),
ev_all as (select p.record_id as event_id, listener, artist_id, track_id, stopped_at_ms - ms_played as started_ms, stopped_at_ms as ended_ms, 'derived_start' as time_basis, case when kind = 'new_unresolved' then 'unresolved' else 'current' end as event_status, ms_played as listened_ms, scrobble_id
  from kp p join res on res.record_id = p.record_id left join mg on p.record_id = play_id
  union all select s.record_id, listener, artist_id, track_id, instant_ms, null, 'observed_start', case when kind = 'new_unresolved' then 'unresolved' else 'current' end, null, null from ks s join res on res.record_id = s.record_id where s.record_id not in (select scrobble_id from mg)),
dup as (select 'interval' as source, record_id, keeper from pk where record_id <> keeper union all select 'instant', record_id, keeper from sk where record_id <> keeper),
lk1 as (select event_id, event_id as record_id, case when time_basis = 'derived_start' then 'interval' else 'instant' end as source, 'primary' as role from ev_all union all select event_id, scrobble_id, 'instant', 'cross_source_match' from ev_all where scrobble_id is not null),
lk as (select * from lk1 union all select event_id, dup.record_id, dup.source, 'exact_duplicate' from dup join lk1 on lk1.record_id = keeper and lk1.source = dup.source),
bk as (select event_id, count(*) as source_record_count, count(case when source = 'interval' then 1 end) as interval_record_count, count(case when source = 'instant' then 1 end) as instant_record_count from lk group by 1),
cb as (select ev_all.*, source_record_count, interval_record_count, instant_record_count, interval_record_count > 0 as has_interval, instant_record_count > 0 as has_instant, coalesce(started_ms, ended_ms) as instant_ms,
  case when event_status = 'unresolved' then 'unresolved' when interval_record_count > 0 and instant_record_count > 0 then 'cross_source_reconciled' else 'single_source' end as status from ev_all join bk using (event_id))"""


def _canonical(spark, d):
    c = _chain(spark, d)
    return reconcile.canonical_base(c.events, c.links)


register("r10_canonical_events", lambda spark, d: _chain(spark, d).events, f"{_EVENTS} select * from ev_all")
register("r17_links", lambda spark, d: _chain(spark, d).links, f"{_EVENTS} select * from lk")
register("a1_source_backing", lambda spark, d: reconcile.source_backing(_chain(spark, d).links), f"{_EVENTS} select *, interval_record_count > 0 as has_interval, instant_record_count > 0 as has_instant from bk")
register("s7_canonical_base", _canonical, f"{_EVENTS} select * from cb")
register("p11_unprocessed", lambda spark, d: evidence.unprocessed(_both(spark, d), _chain(spark, d).links.where("role != 'exact_duplicate'")), f"{_EVENTS} select 'interval' as source, record_id, stopped_at_ms as at_ms, null as recording_mbid from pk where record_id <> keeper union all select 'instant', record_id, instant_ms, recording_mbid from sk where record_id <> keeper")


def _feature_table(spark, d) -> DataFrame:
    s = _scored(spark, d)
    k = F.col("play_id")
    state = F.when(k % 8 == 0, "pending").otherwise("accepted").alias("state")
    old = s.where(k % 6 != 0).select("play_id", "scrobble_id", F.lit("v1").alias("version"), state, F.lit(0.5).alias("confidence"))
    other = s.where(k % 10 == 0).select("play_id", "scrobble_id", F.lit("v0").alias("version"), state, F.lit(0.25).alias("confidence"))
    return reconcile.refreshed_features(old.unionByName(other), s, "v1").withColumn("confidence", F.round("confidence", 9))


register("r8_refreshed_features", _feature_table, f"""{_EVIDENCE}, {_PAIRS}, {_SCORES} select play_id, scrobble_id, 'v1' as version, case when play_id % 6 = 0 or play_id % 8 = 0 then 'pending' else 'accepted' end as state, case when play_id % 6 = 0 or play_id % 8 = 0 then round(confidence, 9) else 0.5 end as confidence from dc
union all select play_id, scrobble_id, 'v0', case when play_id % 8 = 0 then 'pending' else 'accepted' end, 0.25 from dc where play_id % 10 = 0""")
register("r16_calibration_sample", lambda spark, d: reconcile.stratified_sample(_scored(spark, d), "decision", 20, "calibration-v1").select("play_id", "scrobble_id", "decision", "hash"), f"""{_EVIDENCE}, {_PAIRS}, {_SCORES}, h as (select play_id, scrobble_id, decision, sha256('calibration-v1:' || play_id || ':' || scrobble_id) as hash from dc)
select * from h qualify row_number() over (partition by decision order by hash, play_id, scrobble_id) <= 20""")
register("i11_duplicates", lambda spark, d: reconciliation.duplicates_of(*_sources(spark, d)), f"{_EVIDENCE} select 'interval' as source, record_id, keeper from pk where record_id <> keeper union all select 'instant', record_id, keeper from sk where record_id <> keeper")
register("i9_merge_roots", lambda spark, d: reconcile.merge_roots(history.table(spark, d, "orders").where("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("subject"), F.floor(F.col("o_orderkey") / 2).alias("object"))), """with recursive m as (select o_orderkey as s, o_orderkey // 2 as o from orders where o_orderkey % 3 <> 0), w as (select s as node, o as root from m union all select node, m.o from w join m on w.root = m.s)
select node, min(root) as root from w group by node""")


# Coverage and quality -------------------------------------------------------------------------------------------------
def _both(spark, d) -> DataFrame:
    p = history.interval_plays(spark, d).select(F.lit("interval").alias("source"), "record_id", F.col("stopped_at_ms").alias("at_ms"), F.lit(None).cast("string").alias("recording_mbid"))
    return p.unionByName(history.instant_scrobbles(spark, d).select(F.lit("instant").alias("source"), "record_id", F.col("instant_ms").alias("at_ms"), "recording_mbid"))


_BOTH = f"{_EVIDENCE}, u as (select 'interval' as source, record_id, stopped_at_ms as at_ms, null as recording_mbid from plays union all select 'instant', record_id, instant_ms, recording_mbid from scrobbles)"
register("c1_by_year", lambda spark, d: coverage.by_year(_both(spark, d), "at_ms", TZ), f"{_BOTH} select source, cast(year({_LOCAL.replace('instant_ms', 'at_ms')}) as int) as year, count(*) as n from u group by all")
register("c2_observed_ranges", lambda spark, d: coverage.observed_ranges(_both(spark, d), "at_ms"), f"{_BOTH} select source, min(at_ms) as first_ms, max(at_ms) as last_ms, count(*) as n from u group by source")
register("c4_duplicates", lambda spark, d: coverage.duplicate_totals(history.interval_plays(spark, d), *history.SAME_PLAY), f"{_EVIDENCE}, g as (select count(*) as n from plays group by listener, stopped_at_ms, ms_played, artist, track, album, track_uri having count(*) > 1) select count(*) as duplicate_groups, cast(coalesce(sum(n - 1), 0) as bigint) as extra_records from g")
register("c5_missing_fields", lambda spark, d: coverage.missing_fields(_both(spark, d), "recording_mbid", "at_ms"), f"{_BOTH} select f as field, case when f = 'at_ms' then count(*) - count(at_ms) else count(*) - count(recording_mbid) end as missing, count(*) as total, missing / count(*) as rate from u, (select unnest(['recording_mbid', 'at_ms']) as f) group by f")


def _by_artist(spark, d):
    return history.canonical_base(spark, d).select(F.col("artist_id").alias("source"), "instant_ms")


register("c6_long_gaps", lambda spark, d: coverage.long_gaps(_by_artist(spark, d), "instant_ms"), f"{_BASE}, g as (select artist_id as source, lag(instant_ms) over (partition by artist_id order by instant_ms) as from_ms, instant_ms as to_ms from base) select * from g where to_ms - from_ms >= 365 * 86400000::bigint")
register("c7_backing", lambda spark, d: coverage.backing(_canonical(spark, d)), f"{_EVENTS} select case when has_interval and has_instant then 'both' when has_interval then 'interval_only' else 'instant_only' end as backing, count(*) as n from cb group by 1")
register(
    "v_checks",
    lambda spark, d: coverage.violations(
        duplicate_event=coverage.not_unique(history.canonical_base(spark, d), "event_id"), unknown_artist=coverage.orphans(history.canonical_base(spark, d), "artist_id", history.table(spark, d, "customer"), "c_custkey"),
        no_duration=coverage.outside(history.canonical_base(spark, d), F.col("listened_ms") >= 0), line_key=coverage.not_unique(history.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber"),
        ordinals=coverage.ordinal_gaps(history.table(spark, d, "conversations"), "conv_id", "turn"),
    ),
    f"""{_BASE} select 'duplicate_event' as code, count(*) as violations from (select event_id from base group by 1 having count(*) > 1) union all select 'unknown_artist', count(*) from base where artist_id is not null and artist_id not in (select c_custkey from customer)
union all select 'no_duration', count(*) from base where coalesce(listened_ms >= 0, false) = false union all select 'line_key', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'ordinals', count(*) from (select 1 from conversations group by conv_id having min(turn) <> 0 or max(turn) <> count(*) - 1 or count(distinct turn) <> count(*))""",
)


# Synchronization and envelope -----------------------------------------------------------------------------------------
def _sync(spark, d):
    c = history.table(spark, d, "customer")
    scopes = c.select(F.col("c_custkey").alias("scope"), F.when(F.col("c_custkey") % 5 == 0, F.lit(1000)).cast("long").alias("explicit_from_ms"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey") * 90_000).alias("explicit_to_ms"), F.when(F.col("c_custkey") % 3 == 0, F.lit(2000)).cast("long").alias("initial_ms"))
    cursors = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("scope"), (F.col("c_custkey") * 100_000).alias("boundary_ms"))
    return scopes, cursors, history.canonical_base(spark, d).select(F.col("artist_id").alias("scope"), "instant_ms")


_SYNC = f"""{_BASE}, l as (select artist_id as scope, max(instant_ms) as top from base group by 1),
pl as (select c_custkey as scope, case when c_custkey % 5 = 0 then 1000 end as ex, case when c_custkey % 7 = 0 then c_custkey * 90000 end as ends, case when c_custkey % 2 = 0 then c_custkey * 100000 end as cur, case when c_custkey % 3 = 0 then 2000 end as ini, top from customer left join l on scope = c_custkey),
pm as (select *, case when coalesce(ex, cur, ini, top) is not null then greatest(0, coalesce(ex, cur - 300000, ini, top - 300000)) end as from_ms from pl),
plan as (select scope, from_ms, ends as to_ms, case when ends < from_ms then 'invalid_bounds' when ex is not null then 'explicit' when cur is not null then 'cursor' when ini is not null then 'initial' when top is not null then 'evidence' else 'none' end as basis, ex is null and ends is null as advances, cur, top from pm)"""
register("k1_sync_plan", lambda spark, d: sync.sync_plan(*_sync(spark, d)), f"{_SYNC} select scope, cast(from_ms as bigint) as from_ms, to_ms, basis, advances from plan")
register("k3_cursors", lambda spark, d: sync.advanced_cursors(_sync(spark, d)[1], sync.sync_plan(*_sync(spark, d)), _sync(spark, d)[2]), f"{_SYNC}, moved as (select scope, cur, case when advances then greatest(top, from_ms) end as m, advances or cur is not null as kept from plan), others as (select artist_id from base) select scope, cast(greatest(cur, m) as bigint) as boundary_ms from moved where kept")


def _append(spark, d):
    s = history.instant_scrobbles(spark, d).select(F.col("listener").alias("scope"), "record_id", "instant_ms", "artist", "track", "album", "artist_mbid", F.lit(None).cast("string").alias("release_mbid"), "recording_mbid")
    k = F.col("record_id")
    stored = s.where(k % 4 != 1).withColumn("recording_mbid", F.when(k % 5 != 0, F.col("recording_mbid"))).withColumn("artist_mbid", F.when(k % 11 == 0, F.lit("other")).otherwise(F.col("artist_mbid"))).withColumn("release_mbid", F.when(k % 9 == 0, F.lit("rel")))
    return sync.append_plan(s.drop("record_id"), stored.drop("record_id"))


_APPEND = f"""{_EVIDENCE}, sc as (select distinct listener, instant_ms, artist, track, album, artist_mbid, recording_mbid from scrobbles),
st as (select distinct listener, instant_ms, artist, track, album, case when record_id % 11 = 0 then 'other' else artist_mbid end as am, case when record_id % 9 = 0 then 'rel' end as rm, case when record_id % 5 <> 0 then recording_mbid end as m, true as there from scrobbles where record_id % 4 <> 1),
jn as (select sc.*, count(case when there and m is not distinct from recording_mbid and am is not distinct from artist_mbid and rm is null and st.album is not distinct from sc.album then 1 end) as exact,
  count(case when there and (m is null or recording_mbid is null or m = recording_mbid) and (am is null or artist_mbid is null or am = artist_mbid) then 1 end) as agree
  from sc left join st on sc.listener = st.listener and sc.instant_ms = st.instant_ms and sc.artist = st.artist and sc.track = st.track group by all), oc as (select listener, case when exact > 0 then 'existing' when agree = 1 then 'matched' else 'inserted' end as outcome from jn)"""
register("k4_append_plan", lambda spark, d: _append(spark, d).groupBy("outcome").agg(F.count("*").alias("n")), f"{_APPEND} select outcome, count(*) as n from oc group by 1")
register(
    "k5_append_summary", lambda spark, d: sync.append_summary(_append(spark, d), history.instant_scrobbles(spark, d).select(F.col("listener").alias("scope"))),
    f"""{_APPEND}, n as (select listener, count(*) as fetched from scrobbles group by 1) select n.listener as scope, fetched, fetched - count(*) as ignored, count(case when outcome = 'existing' then 1 end) as existing,
count(case when outcome = 'matched' then 1 end) as matched, count(case when outcome = 'inserted' then 1 end) as inserted from oc join n using (listener) group by n.listener, fetched""",
)
register("x1_envelope", lambda spark, d: envelope.envelope(history.canonical_base(spark, d), "volume", {"grain": "month"}, TZ).drop("parameters", "version", "timezone"), f"{_BASE} select 'volume' as analysis, count(*) as event_count, min(instant_ms) as start_ms, max(instant_ms) + 1 as end_ms, count(listened_ms) / count(*) as duration_coverage, sum(case when event_status = 'unresolved' then 1 else 0 end) / count(*) as unresolved_rate from base")
register("x3_digest", lambda spark, d: envelope.digest(history.canonical_base(spark, d)), _BASE + """, h as (select sha256('{"artist_id":' || artist_id || ',"event_id":' || event_id || ',"event_status":"' || event_status || '","instant_ms":' || instant_ms || ',"listened_ms":' || coalesce(listened_ms::varchar, 'null') || ',"track_id":' || track_id || '}') as h from base),
t as (select count(*) as n, sum(('0x' || substr(h, 1, 16))::ubigint::hugeint) as a, sum(('0x' || substr(h, 17, 16))::ubigint::hugeint) as b, sum(('0x' || substr(h, 33, 16))::ubigint::hugeint) as c, sum(('0x' || substr(h, 49, 16))::ubigint::hugeint) as d from h)
select n, sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) as digest from t""")


def _population(spark, d) -> DataFrame:
    b = _canonical(spark, d).withColumn("rule_version", F.when(F.col("event_id") % 5 == 0, F.lit(" ")).when(F.col("event_id") % 2 == 0, F.lit("v2")).otherwise(F.lit("v1")))
    k = envelope.population(b)
    return k.select(F.array_join("versions", ",").alias("versions"), F.array_join("sources", ",").alias("sources"), *(F.col("coverage")[c].alias(c) for c in ("artist_id", "track_id", "listened_ms", "started_ms", "ended_ms")))


register("a10_population", _population, f"{_EVENTS} select 'v1,v2' as versions, 'instant,interval' as sources, count(artist_id) as artist_id, count(track_id) as track_id, count(listened_ms) as listened_ms, count(started_ms) as started_ms, count(ended_ms) as ended_ms from cb")


# Identity -------------------------------------------------------------------------------------------------------------
def _records(spark, d) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    mbid = F.when(e % 4 == 0, F.when(u % 50 < 10, F.concat(F.lit("a"), u % 50)).when(u % 50 < 20, F.concat(F.lit("a"), u % 100)))
    return history.table(spark, d, "events").select(
        e.alias("record_id"), F.concat(F.lit("ARTIST "), u % 50).alias("artist"), F.concat(F.lit("Track "), u % 150).alias("track"), F.when(e % 3 > 0, F.concat(F.lit("Album "), e % 3)).alias("album"),
        mbid.alias("artist_mbid"), F.when(e % 5 == 0, F.concat(F.lit("r"), u % 300)).alias("recording_id"), F.when(e % 7 == 0, F.concat(F.lit("rel"), e % 3)).alias("release_mbid"),
    )


_RECORDS = """rec as (select event_id as record_id, 'artist ' || user_id % 50 as name, 'track ' || user_id % 150 as title, case when event_id % 3 > 0 then 'album ' || event_id % 3 end as album,
  case when event_id % 4 = 0 then case when user_id % 50 < 10 then 'a' || user_id % 50 when user_id % 50 < 20 then 'a' || user_id % 100 end end as artist_mbid,
  case when event_id % 5 = 0 then 'r' || user_id % 300 end as recording_id, case when event_id % 7 = 0 then 'rel' || event_id % 3 end as release_mbid from events)"""
_RESOLVED = f"with {_RECORDS}, {_IDENTITY}"
register("i3_resolved", lambda spark, d: identity.resolved(_records(spark, d)).drop("conflicts"), f"{_RESOLVED} select record_id, artist_id, track_id, release_id, kind from res")
register("i6_conflicts", lambda spark, d: identity.conflicts(identity.resolved(_records(spark, d))), f"""{_RESOLVED} select record_id, 'artist' as entity_type, strong_artist as strong_id, alias_artist as other_id from res where strong_artist <> alias_artist
union select record_id, 'track', strong_track, low from res where strong_track <> low union select record_id, 'artist', artist_id, own_artist from res where artist_id <> own_artist union select record_id, 'release', strong_release, release_id from res where strong_release <> release_id""")
register("i1_owners", lambda spark, d: identity.owners(_records(spark, d), "recording_id"), f"{_RESOLVED} select recording_id, min(record_id) as owner from rec where recording_id is not null group by 1")
register("i8_aliases", lambda spark, d: identity.aliases(history.table(spark, d, "part").withColumnRenamed("p_partkey", "record_id"), "p_brand", "p_type"), "select p_brand as entity, lower(p_type) as alias, arg_min(p_type, p_partkey) as display, min(p_partkey) as record_id from part group by 1, 2")
register("i2_unique_aliases", lambda spark, d: identity.unique_aliases(identity.aliases(history.table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), "p_brand", F.concat("p_type", F.lit(" "), "p_size").alias("name")), "p_brand", "name")), "select lower(p_type || ' ' || p_size) as alias, min(p_brand) as entity from part group by 1 having count(distinct p_brand) = 1")


def _merged(spark, d) -> DataFrame:
    base = history.canonical_base(spark, d).select("event_id", "artist_id")
    k = F.col("c_custkey")
    return identity.merged(base, "artist_id", history.table(spark, d, "customer").select(F.when(k % 4 == 1, k).otherwise(F.floor(k / 4)).cast("long").alias("subject"), k.alias("object")))


register("i12_merged", _merged, f"""with recursive {history.BASE_SQL}, m as (select c_custkey as o, case when c_custkey % 4 = 1 then c_custkey else c_custkey // 4 end as s from customer), w as (select o as node, s as root from m union select node, m.s from w join m on w.root = m.o),
r as (select node, min(root) as root from w group by node) select event_id, coalesce(root, artist_id) as artist_id, case when root <> artist_id then artist_id end as before_merge from base left join r on node = artist_id""")


# Manual decisions -----------------------------------------------------------------------------------------------------
def _decisions(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return history.table(spark, d, "customer").select(
        F.when(k % 11 == 0, F.lit("d-0")).otherwise(F.concat(F.when(k % 7 == 0, F.lit("D-")).otherwise(F.lit("d-")), k)).alias("decision_id"), F.when(k % 5 == 0, F.lit("alias")).when(k % 13 == 0, F.lit("keep")).otherwise(F.lit("accept")).alias("type"),
        F.when(k % 17 != 0, F.lit("by_ear")).alias("reason_code"), F.sha2(F.col("c_name"), 256).alias("file_sha256"), (k % 19 - 1).alias("ordinal"), F.when(k % 10 == 0, F.lit("")).otherwise(F.col("c_name")).alias("alias"),
    )


register("r14_decision_faults", lambda spark, d: decisions.faults(_decisions(spark, d)), """with k as (select c_custkey as k, case when c_custkey % 11 = 0 then 'd-0' when c_custkey % 7 = 0 then 'D-' || c_custkey else 'd-' || c_custkey end as decision_id from customer)
select decision_id, case when decision_id like 'D%' then 'decision_id' when k % 5 <> 0 and k % 13 = 0 then 'type' when k % 17 = 0 then 'reason_code' when k % 19 = 0 then 'reference' else 'alias' end as fault from k
where decision_id like 'D%' or (k % 5 <> 0 and k % 13 = 0) or k % 17 = 0 or k % 19 = 0 or k % 10 = 0 union all select decision_id, 'repeated_id' from k group by 1 having count(*) > 1""")


def _offered(spark, d, changed: bool) -> DataFrame:
    p = history.table(spark, d, "part")
    p = p.where("p_partkey % 3 != 0") if changed else p
    payload = F.when((F.col("p_partkey") % 5 == 0) & F.lit(changed), F.lit("other")).otherwise(F.col("p_name"))
    return p.select(F.concat(F.lit("d-"), "p_partkey").alias("decision_id"), payload.alias("payload"))


register("r13_import_plan", lambda spark, d: decisions.import_plan(_offered(spark, d, False), _offered(spark, d, True)).drop("payload"), "select 'd-' || p_partkey as decision_id, case when p_partkey % 3 = 0 then 'imported' when p_partkey % 5 = 0 and p_name <> 'other' then 'conflict' else 'already_applied' end as outcome from part")


def _manual(scored: DataFrame) -> DataFrame:
    return scored.where("play_id % 16 = 0").select("play_id", "scrobble_id", F.when(F.col("play_id") % 32 == 0, "accept").otherwise("reject").alias("decision"))


register("r12_manual_first", lambda spark, d: decisions.with_manual(scored := _scored(spark, d), _manual(scored)), f"{_EVIDENCE}, {_PAIRS}, {_SCORES} select play_id, scrobble_id, case when play_id % 32 = 0 then 'accept' when play_id % 16 = 0 then 'reject' else decision end as decision, case when play_id % 16 = 0 then 'manual' else 'automatic' end as origin from dc")


def _decision_history(spark, d) -> DataFrame:
    scored = _scored(spark, d)  # once: it runs the whole chain
    prior = scored.select("play_id", "scrobble_id", F.lit("v1").alias("version"), "decision", F.lit("active").alias("state"), F.lit(None).cast("string").alias("superseded_by"))
    return decisions.superseded(prior, _manual(scored), "v2")


register("r11_superseded", _decision_history, f"""{_EVIDENCE}, {_PAIRS}, {_SCORES} select play_id, scrobble_id, 'v1' as version, decision, case when play_id % 16 = 0 then 'superseded' else 'active' end as state, case when play_id % 16 = 0 then 'v2' end as superseded_by from dc
union all select play_id, scrobble_id, 'v2', case when play_id % 32 = 0 then 'accept' else 'reject' end, 'active', null from dc where play_id % 16 = 0""")
register("v24_decision_lineage", lambda spark, d: decisions.lineage_faults(_decision_history(spark, d).where("version = 'v1' or play_id % 32 = 0")), f"{_EVIDENCE}, {_PAIRS}, {_SCORES} select play_id, scrobble_id, 'active_count' as fault from dc where play_id % 32 = 16")


def _references(spark, d) -> DataFrame:
    return _both(spark, d).select("record_id", F.col("source").alias("kind"), F.sha2(F.concat(F.lit("file-"), F.col("record_id") % 4), 256).alias("file_sha256"), F.floor(F.col("record_id") / 4).cast("long").alias("ordinal"))


register("r15_review_export", lambda spark, d: decisions.review_export(_scored(spark, d), _references(spark, d)).withColumn("confidence", F.round("confidence", 9)), f"""{_EVIDENCE}, {_PAIRS}, {_SCORES} select 'interval' as play_kind, sha256('file-' || play_id % 4) as play_file_sha256, play_id // 4 as play_ordinal,
'instant' as scrobble_kind, sha256('file-' || scrobble_id % 4) as scrobble_file_sha256, scrobble_id // 4 as scrobble_ordinal, decision, round(confidence, 9) as confidence from dc""")
register("c9_unresolved", lambda spark, d: coverage.unresolved(history.canonical_base(spark, d)), f"{_BASE} select count(*) as events, cast(coalesce(sum(case when event_status = 'unresolved' then 1 else 0 end), 0) as bigint) as unresolved, coalesce(unresolved / nullif(count(*), 0), 0) as rate from base")
register("c10_overlap_by_year", lambda spark, d: coverage.overlap_by_year(_canonical(spark, d), "started_ms", TZ), f"{_EVENTS} select cast(year({_LOCAL.replace('instant_ms', 'started_ms')}) as int) as year, count(*) as n from cb where status = 'cross_source_reconciled' group by 1")
register("c11_input_files", lambda spark, d: coverage.input_files(_references(spark, d).withColumnRenamed("kind", "source")), f"{_BOTH} select source, sha256('file-' || record_id % 4) as file_sha256, count(*) as records from u group by all order by 1, 2")


# Integrity ------------------------------------------------------------------------------------------------------------
def _run_records(spark, d) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "excluded").otherwise("rejected")
    return history.table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("run_id"), kind.alias("kind"))


def _runs(spark, d) -> DataFrame:
    """A run per customer but every 29th; some state wrong numbers or a wrong status."""
    k = F.col("run_id")
    n = _run_records(spark, d).groupBy("run_id").agg(*(F.count_if(F.col("kind") == x).alias(x) for x in integrity.KINDS), F.count("*").alias("n")).where(k % 29 != 0)
    status = F.when(k % 17 == 0, "failed").when(k % 19 == 0, "running").when(k % 23 == 0, "odd").otherwise("succeeded")
    return n.select("run_id", status.alias("status"), (F.col("n") + (k % 13 == 0).cast("long")).alias("discovered"), "accepted", (F.col("excluded") + (k % 11 == 0).cast("long")).alias("excluded"), "rejected")


register("v3_run_faults", lambda spark, d: integrity.run_faults(_runs(spark, d), _run_records(spark, d)), """with r as (select distinct o_custkey as k from orders)
select k as run_id, unnest(list_filter([case when k % 29 = 0 then 'unknown_run' end, case when k % 29 <> 0 and k % 17 <> 0 and k % 19 <> 0 and k % 23 = 0 then 'status' end,
case when k % 29 <> 0 and (k % 13 = 0) <> (k % 11 = 0) then 'total' end, case when k % 29 <> 0 and k % 11 = 0 then 'excluded' end, case when k % 29 <> 0 and k % 17 = 0 then 'failed_owns' end,
case when k % 29 <> 0 and k % 17 <> 0 and k % 19 = 0 then 'unfinished' end], lambda x: x is not null)) as fault from r""")
register(
    "v5_ownership_faults",
    lambda spark, d: integrity.ownership_faults(
        history.table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 31 != 0, F.col("o_custkey") % 100).alias("file_id"), F.col("o_custkey").alias("run_id")),
        history.table(spark, d, "customer").where("c_custkey % 7 != 0").select((F.col("c_custkey") % 100).alias("file_id"), F.col("c_custkey").alias("run_id")),
    ),
    "select o_orderkey as record_id, case when o_orderkey % 31 = 0 then 'unowned' else 'unlinked' end as fault from orders where o_orderkey % 31 = 0 or o_custkey % 7 = 0 or o_custkey not in (select c_custkey from customer)",
)


def _damaged_prints(spark, d) -> DataFrame:
    at = F.when(F.col("record_id") % 9 == 0, F.col("stopped_at_ms") + 1).otherwise(F.col("stopped_at_ms"))
    p = history.interval_plays(spark, d).withColumn("fingerprint", F.when(F.col("record_id") % 25 != 0, evidence.fingerprint("play-v1", "interval", at=at, ms=F.col("ms_played"))))
    return integrity.stored_fingerprint_faults(p, evidence.fingerprint("play-v1", "interval", at=F.col("stopped_at_ms"), ms=F.col("ms_played"))).select("record_id")


register("v8_stored_fingerprints", _damaged_prints, f"{_EVIDENCE} select record_id from plays where record_id % 9 = 0 or record_id % 25 = 0")


register(
    "v15_link_faults", lambda spark, d: integrity.link_faults(_both(spark, d).where("record_id % 41 != 0"), _chain(spark, d).links.where("record_id % 37 != 0")),
    f"""{_EVENTS}, gone as (select * from lk where record_id % 37 <> 0), rc as (select record_id from lk where record_id % 41 <> 0) select record_id, 'unlinked' as fault from (select distinct record_id from rc) where record_id not in (select record_id from gone)
union all select record_id, 'shared' from gone where record_id % 41 <> 0 group by 1 having count(distinct event_id) > 1 union all select distinct record_id, 'dangling' from gone where record_id % 41 = 0""",
)


def _event_faults(spark, d):
    c = _chain(spark, d)
    e = reconcile.canonical_base(c.events, c.links).withColumn("ended_ms", F.when(F.col("event_id") % 43 == 0, F.col("started_ms") - 1).when(F.col("event_id") % 47 != 0, F.col("ended_ms")))
    return integrity.event_faults(e, c.links.where("record_id % 37 != 0"))


register("v16_event_faults", _event_faults, f"""{_EVENTS}, gone as (select * from lk where record_id % 37 <> 0), h as (select event_id, count(distinct source) as s from gone group by 1),
e as (select cb.event_id, started_ms, case when cb.event_id % 43 = 0 then started_ms - 1 when cb.event_id % 47 <> 0 then ended_ms end as ended_ms, time_basis, status, s from cb left join h on h.event_id = cb.event_id)
select event_id, 'no_evidence' as fault from e where s is null union all select event_id, 'status' from e where status <> 'unresolved' and (status = 'cross_source_reconciled') <> (s > 1)
union all select event_id, 'basis' from e where time_basis = 'derived_start' and ended_ms is null union all select event_id, 'order' from e where ended_ms < started_ms""")
register(
    "v18_supersession_faults",
    lambda spark, d: integrity.supersession_faults(history.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 3 == 0, "superseded").otherwise("active").alias("state"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") * 2).when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey")).when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 1)).alias("superseded_by"))),
    """with e as (select o_orderkey as k, o_orderkey % 3 = 0 as gone, case when o_orderkey % 5 = 0 then o_orderkey * 2 when o_orderkey % 7 = 0 then o_orderkey when o_orderkey % 6 = 0 then o_orderkey + 1 end as sb from orders), j as (select e.*, t.k as tk, t.gone as tg from e left join (select distinct k, gone from e) t on e.sb = t.k)
select k as event_id, unnest(list_filter([case when gone and sb is null then 'no_successor' end, case when not gone and sb is not null then 'active_successor' end, case when sb = k then 'self' end, case when sb is not null and tk is null then 'missing' end, case when tg and sb <> k then 'superseded_successor' end], lambda x: x is not null)) as fault from j""",
)
register("v20_graph_faults", lambda spark, d: integrity.graph_faults(identity.resolved(_records(spark, d))), f"""{_RESOLVED} select 'track' as entity_type, track_id as entity_id, count(distinct artist_id) as owners from res group by 2 having count(distinct artist_id) > 1
union all select 'release', release_id, count(distinct artist_id) from res where release_id is not null group by 2 having count(distinct artist_id) > 1""")
register(
    "v27_blank_versions",
    lambda spark, d: integrity.blank_versions(decisions=_decision_history(spark, d), orders=history.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("version"))),
    f"{_EVIDENCE}, {_PAIRS}, {_SCORES} select 'decisions' as \"table\", cast(0 as bigint) as blank, count(*) + count(case when play_id % 16 = 0 then 1 end) as rows from dc union all select 'orders', count(case when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then 1 end), count(*) from orders",
)


def _pages(spark, d) -> DataFrame:
    t, c = history.table(spark, d, "conversations"), F.col("scope")
    n = t.groupBy(F.col("conv_id").alias("scope")).agg(F.count("*").alias("total"))
    p = t.groupBy(F.col("conv_id").alias("scope"), (F.floor(F.col("turn") / 2) + 1).alias("page")).agg(F.count("*").alias("rows"), F.count_if(F.col("role") == "user").alias("now_playing"))
    return p.join(n, "scope").select("scope", "page", F.lit(2).cast("long").alias("per_page"), "total", (F.ceil(F.col("total") / 2) + F.when(c % 7 == 0, 1).otherwise(0)).alias("total_pages"), "rows", "now_playing")


register("v30_page_faults", lambda spark, d: coverage.page_faults(_pages(spark, d)).select("scope", "page"), """with n as (select conv_id as s, count(*) as total from conversations group by 1), p as (select conv_id as s, turn // 2 + 1 as page, count(*) as r, count(case when role = 'user' then 1 end) as np from conversations group by 1, 2),
q as (select p.*, total, (total + 1) // 2 + case when p.s % 7 = 0 then 1 else 0 end as tp from p join n on p.s = n.s)
select s as scope, page from q where not (tp = (total + 1) // 2 and r = case when page < tp then 2 else total - (tp - 1) * 2 end and np <= 1)""")


# Totals, baseline, cross-checks and streaming forms -----------------------------------------------------------------
def _outcomes(spark, d) -> DataFrame:
    plays = reconcile.keepers(history.interval_plays(spark, d), *history.SAME_PLAY)
    scrobbles = reconcile.keepers(history.instant_scrobbles(spark, d), *history.SAME_SCROBBLE)
    kind = F.when(F.col("record_id") % 7 == 0, "rejected").when(F.col("record_id") % 11 == 0, "excluded").otherwise("accepted").alias("kind")
    return plays.select(F.lit("interval").alias("source"), kind, "is_keeper").unionByName(scrobbles.select(F.lit("instant").alias("source"), kind, "is_keeper"))


register("c12_totals", lambda spark, d: coverage.outcome_totals(_outcomes(spark, d)), f"""{_EVIDENCE}, a as (select 'interval' as source, record_id, record_id <> keeper as again from pk union all select 'instant', record_id, record_id <> keeper from sk),
k as (select source, again, case when record_id % 7 = 0 then 'rejected' when record_id % 11 = 0 then 'excluded' else 'accepted' end as kind from a)
select source, count(case when kind = 'accepted' then 1 end) as accepted, count(case when kind = 'accepted' and again then 1 end) as duplicates, count(case when kind = 'excluded' then 1 end) as excluded, count(case when kind = 'rejected' then 1 end) as rejected, count(*) as total from k group by rollup(source)""")


def _merge_counts(spark, d):
    c = _chain(spark, d)
    return coverage.merge_counts(reconcile.canonical_base(c.events, c.links), c.duplicates)


register("c8_merge_counts", _merge_counts, f"""{_EVENTS}, x as (select count(distinct event_id) as ce, count(scrobble_id) as cl from cb where status = 'cross_source_reconciled')
select count(distinct keeper) as duplicate_events, count(*) as duplicate_links, any_value(ce) as cross_events, any_value(cl) as cross_links from x left join dup on true""")
register(
    "c13_baseline", lambda spark, d: coverage.baseline_differences(_both(spark, d).groupBy(F.col("source").alias("metric")).agg(F.count("*").alias("actual")), history.table(spark, d, "events").groupBy(F.when(F.col("event_id") % 3 == 0, "interval").when(F.col("event_id") % 3 == 1, "instant").otherwise("pages").alias("metric")).agg(F.count("*").alias("expected"))),
    f"{_BOTH}, a as (select source as metric, count(*) as actual from u group by 1), e as (select case event_id % 3 when 0 then 'interval' when 1 then 'instant' else 'pages' end as metric, count(*) as expected from events group by 1) select coalesce(a.metric, e.metric) as metric, actual, expected from a full join e on a.metric = e.metric where actual is distinct from expected",
)


def _artist_envelopes(spark, d) -> DataFrame:
    """An envelope per artist, some with wrong numbers."""
    k = F.col("artist_id")
    e = history.canonical_base(spark, d).groupBy("artist_id").agg(F.count("*").alias("event_count"), F.count("listened_ms").alias("available"), F.count_if(F.col("event_status") == "unresolved").alias("unresolved"), F.min("instant_ms").alias("start_ms"), (F.max("instant_ms") + 1).alias("end_ms"))
    return e.select(
        k.alias("analysis"), "event_count", (F.col("event_count") + (k % 7 == 0).cast("long")).alias("coverage_total"), (F.col("available") + F.when(k % 11 == 0, 1000).otherwise(0)).alias("available"), "unresolved",
        F.when(k % 13 == 0, 2.0).otherwise(F.col("unresolved") / F.col("event_count")).alias("unresolved_rate"), F.when(k % 17 != 0, F.col("start_ms")).alias("start_ms"), "end_ms", (F.col("end_ms") - (k % 19 == 0).cast("long")).alias("as_of_ms"),
    )


register("x2_envelope_faults", lambda spark, d: envelope.envelope_faults(_artist_envelopes(spark, d)), f"""{_BASE}, k as (select distinct artist_id as k from base) select k as analysis, unnest(list_filter([case when k % 7 = 0 then 'coverage' end, case when k % 11 = 0 then 'available' end, case when k % 13 = 0 then 'rate' end,
case when k % 17 = 0 then 'range' end, case when k % 19 = 0 then 'as_of' end], lambda x: x is not null)) as fault from k""")


def _cross_counts(spark, d) -> DataFrame:
    base = history.canonical_base(spark, d)
    return envelope.count_differences(
        base.agg(F.count("*").alias("event_count")), volume=QUERIES["n1_volume_month"](spark, d).agg(F.sum("value").alias("event_count")), eras=_windows(spark, d).agg(F.sum("plays").alias("event_count")),
        resolved_volume=volume.listening_volume(base, "month", include_unresolved=False, tz=TZ).agg(F.sum("value").alias("event_count")),
    )


register("x6_cross_counts", _cross_counts, f"{_BASE}, c as (select count(*) as n, count(case when event_status = 'current' then 1 end) as r from base) select a as analysis, case when a = 'resolved_volume' then r else n end as event_count, n as coverage_count, a <> 'resolved_volume' or r = n as agrees from c, (select unnest(['volume', 'eras', 'resolved_volume']) as a)")


def _timed(spark, d) -> DataFrame:
    return history.canonical_base(spark, d).withColumn("at", F.timestamp_millis("instant_ms"))


register("u1_daily_volume", lambda spark, d: streams.daily_volume(_timed(spark, d), "at").select(F.unix_millis("day").alias("day_ms"), "play_count"), f"{_BASE} select instant_ms // 86400000 * 86400000 as day_ms, count(*) as play_count from base group by 1")
register("u2_active_periods", lambda spark, d: streams.active_periods(_timed(spark, d), "at", "artist_id", "90 days").select("artist_id", F.unix_millis("start").alias("start_ms"), "play_count"), f"""{_BASE}, s as (select *, case when instant_ms - lag(instant_ms) over (partition by artist_id order by instant_ms) > 7776000000 then 1 else 0 end as cut from base),
p as (select *, sum(cut) over (partition by artist_id order by instant_ms) as p from s) select artist_id, min(instant_ms) as start_ms, count(*) as play_count from p group by artist_id, p""")


# Runs, files, rejections, synchronization, entities and manual decisions -----------------------------------------------
def _orders(spark, d, *columns) -> DataFrame:
    return history.table(spark, d, "orders").select(*columns)


def _customers(spark, d, *columns) -> DataFrame:
    return history.table(spark, d, "customer").select(*columns)


def _k():
    return F.col("o_orderkey")


def _c():
    return F.col("c_custkey")


def _command_runs(spark, d) -> DataFrame:
    """A run for each customer: imports of two kinds and synchronizations."""
    command = F.when(_c() % 3 == 0, "interval_import").when(_c() % 3 == 1, "import").otherwise("sync")
    return _customers(spark, d, _c().alias("run_id"), F.when(_c() % 11 == 0, "failed").otherwise("succeeded").alias("status"), command.alias("command"), (_c() % 13).alias("registered_files"), (_c() % 7).alias("noop_files"), (_c() * 1000).alias("completed_ms"), (_c() % 5).alias("discovered"), (_c() % 4).alias("accepted"))


def _run_files(spark, d) -> DataFrame:
    return _orders(spark, d, _k().alias("file_id"), F.when(_k() % 2 == 0, "interval_export").otherwise("export").alias("source_type"), F.col("o_custkey").alias("first_run_id"), (F.col("o_custkey") + F.when(_k() % 4 == 0, 3).when(_k() % 9 == 0, -3).otherwise(0)).alias("last_run_id"))


_COMMANDS = "case when c % 3 = 0 then 'interval_import' when c % 3 = 1 then 'import' else 'sync' end"
_RUN_FILES = f"""with r as (select c_custkey as c, {_COMMANDS} as command, case when c_custkey % 11 = 0 then 'failed' else 'succeeded' end as status, c_custkey % 13 as reg, c_custkey % 7 as noop from (select c_custkey, c_custkey as c from customer)),
f as (select o_orderkey as k, case when o_orderkey % 2 = 0 then 'interval_export' else 'export' end as t, o_custkey as a, o_custkey + case when o_orderkey % 4 = 0 then 3 when o_orderkey % 9 = 0 then -3 else 0 end as z from orders)"""
register("v4_file_runs", lambda spark, d: integrity.file_run_faults(_run_files(spark, d), _command_runs(spark, d), {"interval_export": "interval_import", "export": "import"}), f"""{_RUN_FILES},
j as (select f.*, ra.c as ac, rz.c as zc, ra.command as acmd, rz.command as zcmd, ra.status as ast, rz.status as zst, ra.reg, rz.noop, case when t = 'export' then 'import' else 'interval_import' end as want from f left join r ra on ra.c = a left join r rz on rz.c = z)
select k as file_id, unnest(list_filter([case when ac is null or zc is null then 'unknown_run' end, case when ast <> 'succeeded' or zst <> 'succeeded' then 'not_succeeded' end, case when a > z then 'order' end, case when acmd <> want or zcmd <> want then 'command' end,
case when a = z and reg = 0 then 'unregistered' end, case when a <> z and noop = 0 then 'no_noop' end], lambda x: x is not null)) as fault from j""")
register("v6_rejection_ownership", lambda spark, d: integrity.rejection_ownership_faults(
    _orders(spark, d, (_k() * 10).alias("rejection_id"), (F.col("o_custkey") + F.when(_k() % 6 == 0, 1).otherwise(0)).alias("run_id"), F.when(_k() % 14 == 0, _k() + 10_000_000).otherwise(_k()).alias("file_id"), F.when(_k() % 5 == 0, "instant").when(_k() % 2 == 0, "interval").otherwise("instant").alias("source")),
    _run_files(spark, d), _command_runs(spark, d), {"interval": ("interval_import", "interval_export"), "instant": ("import", "export")},
), f"""{_RUN_FILES}, q as (select o_orderkey * 10 as id, o_custkey + case when o_orderkey % 6 = 0 then 1 else 0 end as run, case when o_orderkey % 14 = 0 then o_orderkey + 10000000 else o_orderkey end as file, case when o_orderkey % 5 <> 0 and o_orderkey % 2 = 0 then 'interval' else 'instant' end as s from orders),
j as (select q.*, r.c, r.command, f.k, f.t, f.a, case when s = 'interval' then 'interval_import' else 'import' end as wc, case when s = 'interval' then 'interval_export' else 'export' end as wt from q left join r on r.c = run left join f on f.k = file)
select id as rejection_id, unnest(list_filter([case when c is null then 'unknown_run' end, case when k is null then 'unknown_file' end, case when run <> a then 'run' end, case when command <> wc then 'command' end, case when t <> wt then 'type' end], lambda x: x is not null)) as fault from j""")


def _sync_metadata(spark, d) -> DataFrame:
    return _customers(spark, d, _c().alias("run_id"), (_c() % 6).alias("completed"), (_c() % 9).alias("pages")).where("run_id % 3 = 2 and run_id % 10 != 5")


register("v11_sync_runs", lambda spark, d: integrity.sync_run_faults(_command_runs(spark, d).where("command = 'sync'"), _sync_metadata(spark, d)), """with r as (select c_custkey as c, c_custkey % 11 <> 0 as done, c_custkey % 10 <> 5 as there from customer where c_custkey % 3 = 2)
select c as run_id, unnest(list_filter([case when done and not there then 'missing' end, case when not done and there then 'unexpected' end, case when there and c % 6 < greatest(c % 5, c % 4) then 'fewer' end, case when there and c % 9 = 0 then 'no_pages' end], lambda x: x is not null)) as fault from r""")
register("v12_cursors", lambda spark, d: integrity.cursor_faults(
    _customers(spark, d, F.concat(F.lit("scope-"), _c()).alias("scope"), F.when(_c() % 17 == 0, -_c()).otherwise(_c()).alias("run_id"), (_c() * 100 + (_c() % 19 == 0).cast("int")).alias("boundary_ms"), (_c() * 1000 - (_c() % 23 == 0).cast("int")).alias("updated_ms")).where("run_id % 3 != 0"),
    _command_runs(spark, d), _sync_metadata(spark, d), _orders(spark, d, F.col("o_custkey").alias("run_id"), (F.col("o_custkey") * 100 - F.when(_k() % 2 == 0, 0).otherwise(5)).alias("instant_ms")),
), """with c as (select c_custkey as c, case when c_custkey % 17 = 0 then -c_custkey else c_custkey end as run from customer where c_custkey % 3 <> 0), t as (select o_custkey as r, max(o_custkey * 100 - case when o_orderkey % 2 = 0 then 0 else 5 end) as top from orders group by 1),
j as (select c.*, run > 0 as known, top from c left join t on t.r = run)
select 'scope-' || c as scope, unnest(list_filter([case when not known then 'unknown_run' end, case when known and c % 3 <> 2 then 'command' end, case when known and c % 11 = 0 then 'status' end, case when not known or c % 3 <> 2 or c % 10 = 5 then 'metadata' end, case when known and c % 23 = 0 then 'older' end,
case when c * 100 + case when c % 19 = 0 then 1 else 0 end <> top then 'boundary' end], lambda x: x is not null)) as fault from j""")
register("v13_origins", lambda spark, d: integrity.origin_faults(
    _orders(spark, d, _k().alias("record_id"), F.col("o_custkey").alias("run_id"), F.when(_k() % 2 == 0, "export").otherwise("api").alias("origin"), F.when(_k() % 3 == 0, _k()).otherwise(_k() + 1).alias("payload_id")), _command_runs(spark, d), _orders(spark, d, _k().alias("payload_id"), F.when(_k() % 5 < 2, "export").otherwise("api").alias("origin")),
), """with o as (select o_orderkey as k, o_custkey % 3 as m, case when o_orderkey % 2 = 0 then 'export' else 'api' end as origin, case when o_orderkey % 3 = 0 then o_orderkey else o_orderkey + 1 end as p from orders join customer on c_custkey = o_custkey), j as (select o.*, p % 5 >= 2 as api from o where p in (select o_orderkey from orders))
select k as record_id, unnest(list_filter([case when (m = 1 and origin <> 'export') or (m = 2 and origin <> 'api') then 'run' end, case when (origin = 'export' and api) or (origin = 'api' and api and k <> p) then 'payload' end], lambda x: x is not null)) as fault from j""")
register("v14_rejections", lambda spark, d: integrity.rejection_faults(
    _orders(spark, d, _k().alias("rejection_id"), F.when(_k() % 7 == 0, "other").when(_k() % 2 == 0, "interval").otherwise("instant").alias("source"), F.when(_k() % 3 == 0, "invalid_duration").otherwise("invalid_timestamp").alias("error_code"), F.when(_k() % 11 == 0, F.lit(None)).when(_k() % 13 == 0, "raw text").otherwise("rejected").alias("summary"), F.when(_k() % 17 != 0, _k()).alias("file_id"), F.when(_k() % 19 != 0, 1).alias("ordinal")),
    {"interval": ["invalid_duration", "invalid_timestamp"], "instant": ["invalid_timestamp"]}, "rejected",
), """select o_orderkey as rejection_id, unnest(list_filter([case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then 'summary' end, case when o_orderkey % 7 = 0 or (o_orderkey % 2 = 1 and o_orderkey % 3 = 0) then 'code' end, case when o_orderkey % 17 = 0 or o_orderkey % 19 = 0 then 'provenance' end], lambda x: x is not null)) as fault from orders""")


def _state_faults(spark, d) -> DataFrame:
    c = _chain(spark, d)
    k = F.col("event_id")
    events = c.events.select("event_id", F.when(k % 29 == 0, "unresolved").when(k % 31 == 0, "superseded").when(k % 33 == 0, "current").otherwise(F.col("event_status")).alias("event_status"))
    return integrity.state_faults(c.resolutions, c.links.where("role = 'primary'"), events)


register("v17_states", _state_faults, f"""{_EVENTS}, e as (select event_id, case when event_id % 29 = 0 then 'unresolved' when event_id % 31 = 0 then 'superseded' when event_id % 33 = 0 then 'current' else event_status end as s from ev_all)
select lk.record_id, lk.event_id from lk join e using (event_id) join res on res.record_id = lk.record_id where role = 'primary' and ((kind = 'new_unresolved' and s not in ('unresolved', 'superseded')) or (kind <> 'new_unresolved' and s = 'unresolved'))""")


def _entities(spark, d) -> DataFrame:
    return _customers(spark, d, _c().alias("entity_id"), F.when(_c() % 3 == 0, "artist").when(_c() % 3 == 1, "release").otherwise("track").alias("entity_type"))


_TYPES = "e as (select c_custkey as id, case when c_custkey % 3 = 0 then 'artist' when c_custkey % 3 = 1 then 'release' else 'track' end as t from customer)"
register("v19_subtypes", lambda spark, d: integrity.subtype_faults(_entities(spark, d), **{n: _customers(spark, d, _c().alias("entity_id")).where(f"(entity_id % 3 = {m} and entity_id % 41 != 0) or entity_id % {p} = 0") for n, m, p in (("artist", 0, 43), ("release", 1, 47), ("track", 2, 53))}), f"""with {_TYPES},
h as (select id, t, (id % 3 = 0 and id % 41 <> 0) or id % 43 = 0 as a, (id % 3 = 1 and id % 41 <> 0) or id % 47 = 0 as r, (id % 3 = 2 and id % 41 <> 0) or id % 53 = 0 as k from e)
select id as entity_id, unnest(list_filter([case when (t = 'artist' and not a) or (t = 'release' and not r) or (t = 'track' and not k) then 'missing' end, case when (t = 'artist' and (r or k)) or (t = 'release' and (a or k)) or (t = 'track' and (a or r)) then 'other' end], lambda x: x is not null)) as fault from h""")
register("v21_identifiers", lambda spark, d: integrity.identifier_faults(
    _orders(spark, d, F.when(_k() % 4 == 0, "artist_mbid").when(_k() % 4 == 1, "release_mbid").when(_k() % 4 == 2, "track_uri").otherwise("note").alias("namespace"), _k().cast("string").alias("value"), F.col("o_custkey").alias("entity_id")), _entities(spark, d), {"artist_mbid": "artist", "release_mbid": "release", "track_uri": "track"},
), f"""with {_TYPES}, i as (select o_orderkey as k, o_custkey as c, case o_orderkey % 4 when 0 then 'artist_mbid' when 1 then 'release_mbid' when 2 then 'track_uri' else 'note' end as n, case o_orderkey % 4 when 0 then 'artist' when 1 then 'release' when 2 then 'track' end as want from orders) select n as namespace, k::varchar as value from i join e on id = c where t <> want""")
register("v22_conflicts", lambda spark, d: integrity.conflict_faults(_orders(spark, d, _k().alias("record_id"), F.when(_k() % 2 == 0, "artist").otherwise("track").alias("entity_type"), F.col("o_custkey").alias("strong_id"), (F.col("o_custkey") + 3).alias("other_id")), _entities(spark, d)), f"""with {_TYPES}
select o_orderkey as record_id, case when o_orderkey % 2 = 0 then 'artist' else 'track' end as entity_type from orders join e a on a.id = o_custkey join e b on b.id = o_custkey + 3 where a.t <> case when o_orderkey % 2 = 0 then 'artist' else 'track' end or b.t <> case when o_orderkey % 2 = 0 then 'artist' else 'track' end""")


def _strong(spark, d) -> DataFrame:
    """Identifiers of orders owned by the customer of their first order; half of the entities are merged in pairs, some conflicts are named."""
    value = (_k() % 5000).cast("string")
    carried = _orders(spark, d, _k().alias("record_id"), F.lit("track").alias("entity_type"), F.col("o_custkey").alias("entity_id"), F.lit("uri").alias("namespace"), value.alias("value"))
    owners = carried.where("cast(value as int) % 7 != 0").groupBy("namespace", "value").agg(F.min_by("entity_id", "record_id").alias("owner"))
    roots = identity.merge_roots(_customers(spark, d, _c().alias("subject"), (_c() - 1).alias("object")).where("subject % 4 = 1"))
    named = carried.join(owners, ["namespace", "value"]).where("record_id % 3 = 0 and entity_id != owner").select("record_id", "entity_type", F.when(F.col("record_id") % 2 == 0, F.col("owner")).otherwise(F.col("entity_id")).alias("strong_id"), F.when(F.col("record_id") % 2 == 0, F.col("entity_id")).otherwise(F.col("owner")).alias("other_id"))
    return integrity.strong_identifier_faults(carried, owners, roots, named)


register("v23_strong_identifiers", _strong, """with c as (select o_orderkey as k, o_custkey as e, o_orderkey % 5000 as v from orders), o as (select v, arg_min(e, k) as owner from c where v % 7 <> 0 group by 1), j as (select c.*, owner, case when e % 4 = 1 then e - 1 else e end as er, case when owner % 4 = 1 then owner - 1 else owner end as orr from c left join o using (v))
select k as record_id, 'uri' as namespace, case when owner is null then 'unknown' else 'elsewhere' end as fault from j where owner is null or (er <> orr and k % 3 <> 0)""")


def _manual_rows(spark, d) -> DataFrame:
    """Manual decisions on pairs of customers and orders, some repeated later, with events that they merged."""
    yes = _k() % 3 != 0
    return _orders(spark, d, _k().alias("decision_id"), F.col("o_custkey").alias("play_id"), (F.col("o_custkey") * 2 + 1).alias("scrobble_id"), F.when(yes, "accept").otherwise("reject").alias("decision"), F.when(yes | (_k() % 7 == 0), F.col("o_custkey") * 2 + 1).alias("source_event"), F.when(yes, F.col("o_custkey")).alias("target_event"), (_k() % 100).alias("imported_ms"), _k().alias("number"))


register("v25_manual_decisions", lambda spark, d: integrity.manual_faults(
    _manual_rows(spark, d), _orders(spark, d, _k().alias("decision_id"), F.when(_k() % 11 == 0, "alias").when(_k() % 3 != 0, "accept").otherwise("reject").alias("decision_type")), _customers(spark, d, _c().alias("play_id"), (_c() * 2 + 1).alias("scrobble_id"), F.when(_c() % 2 == 0, "manually_accepted").otherwise("manually_rejected").alias("state")),
    _customers(spark, d, (_c() * 2 + 1).alias("event_id"), F.when(_c() % 5 != 0, "superseded").otherwise("current").alias("event_status"), F.when(_c() % 13 != 0, _c()).alias("superseded_by")),
    _customers(spark, d, _c().alias("event_id"), _c().alias("record_id"), F.lit("primary").alias("role")).unionByName(_customers(spark, d, _c().alias("event_id"), (_c() * 2 + 1).alias("record_id"), F.when(_c() % 17 == 0, "primary").otherwise("cross_source_match").alias("role"))),
), """with m as (select o_orderkey as k, o_custkey as c, o_orderkey % 3 <> 0 as yes, row_number() over (partition by o_custkey order by o_orderkey % 100 desc, o_orderkey desc) = 1 as newest, o_custkey in (select c_custkey from customer) as there from orders)
select k as decision_id, unnest(list_filter([case when k % 11 = 0 then 'type' end, case when newest and not yes and k % 7 = 0 then 'merged' end, case when newest and (not there or (yes <> (c % 2 = 0))) then 'state' end, case when newest and yes and not (there and c % 5 <> 0 and c % 13 <> 0) then 'lineage' end,
case when newest and yes and (not there or c % 17 = 0) then 'links' end], lambda x: x is not null)) as fault from m""")
register("w15_newest_manual", lambda spark, d: integrity.newest_manual(_manual_rows(spark, d)).select("play_id", "decision_id", "decision"), "select o_custkey as play_id, o_orderkey as decision_id, case when o_orderkey % 3 <> 0 then 'accept' else 'reject' end as decision from orders qualify row_number() over (partition by o_custkey order by o_orderkey % 100 desc, o_orderkey desc) = 1")
register("t3_first_links", lambda spark, d: integrity.first_link(_orders(spark, d, F.col("o_custkey").alias("play_id"), (_k() % 3).alias("scrobble_id"), _k().alias("record_id"), (_k() * 2).alias("event_id"))), "select o_custkey as play_id, o_orderkey % 3 as scrobble_id, min(o_orderkey) as record_id, min(o_orderkey) * 2 as event_id from orders group by 1, 2")
register("v26_identity_decisions", lambda spark, d: integrity.identity_decision_faults(
    _customers(spark, d, _c().alias("decision_id"), F.when(_c() % 4 == 0, "split").when(_c() % 4 == 1, "alias").otherwise("merge").alias("type"), (_c() - _c() % 2).alias("subject"), F.when(_c() % 19 != 0, _c() + F.when(_c() % 6 == 0, 3).otherwise(1)).alias("object"), F.when(_c() % 4 == 0, _c() - F.when(_c() % 8 == 0, 1).otherwise(2)).when(_c() % 23 == 0, _c() - 4).alias("supersedes")),
    _entities(spark, d), _customers(spark, d, _c().alias("decision_id"), F.when(_c() % 29 == 0, "accept").when(_c() % 4 == 0, "split").when(_c() % 4 == 1, "alias").otherwise("merge").alias("decision_type")).where("decision_id % 2 = 0"),
), f"""with {_TYPES}, m as (select c_custkey as id, case when c_custkey % 4 = 0 then 'split' when c_custkey % 4 = 1 then 'alias' else 'merge' end as ty, c_custkey - c_custkey % 2 as s, case when c_custkey % 19 <> 0 then c_custkey + case when c_custkey % 6 = 0 then 3 else 1 end end as o,
  case when c_custkey % 4 = 0 then c_custkey - case when c_custkey % 8 = 0 then 1 else 2 end when c_custkey % 23 = 0 then c_custkey - 4 end as sup from customer),
j as (select m.*, a.t as st, b.t as ot, p.ty as pt, p.s as ps, p.o as po from m left join e a on a.id = s left join e b on b.id = o left join m p on p.id = m.sup)
select id as decision_id, unnest(list_filter([case when ty in ('merge', 'split') and (ot is null or st <> ot) then 'types' end, case when sup is not null and not coalesce(ty = 'split' and pt = 'merge' and s = ps and o = po, false) then 'supersedes' end, case when id % 2 = 0 and id % 29 = 0 then 'artifact' end], lambda x: x is not null)) as fault from j""")


# Ordinals, payloads, shapes, orders of results --------------------------------------------------------------------------
def _ordinals(spark, d) -> DataFrame:
    t, c = history.table(spark, d, "conversations"), F.col("conv_id")
    ordinal = F.when(c % 11 == 0, F.col("turn") - 1).when((c % 13 == 0) & (F.col("turn") == 1), F.lit(0)).otherwise(F.col("turn"))
    rows = t.select(c.alias("file_id"), ordinal.alias("ordinal"), F.when((c % 17 == 0) & (F.col("turn") == 2), "instant").otherwise("interval").alias("source"), F.col("role"))
    files = t.groupBy(c.alias("file_id")).agg((F.count("*") + F.when(F.first(c) % 5 == 0, 1).when(F.first(c) % 7 == 0, -1).otherwise(0)).alias("total"), F.lit("interval").alias("source"))
    return integrity.ordinal_faults(rows.where("role = 'user'"), rows.where("role != 'user' or role is null"), files)


register("v7_ordinals", _ordinals, """with r as (select conv_id as f, case when conv_id % 11 = 0 then turn - 1 when conv_id % 13 = 0 and turn = 1 then 0 else turn end as o, conv_id % 17 = 0 and turn = 2 as strange from conversations),
t as (select conv_id as f, count(*) + case when conv_id % 5 = 0 then 1 when conv_id % 7 = 0 then -1 else 0 end as total from conversations group by 1),
g as (select r.f, max(o is null or o < 0) as v, count(case when o >= 0 then 1 end) <> count(distinct case when o >= 0 then o end) as c, max(strange) as k, max(o >= total) as r, count(distinct case when o >= 0 and o < total then o end) < any_value(total) as gap from r join t on r.f = t.f group by r.f)
select f as file_id, unnest(list_filter([case when v then 'value' end, case when c then 'conflict' end, case when k then 'kind' end, case when r then 'range' end, case when gap then 'gap' end], lambda x: x is not null)) as fault from g""")
register("v9_payloads", lambda spark, d: integrity.payload_faults(_orders(spark, d, F.col("o_custkey").alias("payload_id")), _customers(spark, d, _c().alias("payload_id")).where("payload_id % 9 != 0")), """select distinct o_custkey as payload_id, 'missing' as fault from orders where o_custkey % 9 = 0 or o_custkey not in (select c_custkey from customer)
union all select c_custkey, 'unused' from customer where c_custkey % 9 <> 0 and c_custkey not in (select o_custkey from orders)""")
register("v10_shapes", lambda spark, d: integrity.shape_faults(history.interval_plays(spark, d).withColumn("ms_played", F.when(F.col("record_id") % 19 == 0, F.col("ms_played") - 10_000_000_000_000).when(F.col("record_id") % 23 == 0, F.col("stopped_at_ms") + 1).otherwise(F.col("ms_played"))).withColumn("track", F.when(F.col("record_id") % 29 == 0, F.lit("\u00a0\t")).otherwise(F.col("track"))).withColumn("track_uri", F.when(F.col("record_id") % 31 != 0, F.col("track_uri")))), f"""{_EVIDENCE}
select record_id, unnest(list_filter([case when record_id % 19 = 0 then 'duration' end, case when record_id % 19 <> 0 and record_id % 23 = 0 then 'start' end, case when record_id % 29 = 0 then 'text' end, case when record_id % 31 = 0 then 'uri' end], lambda x: x is not null)) as fault from plays""")


def _unmerged(spark, d) -> DataFrame:
    c = _chain(spark, d)
    return integrity.unmerged_accepts(c.scores, c.links.where("record_id % 4 != 3"))


register("v24_unmerged_accepts", _unmerged, f"{_EVENTS} select play_id, scrobble_id from mg where scrobble_id % 4 = 3")
register("j11_referenced", lambda spark, d: decisions.referenced(_orders(spark, d, _k().alias("decision_id"), F.when(_k() % 3 == 0, "instant").otherwise("interval").alias("kind"), F.sha2(F.concat(F.lit("file-"), _k() % 4), 256).alias("file_sha256"), F.floor(_k() / 4).cast("long").alias("ordinal")), _references(spark, d)).select("decision_id", "record_id"), f"{_BOTH} select o_orderkey as decision_id, record_id from orders left join u on record_id = o_orderkey and source = case when o_orderkey % 3 = 0 then 'instant' else 'interval' end")
register("f9_iso_text", lambda spark, d: _both(spark, d).select("record_id", iso_millis(F.col("at_ms")).alias("iso"), evidence.seconds_of_ms(F.col("at_ms")).alias("seconds")), f"{_BOTH} select record_id, strftime(make_timestamp(at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as iso, at_ms // 1000 as seconds from u")
register("t1_ordered_base", lambda spark, d: ordering.ordered(history.canonical_base(spark, d).select("event_id", "artist_id", "instant_ms"), "base"), f"{_BASE} select event_id, artist_id, instant_ms from base order by instant_ms, event_id")
register("t1_ordered_eras", lambda spark, d: ordering.ordered(QUERIES["n3_era_intervals"](spark, d), "eras"), ORACLES["n3_era_intervals"] + " order by start_month, artist_id")
register("t1_ordered_rediscoveries", lambda spark, d: ordering.ordered(QUERIES["n4_rediscovery_artist"](spark, d), "rediscoveries"), ORACLES["n4_rediscovery_artist"] + " order by instant_ms, entity_id")
register("t1_ordered_abandonments", lambda spark, d: ordering.ordered(QUERIES["n5_abandonment"](spark, d), "abandonments"), ORACLES["n5_abandonment"] + " order by absence_days desc, artist_id")
