"""More registered queries: fingerprints by their bytes, replayed identities, claims, batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _BASE, _EVENTS, _EVIDENCE, _MT, _PAIRS, _SCORES, ORACLES, TZ, _both, _sources, register
from .operators import constraints, coverage, evidence, replay
from .plans import envelope, publishing, reconciliation
from .plans.storage import shared_dir, stored
from .functions.text import with_match_text
from .sources import history
from .streaming import plays as streams

# Fingerprints ---------------------------------------------------------------------------------------------------------
_tagged = lambda name, value: f"'[\"{name}\",' || coalesce({value}, '\"null\",null') || ']'"
_text, _number, _bool = (lambda c: f"'\"string\",' || to_json({c})"), (lambda c: f"'\"number\",' || {c}"), (lambda c: f"'\"boolean\",' || {c}")


def _canonical_sql(version: str, kind: str, fields: dict[str, str]) -> str:
    parts = " || ',' || ".join(_tagged(n, fields.get(n, "null::varchar")) for n in sorted(fields))
    return f"sha256('{{\"fields\":[' || {parts} || '],\"sourceKind\":\"{kind}\",\"version\":\"{version}\"}}')"


def _print_sql(form: tuple, **given: str) -> str:
    return _canonical_sql(form[0], form[1], {n: given.get(n, "null::varchar") for n in form[2]})


register(
    "f2_interval_fingerprints",
    lambda spark, d: history.interval_plays(spark, d).select("record_id", evidence.record_fingerprint(evidence.INTERVAL_PRINT, albumName=F.col("album"), artistName=F.col("artist"), msPlayed=F.col("ms_played"), skipped=F.col("skipped"), spotifyTrackUri=F.col("track_uri"), startedAtEpochMs=F.col("stopped_at_ms") - F.col("ms_played"), stoppedAtEpochMs=F.col("stopped_at_ms"), trackName=F.col("track")).alias("fingerprint")),
    f"{_EVIDENCE} select record_id, {_print_sql(evidence.INTERVAL_PRINT, albumName=_text('album'), artistName=_text('artist'), msPlayed=_number('ms_played'), skipped=_bool('skipped'), spotifyTrackUri=_text('track_uri'), startedAtEpochMs=_number('(stopped_at_ms - ms_played)'), stoppedAtEpochMs=_number('stopped_at_ms'), trackName=_text('track'))} as fingerprint from plays",
)
register(
    "f2_instant_fingerprints",
    lambda spark, d: history.instant_scrobbles(spark, d).select("record_id", evidence.record_fingerprint(evidence.INSTANT_PRINT, albumName=F.col("album"), artistMusicbrainzId=F.col("artist_mbid"), artistName=F.col("artist"), recordingMusicbrainzId=F.col("recording_mbid"), scrobbledAtEpochMs=F.col("instant_ms"), trackName=F.col("track")).alias("fingerprint"), evidence.overlap_fingerprint(F.col("instant_ms"), F.col("artist"), F.col("track")).alias("overlap")),
    f"{_EVIDENCE} select record_id, {_print_sql(evidence.INSTANT_PRINT, albumName=_text('album'), artistMusicbrainzId=_text('artist_mbid'), artistName=_text('artist'), recordingMusicbrainzId=_text('recording_mbid'), scrobbledAtEpochMs=_number('instant_ms'), trackName=_text('track'))} as fingerprint, {_print_sql(evidence.OVERLAP_PRINT, artistName=_text('artist'), scrobbledAtEpochMs=_number('instant_ms'), trackName=_text('track'))} as overlap from scrobbles",
)
register(
    "f2_text_fingerprints", lambda spark, d: history.table(spark, d, "documents").select("doc_id", evidence.fingerprint("text-v1", "documents", text=F.col("text"), lang=F.col("lang"), n=F.col("n_chars"), long=F.col("n_chars") > 2000).alias("fingerprint")),
    f"select doc_id, {_canonical_sql('text-v1', 'documents', dict(text=_text('text'), lang=_text('lang'), n=_number('n_chars'), long=_bool('(n_chars > 2000)')))} as fingerprint from documents",
)

# Replayed identities --------------------------------------------------------------------------------------------------
# All records change together in rounds; a record is settled once what it refers to is, and the recursion ends when none changes.
_REPLAY = f"""with recursive {history.EVIDENCE_SQL},
rec0 as (select record_id as r, {_MT.format("artist")} as an, {_MT.format("track")} as tn, {_MT.format("album")} as bn, album is not null as has_album, null::varchar as mbid, 'uri:' || track_uri as rid from plays
  union all select record_id, {_MT.format("artist")}, {_MT.format("track")}, {_MT.format("album")}, album is not null, artist_mbid, 'mbid:' || recording_mbid from scrobbles),
rec as materialized (select *, case when mbid is not null then min(r) over (partition by mbid) end as fm, case when rid is not null then min(r) over (partition by rid) end as fr from rec0),
ar(r, own, round) using key (r) as (select r, r as own, 0 as round from rec union
  (with cur as materialized (select rec.*, x.own from rec join recurring.ar x using (r)),
   b as (select an, own, min(r) as seen, min(case when fm < r or tn is null then r end) as opens from cur where an is not null group by all), b1 as (select an, arg_min(own, seen) as who, min(seen) as since from b group by an),
   b2 as (select an, who, since, min(case when own <> who then opens end) as until from b join b1 using (an) group by all),
   nw as (select cur.r, cur.own, case when cur.fm < cur.r then f.own when cur.tn is null then cur.r else coalesce(case when since < cur.r and (until is null or until >= cur.r) then who end, cur.r) end as new
     from cur left join b2 on b2.an = cur.an left join cur f on f.r = cur.fm)
   select r, new, 1 from nw where new <> own)),
ra as materialized (select rec.*, own from rec join ar using (r)),
tr(r, t, rel, round) using key (r) as (select r, r as t, case when has_album then r end as rel, 0 as round from ra union
  (with cur as materialized (select ra.*, x.t, x.rel from ra join recurring.tr x using (r)),
   ti as (select t, tn, min(r) as seen from cur where tn is not null group by all), al as (select rel, bn, min(r) as seen from cur where rel is not null and bn is not null group by all), mk as (select r as t, own, rel, tn as otn, bn as obn, has_album from cur where r = t),
   b as (select own, tn, bn, ti.t, greatest(ti.seen, coalesce(al.seen, ti.seen)) as seen, otn, obn from ti join mk on mk.t = ti.t left join al on al.rel = mk.rel where mk.rel is null or bn is not null),
   b1 as (select own, tn, bn, arg_min(t, seen) as who, min(seen) as since from b group by all),
   b2 as (select b.own, b.tn, b.bn, who, since, min(case when t <> who and not (seen = t and b.tn = otn and b.bn is not distinct from obn) then seen end) as until from b join b1 on b.own = b1.own and b.tn = b1.tn and b.bn is not distinct from b1.bn group by all),
   nt as (select cur.r, cur.t, cur.rel, case when cur.fr < cur.r then f.t else coalesce(case when since < cur.r and (until is null or until >= cur.r) then who end, cur.r) end as new
     from cur left join b2 on b2.own = cur.own and b2.tn = cur.tn and b2.bn is not distinct from cur.bn left join cur f on f.r = cur.fr),
   nr as (select nt.r, nt.t, nt.rel, nt.new, case when mk.has_album then mk.t end as newrel from nt left join mk on mk.t = nt.t)
   select r, new, newrel, 1 from nr where new <> t or newrel is distinct from rel)),
fin as (select ra.*, t, rel, mk.own as artist_id from ra join tr using (r) join (select r as t, own from ra) mk using (t))
select r as record_id, artist_id, t as track_id, rel as release_id from fin"""


def _replayed(spark, d) -> DataFrame:
    return replay.replayed(reconciliation.evidence_records(*_sources(spark, d)[:2]))


register("i3_replayed", lambda spark, d: _replayed(spark, d).select("record_id", "artist_id", "track_id", "release_id"), _REPLAY)


# Claims ---------------------------------------------------------------------------------------------------------------
def _contested(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records, pairs, exact duplicates and a reviewer's decisions: accepts of every third pair, the latest first, and rejects of every fifth."""
    plays, scrobbles, same_play, same_scrobble = _sources(spark, d)
    _, p, s, pairs = reconciliation.candidates(plays, scrobbles, same_play, same_scrobble)
    pairs = stored(pairs)
    k = F.col("play_id") + F.col("scrobble_id")
    manual = pairs.select("play_id", "scrobble_id", F.when(k % 3 == 0, "accept").when(k % 5 == 0, "reject").alias("decision"), (-F.col("play_id")).alias("ordinal")).where("decision is not null")
    return p, s, pairs, reconciliation.duplicates_of(plays, scrobbles, same_play, same_scrobble), manual


def _decided(part: int):
    def query(spark, d):
        p, s, pairs, again, manual = _contested(spark, d)
        return reconciliation.decided_events(p, s, pairs, again, manual)[part]

    return query


_CLAIMS = """k1 as (select play_id, scrobble_id, (play_id + scrobble_id) % 3 = 0 or (play_id + scrobble_id) % 5 = 0 as by_hand, case when (play_id + scrobble_id) % 3 = 0 then 'accept' when (play_id + scrobble_id) % 5 = 0 then 'reject' else decision end as wanted from dc),
k2 as (select *, row_number() over (partition by scrobble_id, wanted = 'accept' order by not by_hand, case when by_hand then -play_id end, play_id, scrobble_id) as nth from k1),
arb as (select play_id, scrobble_id, case when wanted = 'accept' and nth > 1 then 'review' else wanted end as decision, case when by_hand then 'manual' else 'automatic' end as origin, wanted = 'accept' and nth > 1 as stale from k2),
mg0 as (select play_id, scrobble_id from arb where decision = 'accept'), mg as (select play_id, min(scrobble_id) as scrobble_id from mg0 group by 1)"""
_CLAIMED = _EVENTS.replace("mg as (select play_id, scrobble_id from dc where decision = 'accept')", _CLAIMS).replace("not in (select scrobble_id from mg)", "not in (select scrobble_id from mg0)").replace("select event_id, scrobble_id, 'instant', 'cross_source_match' from ev_all where scrobble_id is not null", "select play_id, scrobble_id, 'instant', 'cross_source_match' from mg0")
register("r12_arbitrated", _decided(1), f"{_EVIDENCE}, {_PAIRS}, {_SCORES}, {_CLAIMS} select * from arb")
register("r10_claimed_events", _decided(2), f"{_CLAIMED} select * from ev_all")
register("r17_claimed_links", _decided(3), f"{_CLAIMED} select * from lk")


# Published datasets ---------------------------------------------------------------------------------------------------
def _published_events(spark, d) -> DataFrame:
    k = F.col("event_id")
    rule = F.when(k % 3 == 0, "canonical-event-v1").when(k % 7 == 0, " ").otherwise("cross-source-decision-policy-v1")
    return history.canonical_base(spark, d).withColumn("has_interval", k % 2 == 0).withColumn("has_instant", k % 2 == 1).withColumn("rule_version", rule)


def _publish(spark, d) -> tuple[str, publishing.Analyses, DataFrame, DataFrame]:
    """The folder, the datasets, the state and the manifest of a bundle."""
    events, path = _published_events(spark, d), f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    found = publishing.analyses(events, _both(spark, d), TZ, ["identity-resolution-v1"])
    return path, found, events, publishing.publish(found, events, path, 1)


def _manifest(spark, d) -> DataFrame:
    """Each dataset with its number of rows, whether its digest is that of what can be read, and its envelope."""
    path, _, _, manifest = _publish(spark, d)
    bundle = publishing.newest(spark, path)
    again = [envelope.digest(spark.read.parquet(f"{bundle}/{n}")).select(F.lit(n).alias("dataset"), F.col("digest").alias("again")) for n in publishing.ANALYSES]
    read = again[0]
    for x in again[1:]:
        read = read.unionByName(x)
    e = spark.read.parquet(f"{bundle}/envelopes")
    known = F.array_join(F.transform(F.array(*map(F.lit, publishing.FIELDS)), lambda f: F.concat(f, F.lit("="), F.col("coverage")[f]["available"].cast("string"), F.lit("/"), F.col("coverage")[f]["total"].cast("string"))), ",")
    return manifest.join(read, "dataset").join(e, "dataset").select(
        "dataset", "n", (F.col("digest") == F.col("again")).alias("whole"), "analysis", "schema_version", "timezone", "event_count", "start_ms", "end_ms", "as_of_ms", F.array_join("sources", ",").alias("sources"), known.alias("coverage"), F.round("unresolved_rate", 9).alias("unresolved_rate"),
        F.col("versions.query").alias("query"), F.array_join("versions.identity_rules", ",").alias("identity_rules"), F.array_join("versions.reconciliation_rules", ",").alias("reconciliation_rules"),
    )


_SIZES = " union all ".join(f"select '{n}' as dataset, '{publishing.ANALYSES[n][0]}' as analysis, '{publishing.ANALYSES[n][3]}' as query, (select count(*) from ({ORACLES[q]})) as n" for n, q in (("volume", "n1_volume_month"), ("artist-eras", "n3_era_intervals"), ("rediscovery", "n4_rediscovery_artist"), ("abandonment", "n5_abandonment"), ("coverage", "c1_by_year")))
register("x4_published", _manifest, f"""{_BASE}, z as ({_SIZES}),
one as (select count(*) as event_count, min(instant_ms) as start_ms, max(instant_ms) + 1 as end_ms, max(instant_ms) + 1 as as_of_ms, 'artist_id=' || count(artist_id) || '/' || count(*) || ',track_id=' || count(track_id) || '/' || count(*) || ',listened_ms=' || count(listened_ms) || '/' || count(*) as coverage,
  round(count(case when event_status = 'unresolved' then 1 end) / count(*), 9) as unresolved_rate from base)
select dataset, n, true as whole, analysis, 'analytical-result-v2' as schema_version, '{TZ}' as timezone, event_count, start_ms, end_ms, as_of_ms, 'instant,interval' as sources, coverage, unresolved_rate, query, 'identity-resolution-v1' as identity_rules,
  'canonical-event-v1,cross-source-decision-policy-v1' as reconciliation_rules from z, one""")


def _verified(spark, d) -> DataFrame:
    """The bundle as it stands, then after one dataset's content has changed, then after the state has."""
    path, found, events, _ = _publish(spark, d)
    first = stored(publishing.verify(path, events, found))
    damaged = stored(spark.read.parquet(f"{publishing.newest(spark, path)}/abandonment").withColumn("absence_days", F.col("absence_days") + 1))
    damaged.write.mode("overwrite").parquet(f"{publishing.newest(spark, path)}/abandonment")
    second = stored(publishing.verify(path, events, found))
    moved = events.withColumn("event_status", F.when(F.col("event_id") % 1000 == 1, "superseded").otherwise(F.col("event_status")))
    third = publishing.verify(path, moved)
    return first.withColumn("when", F.lit("published")).unionByName(second.withColumn("when", F.lit("damaged"))).unionByName(third.withColumn("when", F.lit("moved")))


register("x5_verified", _verified, f"""{_BASE}, m as (select count(case when event_id % 1000 = 1 then 1 end) > 0 as moved from base), n as (select unnest(['volume', 'artist-eras', 'rediscovery', 'abandonment', 'coverage', 'envelopes']) as dataset), a as (select count(*) > 0 as filled from ({ORACLES['n5_abandonment']}))
select dataset, w as "when", case when w <> 'published' and dataset = 'abandonment' and filled then 'invalid' when w = 'moved' and moved then 'stale' else 'valid' end as status from n, m, a, (select unnest(['published', 'damaged', 'moved']) as w)""")


# Constraints ----------------------------------------------------------------------------------------------------------
def _model(spark, d) -> dict[str, DataFrame]:
    """Runs of customers, files of parts, records and events of orders, links of lines; each rule is broken by some."""
    k, c, p = F.col("o_orderkey"), F.col("c_custkey"), F.col("p_partkey")
    run = history.table(spark, d, "customer").select(
        F.when(c % 50 != 0, c).alias("id"), F.lit("export").alias("source_type"), F.when(c % 7 == 0, "stopped").when(c % 3 == 0, "running").otherwise("succeeded").alias("status"), F.lit(5).alias("started_ms"), F.when(c % 4 != 0, F.lit(9)).alias("completed_ms"),
        (c % 10).alias("discovered_count"), (c % 9).alias("accepted_count"), F.lit(0).alias("rejected_count"), (F.floor(c / 11) % 2 - F.floor(c / 13) % 2).alias("unsupported_count"),
    )
    file = history.table(spark, d, "part").select(
        p.alias("id"), F.concat(F.when(p % 17 == 0, "/").otherwise(""), (p % 1500).cast("string")).alias("relative_path"), F.when(p % 19 == 0, "other").otherwise("lastfm_export").alias("source_type"), (p - 5).alias("byte_size"), F.when(p % 23 == 0, F.upper(F.sha2(p.cast("string"), 256))).otherwise(F.sha2((p % 1900).cast("string"), 256)).alias("content_sha256"),
        F.when(p % 2 == 0, p).alias("observed_start_ms"), (p - p % 3 + 1).alias("observed_end_ms"), (p % 160).alias("first_run_id"), F.when(p % 29 != 0, p % 100 + 1).alias("last_run_id"),
    )
    event = history.table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 101 != 0, k % 9).alias("track_id"), F.when(k % 5 != 0, k).alias("started_ms"), F.when(k % 7 != 0, F.when(k % 11 == 0, k - 1).otherwise(k + 1)).alias("ended_ms"), (k - 50).alias("listened_ms"), F.when(k % 13 == 0, "guessed").otherwise("observed_start").alias("time_basis"),
        F.when(k % 6 == 0, "superseded").otherwise("current").alias("event_status"), F.lit("v1").alias("rule_version"), F.when(k % 12 == 0, k).when(k % 18 == 0, -k).when(k % 31 == 0, F.lit(1)).alias("superseded_by"),
    )
    l = history.table(spark, d, "lineitem")
    link = l.select(F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("event_id"), (F.col("l_orderkey") * 4 + F.col("l_linenumber") % 4).alias("record_id"), F.when(F.col("l_linenumber") == 2, "cross_source_match").when(F.col("l_linenumber") == 5, "copy").otherwise("primary").alias("role"), F.col("l_discount").cast("double").alias("discount"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("candidate_id"))
    return {"ingest_run": run, "source_file": file, "listening_event": event, "event_source": link.withColumn("match_score", F.col("discount") * 12).drop("discount")}


_MODEL = """run as (select case when c_custkey % 50 <> 0 then c_custkey end as id, case when c_custkey % 7 = 0 then 'stopped' when c_custkey % 3 = 0 then 'running' else 'succeeded' end as status, case when c_custkey % 4 <> 0 then 9 end as completed, c_custkey % 10 as disc, c_custkey % 9 as acc, c_custkey // 11 % 2 - c_custkey // 13 % 2 as uns from customer),
file as (select p_partkey as id, case when p_partkey % 17 = 0 then '/' else '' end || p_partkey % 1500 as path, p_partkey % 19 = 0 as other, p_partkey - 5 as size, case when p_partkey % 23 = 0 then upper(sha256(p_partkey::varchar)) else sha256((p_partkey % 1900)::varchar) end as sha, case when p_partkey % 2 = 0 then p_partkey end as os, p_partkey - p_partkey % 3 + 1 as oe, p_partkey % 160 as r1, case when p_partkey % 29 <> 0 then p_partkey % 100 + 1 end as r2 from part),
ev as (select o_orderkey as id, case when o_orderkey % 101 <> 0 then 1 end as track, case when o_orderkey % 5 <> 0 then o_orderkey end as s, case when o_orderkey % 7 <> 0 then case when o_orderkey % 11 = 0 then o_orderkey - 1 else o_orderkey + 1 end end as e, o_orderkey - 50 as lm, o_orderkey % 13 = 0 as guessed, o_orderkey % 6 = 0 as gone, case when o_orderkey % 12 = 0 then o_orderkey when o_orderkey % 18 = 0 then -o_orderkey when o_orderkey % 31 = 0 then 1 end as sb from orders),
ln as (select case when l_linenumber = 7 then -l_orderkey else l_orderkey end as event, l_orderkey * 4 + l_linenumber % 4 as record, l_linenumber = 5 as odd, l_linenumber = 2 and l_partkey % 2 = 1 as bare, cast(l_discount as double) * 12 as score from lineitem),
v(t, r, n) as (select 'ingest_run', 'id_required', count(*) from run where id is null union all select 'ingest_run', 'status', count(*) from run where status = 'stopped' union all select 'ingest_run', 'completion', count(*) from run where (status = 'running') <> (completed is null)
union all select 'ingest_run', 'unsupported_count_not_negative', count(*) from run where uns < 0 union all select 'ingest_run', 'run_counts', count(*) from run where status = 'succeeded' and disc <> acc + uns
union all select 'source_file', 'relative', count(*) from file where path like '/%' union all select 'source_file', 'source_type', count(*) from file where other union all select 'source_file', 'content_sha256', count(*) from file where sha <> lower(sha) union all select 'source_file', 'byte_size_not_negative', count(*) from file where size < 0
union all select 'source_file', 'observed_order', count(*) from file where oe < os union all select 'source_file', 'last_run_id_required', count(*) from file where r2 is null union all select 'source_file', 'relative_path_unique', count(*) - count(distinct path) from file union all select 'source_file', 'content_sha256_unique', count(*) - count(distinct sha) from file
union all select 'source_file', 'first_run_id_known', count(*) from file where r1 not in (select id from run where id is not null) union all select 'source_file', 'last_run_id_known', count(*) from file where r2 not in (select id from run where id is not null)
union all select 'listening_event', 'track_id_required', count(*) from ev where track is null union all select 'listening_event', 'time_basis', count(*) from ev where guessed union all select 'listening_event', 'listened_ms_not_negative', count(*) from ev where lm < 0 union all select 'listening_event', 'has_time', count(*) from ev where s is null and e is null
union all select 'listening_event', 'time_order', count(*) from ev where e < s union all select 'listening_event', 'successor', count(*) from ev where gone <> (sb is not null) union all select 'listening_event', 'not_its_own', count(*) from ev where sb = id union all select 'listening_event', 'superseded_by_known', count(*) from ev where sb not in (select id from ev)
union all select 'event_source', 'role', count(*) from ln where odd union all select 'event_source', 'match_score', count(*) from ln where score > 1 union all select 'event_source', 'match_has_candidate', count(*) from ln where bare union all select 'event_source', 'event_id_known', count(*) from ln where event not in (select id from ev)
union all select 'event_source', 'event_id_record_id_unique', count(*) - count(distinct (event, record)) from ln union all select 'event_source', 'record_id_unique', count(*) - count(distinct record) from ln)"""


def _findings(spark, d) -> DataFrame:
    expected = history.table(spark, d, "nation").groupBy(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("metric")).agg(F.count("*").alias("expected"))
    actual = history.table(spark, d, "customer").groupBy(F.concat(F.lit("region-"), (F.col("c_nationkey") % 5).cast("string")).alias("metric")).agg(F.count("*").alias("actual"))
    return constraints.findings(constraints.violations(_model(spark, d)), coverage.baseline_differences(actual, expected))


register("v29_constraints", lambda spark, d: constraints.violations(_model(spark, d)).where("violations > 0"), f'with {_MODEL} select t as "table", r as rule, cast(n as bigint) as violations from v where n > 0')
register("v28_findings", _findings, f"""with {_MODEL}, x as (select 'region-' || n_regionkey as m, count(*) as expected from nation group by 1), a as (select 'region-' || c_nationkey % 5 as m, count(*) as actual from customer group by 1)
select t || '.' || r as code, 'error' as severity, cast(n as bigint) as n from v where n > 0 union all select 'baseline.' || coalesce(x.m, a.m), 'warning', abs(coalesce(actual, 0) - coalesce(expected, 0)) from x full join a on x.m = a.m where actual is distinct from expected""")


# Streams --------------------------------------------------------------------------------------------------------------
def _streamed_pairs(spark, d) -> DataFrame:
    """Plays and scrobbles written as files in the order of their starts, read as two streams and joined as they come."""
    folder = f"{shared_dir(spark)}/streams-{uuid.uuid4().hex}"
    kind = "record_id long, listener long, artist_key string, track_key string, start timestamp"
    for name, rows, at in (("plays", history.interval_plays(spark, d), F.col("stopped_at_ms") - F.col("ms_played")), ("scrobbles", history.instant_scrobbles(spark, d), F.col("instant_ms"))):
        keyed = with_match_text(rows, artist_key="artist", track_key="track").select("record_id", "listener", "artist_key", "track_key", F.timestamp_millis(at).alias("start"))
        keyed.repartitionByRange(4, "start").write.parquet(f"{folder}/{name}")
    read = lambda name: spark.readStream.schema(kind).parquet(f"{folder}/{name}")
    # all files may come in one trigger and in any order, so nothing may be late
    q = streams.paired(read("plays"), read("scrobbles"), delay="3650 days").writeStream.format("parquet").option("path", f"{folder}/pairs").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("play_id long, scrobble_id long, delta_ms long").parquet(f"{folder}/pairs")


register("j6_streamed_pairs", _streamed_pairs, f"""{_EVIDENCE}, p as (select record_id, listener, {_MT.format("artist")} as a, {_MT.format("track")} as t, stopped_at_ms - ms_played as s from plays), q as (select record_id, listener, {_MT.format("artist")} as a, {_MT.format("track")} as t, instant_ms as s from scrobbles)
select p.record_id as play_id, q.record_id as scrobble_id, q.s - p.s as delta_ms from p join q on p.listener = q.listener and p.a = q.a and p.t = q.t and abs(q.s - p.s) <= 30000""")
