import datetime as dt

import pytest
from pyspark.sql import functions as F

from sonograin.operators import coverage, eras, evidence, reconcile, returns, sync, volume
from sonograin.plans import envelope
from sonograin.functions.text import match_text

SCHEMA = "event_id long, artist_id long, track_id long, instant_ms long, listened_ms long, event_status string"


def ms(text):
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp() * 1000)


def plays(spark, rows):
    return spark.createDataFrame([(i, a, a * 10, t, None, "current") for i, (a, t) in enumerate(rows)], SCHEMA)


def test_volume_fills_the_axis_across_a_leap_day(spark):
    e = plays(spark, [(1, ms("2024-02-28T18:00")), (1, ms("2024-02-29T18:00")), (1, ms("2024-03-02T18:00"))])
    rows = volume.listening_volume(e, "day", start_ms=ms("2024-02-28T00:00"), end_ms=ms("2024-03-03T00:00")).orderBy("period").collect()
    assert [(r.period, r.value) for r in rows] == [("2024-02-27", 0), ("2024-02-28", 1), ("2024-02-29", 1), ("2024-03-01", 0), ("2024-03-02", 1)]
    assert volume.listening_volume(e.limit(0), "day").count() == 0


def test_iso_week_53(spark):
    e = plays(spark, [(1, ms("2020-12-31T18:00")), (1, ms("2021-01-04T18:00"))])
    rows = volume.listening_volume(e, "week", rolling=2).orderBy("period").collect()
    assert [(r.period, r.value, r.rolling_value, r.prior_year_value) for r in rows] == [("2020-W53", 1, 1, None), ("2021-W01", 1, 2, None)]


def test_eras_of_the_golden_history(spark):
    counts = {1: (1, 2, 3, 3, 0), 2: (2, 2, 2, 2, 0), 3: (3, 3, 2, 2, 0), 4: (0, 0, 0, 1, 0), 5: (0, 0, 0, 0, 1)}
    rows = [(a, ms(f"2024-{m + 1:02}-{d + 1:02}T18:00")) for a, c in counts.items() for m, n in enumerate(c) for d in range(n)]
    rules = eras.EraRules(maximum_rank=5, minimum_consecutive=1, minimum_change=-12, minimum_share=0.1, minimum_rolling=4, minimum_window=2, rolling_windows=2, window_months=1)
    windows = eras.era_windows(plays(spark, rows), rules)
    got = {r.artist_id: (r.window_start, r.window_end_exclusive) for r in eras.era_intervals(windows, 1).collect()}
    assert got[2] == got[3] == ("2024-02", "2024-05") and 4 not in got and 5 not in got


def test_rediscovery_bounds_are_inclusive(spark):
    day = 86_400_000
    t0 = ms("2020-01-01T12:00")
    e = plays(spark, [(1, t0 + i * day) for i in range(5)] + [(1, t0 + 4 * day + 180 * day)] + [(2, t0 + 4 * day + 180 * day - i * 1000) for i in range(3)])
    none = spark.createDataFrame([], "artist_id long, start_month int, end_month int")
    (r,) = returns.rediscoveries(e, none).collect()
    assert (r.entity_id, r.gap_days, r.prior_play_count, r.return_intensity, r.persistence, r.classification) == (1, 180.0, 5, 1, "open", "one_off_return")


def test_abandonment_splits_periods_strictly_after_the_gap(spark):
    day = 86_400_000
    t0 = ms("2020-01-01T12:00")
    e = plays(spark, [(1, t0 + x * day) for x in (0, 90, 181, 182, 183)] + [(2, t0 + 183 * day + 400 * day)])
    (r,) = returns.abandonments(e).collect()
    assert (r.artist_id, r.active_period_count, r.period_play_count, r.absence_days, r.status) == (1, 2, 3, 400.0, "likely_abandoned_as_of")


def test_match_text(spark):
    rows = [
        ("  Beyonce\u0301 feat. Jay-Z (Live)  ", "beyonc\u00e9 feat jayz live"), ("Beyonce\u0301", "beyonc\u00e9"), ("...", None), (None, None), ("\u00e9feat", "\u00e9 feat"), ("a b", "a b"), (" \t\n", None), ("a\u00a0b\ufeff", "a b"),
        ("Artist Featuring Guest ft. Another Feat. Third", "artist feat guest feat another feat third"), ("Defeating the Leftfield", "defeating the leftfield"), ("feat.x", "feat x"),
        ("Suite No. 1: Movement I (Live Remix) [Radio Edit Version]", "suite no 1 movement i live remix radio edit version"),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", match_text(F.col("t")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [k for _, k in rows]


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ('{"ts":"2026-01-02T03:04:05.678Z","ms_played":1,"spotify_track_uri":"spotify:track:0000000000000000000001","master_metadata_album_artist_name":"a","master_metadata_track_name":"t","shuffle":false}', ("track", None)),
        ("3", ("malformed", "invalid_record")),
        ('{"ts":"2026-02-30T00:00:00Z","ms_played":1}', ("malformed", "invalid_timestamp")),
        ('{"ts":"2026-01-02T03:04:05Z","ms_played":1.5}', ("malformed", "invalid_duration")),
        ('{"ts":"1970-01-01T00:00:00Z","ms_played":1}', ("malformed", "invalid_time_arithmetic")),
        ('{"ts":"2026-01-02T03:04:05Z","ms_played":1,"shuffle":"no"}', ("malformed", "invalid_field_type")),
        ('{"ts":"2026-01-02T03:04:05Z","ms_played":1,"shuffle":true,"episode_name":"e"}', ("excluded", "episode_or_audiobook")),
        ('{"ts":"2026-01-02T03:04:05Z","ms_played":1.0,"shuffle":true,"episode_name":"\\t\u00a0"}', ("excluded", "video_or_unsupported")),
        ('{"ts":"2026-01-02T03:04:05Z","ms_played":1e2,"shuffle":true,"offline_timestamp":-1}', ("malformed", "invalid_field_type")),
        ('{"ts":"2026-01-02T03:04:05Z","ms_played":9007199254740992,"shuffle":true}', ("malformed", "invalid_duration")),
        ('{"ts":"2026-01-02T03:04:05Z","ms_played":1,"spotify_track_uri":"spotify:track:0000000000000000000001","master_metadata_album_artist_name":"\\n","master_metadata_track_name":"t","shuffle":false}', ("malformed", "invalid_track_metadata")),
    ],
)
def test_interval_records(spark, record, want):
    members = spark.createDataFrame([(record,)], "j string").select(F.parse_json("j").alias("record"))
    (r,) = evidence.classify_interval(members).collect()
    assert (r.kind, r.reason) == want


def test_files_of_both_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"timestamp":1.0,"artist_name":"a","track_name":"t","album_name":"  "},{"timestamp":2,"artist_name":"\\t","track_name":"t"},7]')
    (tmp_path / "b.json").write_text('{"scrobbles":[{"date":3,"artist":"b","track":"u","album":"x","albumId":"rel"}],"account":"hidden"}')
    (tmp_path / "c.json").write_text("{}")
    texts = evidence.json_texts(spark, str(tmp_path))
    assert evidence.json_members(texts, "scrobbles").count() == 4 and evidence.json_members(texts).count() == 3
    got = sorted((r.ordinal, r.kind, r.reason, r.instant_ms, r.artist, r.track, r.album, r.release_mbid) for r in evidence.classify_export(texts).where("kind = 'scrobble'").collect())
    assert got == [(0, "scrobble", None, 1, "a", "t", None, None), (0, "scrobble", None, 3, "b", "u", "x", "rel")]
    assert sorted(r.reason for r in evidence.classify_export(texts).where("kind != 'scrobble'").collect()) == ["invalid_record", "invalid_required_text"]
    assert [r.file.rsplit("/")[-1] for r in evidence.file_faults(texts, "scrobbles").collect()] == ["c.json"]
    assert evidence.file_registry(spark, str(tmp_path)).count() == 3
    classified = evidence.classify_export(texts)
    for _ in range(2):
        evidence.append_evidence(classified, "scrobble", str(tmp_path / "out"), "file", "ordinal")
    assert spark.read.parquet(str(tmp_path / "out/accepted")).count() == 4 == spark.read.parquet(str(tmp_path / "out/rejected")).count()
    assert spark.read.parquet(str(tmp_path / "out/rejected")).columns == ["file", "ordinal", "error_code"]


def test_sync_append_outcomes(spark):
    kind = "scope int, instant_ms long, artist string, track string, album string, artist_mbid string, release_mbid string, recording_mbid string"
    row = lambda at, m=None, a=None, album=None: (1, at, "a", "t", album, a, None, m)
    stored = spark.createDataFrame([row(10, "m"), row(20), row(40, None, "x"), row(50), row(50, "m")], kind)
    new = spark.createDataFrame([row(10, "m"), row(20, "m"), row(10, "other"), row(30), row(40, None, "y"), row(40, None, "x", "new album"), row(50, "m", None, "z")], kind)
    got = {(r.instant_ms, r.recording_mbid, r.artist_mbid): r.outcome for r in sync.append_plan(new, stored).collect()}
    assert got == {(10, "m", None): "existing", (20, "m", None): "matched", (10, "other", None): "inserted", (30, None, None): "inserted", (40, None, "y"): "inserted", (40, None, "x"): "matched", (50, "m", None): "inserted"}


def test_rediscovery_counts_across_day_edges(spark):
    """Counts after a return go by whole days and the plays of the last ones; against a plain count."""
    import random

    r, day = random.Random(5), 86_400_000
    rows = [(a, ms("2019-01-01T00:00") + r.randrange(40) * day * r.choice([1, 1, 25]) + r.choice([0, day - 1, r.randrange(day)])) for a in range(12) for _ in range(60)]
    rows = [(a, t + (400 * day if r.random() < 0.3 else 0)) for a, t in rows]
    e = plays(spark, rows)
    none = spark.createDataFrame([], "artist_id long, start_month int, end_month int")
    got = {(x.entity_id, x.event_id): (x.instant_ms, x.prior_ms, x.prior_play_count, x.return_intensity, x.persistence_play_count) for x in returns.rediscoveries(e, none).collect()}
    want = {}
    for a in range(12):
        own = sorted((t, i) for i, (b, t) in enumerate(rows) if b == a)
        for k in range(5, len(own)):
            t, p = own[k][0], own[k - 1][0]
            if t - p >= 180 * day:
                want[a, own[k][1]] = (t, p, k, sum(t <= x < t + 30 * day for x, _ in own), sum(t + 30 * day <= x < t + 120 * day for x, _ in own))
    assert got == want and want


def test_a_return_may_begin_a_new_era(spark):
    from sonograin import catalog

    kinds = {r.classification for r in catalog.QUERIES["n4_rediscovery_artist"](spark, "/root/testdata/sf0.01").collect()}
    assert "return_beginning_new_era" in kinds


def test_merge_roots_with_a_cycle(spark):
    got = {r.node: r.root for r in reconcile.merge_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (6, 5)], "subject long, object long")).collect()}
    assert got == {1: 9, 2: 9, 3: 9, 5: 5, 6: 5}


def test_published_datasets_show_change(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    envelope.publish({"a": a, "b": a.limit(1)}, a, str(tmp_path / "out"))
    assert {r.status for r in envelope.verify(str(tmp_path / "out"), a).collect()} == {"valid"}
    assert {r.status for r in envelope.verify(str(tmp_path / "out"), a.limit(1)).collect()} == {"stale"}
    other = a.withColumn("k", F.col("k") + 1)
    assert {r.dataset: r.status for r in envelope.verify(str(tmp_path / "out"), a, {"a": other, "b": a.limit(1)}).collect()} == {"a": "invalid", "b": "valid"}
    a.limit(1).write.mode("append").parquet(str(tmp_path / "out/a"))
    assert {r.dataset: r.status for r in envelope.verify(str(tmp_path / "out"), a).collect()} == {"a": "invalid", "b": "valid"}


def test_page_faults(spark):
    kind = "scope string, page int, per_page int, total int, total_pages int, rows int, now_playing int"
    good = [("s", 1, 2, 3, 2, 2, 1), ("s", 2, 2, 3, 2, 1, 0)]
    assert coverage.page_faults(spark.createDataFrame(good, kind)).count() == 0
    assert coverage.page_faults(spark.createDataFrame([good[0], ("s", 2, 2, 3, 2, 2, 0)], kind)).count() == 1


def test_stream_repeats_are_dropped(spark, tmp_path):
    from sonograin.streaming.plays import without_repeats

    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, s), k) for s, k in ((0, "a"), (1, "a"), (2, "b"))], "ts timestamp, k string")
    rows.write.parquet(str(tmp_path / "in"))
    q = without_repeats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", ["k"]).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 2


def test_as_of_after_the_last_event_is_an_error(spark):
    e = plays(spark, [(1, ms("2020-01-01T12:00"))])
    assert returns.abandonments(e, as_of_ms=ms("2020-01-01T12:00")).count() == 0
    with pytest.raises(Exception, match="after the last event"):
        returns.abandonments(e, as_of_ms=ms("2020-01-01T12:01")).collect()


def test_landed_pages(spark):
    page = '{"recenttracks":{"@attr":{"page":"1","perPage":"200","total":"2","totalPages":"1"},"track":[{"name":"n","artist":{"#text":"a","mbid":""},"album":{"#text":"","mbid":""},"@attr":{"nowplaying":"true"}},{"name":"t","mbid":"m","loved":"1","artist":{"#text":"a","mbid":"am"},"album":{"#text":"x","mbid":""},"date":{"uts":"12"}},{"name":" ","artist":{"#text":"a"},"date":{"uts":"x"}}]}}'
    got = evidence.landed_tracks(spark.createDataFrame([("p", page), ("q", "{}")], "file string, value string")).orderBy("at").collect()
    assert [(r.now_playing, r.artist, r.track, r.album, r.instant_ms, r.recording_mbid, r.artist_mbid, r.loved, r.fault, r.total) for r in got] == [
        (True, "a", "n", None, None, None, None, None, False, 2), (False, "a", "t", "x", 12_000, "m", "am", True, False, 2), (False, "a", None, None, None, None, None, None, True, 2),
    ]
