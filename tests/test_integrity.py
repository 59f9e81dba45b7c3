from pyspark.sql import functions as F

from sonograin.operators import coverage, integrity, sync
from sonograin.plans import envelope
from sonograin.streaming import plays as streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_run_faults(spark):
    runs = spark.createDataFrame(
        [(1, "succeeded", 2, 1, 1, 0), (2, "succeeded", 5, 1, 0, 0), (3, "failed", 1, 1, 0, 0), (4, "running", 0, 0, 0, 0), (5, None, None, None, None, None)],
        "run_id int, status string, discovered long, accepted long, excluded long, rejected long",
    )
    records = spark.createDataFrame([(1, "accepted"), (1, "excluded"), (2, "accepted"), (2, "rejected"), (3, "accepted"), (9, "accepted")], "run_id int, kind string")
    assert rows(integrity.run_faults(runs, records)) == [(2, "rejected"), (2, "total"), (3, "failed_owns"), (4, "unfinished"), (5, "status"), (9, "unknown_run")]
    assert rows(integrity.run_faults(runs.limit(0), records.limit(0))) == []


def test_ownership_ignores_repeated_links(spark):
    records = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, None, 1)], "record_id int, file_id int, run_id int")
    links = spark.createDataFrame([(1, 1), (1, 1)], "file_id int, run_id int")
    assert rows(integrity.ownership_faults(records, links)) == [(2, "unlinked"), (3, "unowned")]


def test_link_faults(spark):
    records = spark.createDataFrame([(1,), (1,), (2,), (3,)], "record_id int")
    links = spark.createDataFrame([(10, 1), (10, 1), (10, 2), (11, 2), (12, 7)], "event_id int, record_id int")
    assert rows(integrity.link_faults(records, links)) == [(2, "shared"), (3, "unlinked"), (7, "dangling")]


def test_event_faults(spark):
    events = spark.createDataFrame(
        [(1, 5, 9, "derived_start", "cross_source_reconciled"), (2, 5, None, "derived_start", "single_source"), (3, 9, 5, "observed_start", "single_source"), (4, None, 5, "observed_end", "cross_source_reconciled"), (5, 1, 2, "guess", "single_source")],
        "event_id int, started_ms long, ended_ms long, time_basis string, status string",
    )
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (4, "a")], "event_id int, source string")
    assert rows(integrity.event_faults(events, links)) == [(2, "basis"), (3, "order"), (3, "status"), (4, "status"), (5, "basis"), (5, "no_evidence")]


def test_supersession_faults(spark):
    e = [(1, "active", None), (2, "superseded", 1), (3, "superseded", None), (4, "active", 1), (5, "superseded", 5), (6, "superseded", 99), (7, "superseded", 2)]
    found = integrity.supersession_faults(spark.createDataFrame(e, "event_id int, state string, superseded_by int"))
    assert rows(found) == [(3, "no_successor"), (4, "active_successor"), (5, "self"), (6, "missing"), (7, "superseded_successor")]


def test_graph_and_versions(spark):
    r = spark.createDataFrame([(1, 10, None), (1, 10, 20), (2, 10, 20), (2, 11, None)], "artist_id int, track_id int, release_id int")
    assert rows(integrity.graph_faults(r)) == [("release", 20, 2), ("track", 10, 2)]
    v = spark.createDataFrame([("v1",), ("  ",), (None,)], "version string")
    assert rows(integrity.blank_versions(a=v, b=v.limit(0))) == [("a", 2, 3), ("b", 0, 0)]


def test_missing_fingerprints_differ(spark):
    t = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None)], "x string, fingerprint string")
    assert integrity.stored_fingerprint_faults(t, F.col("x")).count() == 2


def test_pages_of_a_null_scope_and_repeats(spark):
    kind = "scope string, page long, per_page long, total long, total_pages long, rows long, now_playing long"
    assert coverage.page_faults(spark.createDataFrame([(None, 1, 2, 3, 2, 2, 0), (None, 2, 2, 3, 2, 1, 1)], kind)).count() == 0
    assert coverage.page_faults(spark.createDataFrame([(None, 1, 2, 2, 1, 2, 0)] * 2, kind)).count() == 2
    assert coverage.page_faults(spark.createDataFrame([], kind)).count() == 0


def test_append_summary_keeps_scopes_without_outcomes(spark):
    fetched = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "scope string")
    outcomes = spark.createDataFrame([("a", "existing"), ("a", "inserted")], "scope string, outcome string")
    assert rows(sync.append_summary(outcomes, fetched)) == [("a", 3, 1, 1, 0, 1), ("b", 1, 1, 0, 0, 0)]


def test_envelope_faults(spark):
    kind = "analysis string, event_count long, coverage_total long, available long, unresolved long, unresolved_rate double, start_ms long, end_ms long, as_of_ms long"
    e = [("fine", 4, 4, 2, 1, 0.25, 1, 9, 9), ("empty", 0, 0, 0, 0, 0.0, None, None, 5), ("bad", 4, 3, 5, 1, 0.3, 9, 1, 0), ("range", 0, 0, 0, 0, 0.0, 1, 2, 2), ("null", 1, None, 0, 0, None, 1, 2, 2)]
    want = [("bad", x) for x in ("as_of", "available", "coverage", "order", "rate")] + [("null", "coverage"), ("null", "rate"), ("range", "range")]
    assert rows(envelope.envelope_faults(spark.createDataFrame(e, kind))) == want


def test_active_periods_keep_an_event_exactly_one_gap_later(spark):
    t = spark.createDataFrame([("a", 0), ("a", 86_400_000), ("a", 2 * 86_400_000 + 1), ("b", 5)], "who string, ms long").withColumn("at", F.timestamp_millis("ms"))
    assert rows(streams.active_periods(t, "at", "who", "1 day").select("who", F.unix_millis("start"), "play_count")) == [("a", 0, 2), ("a", 2 * 86_400_000 + 1, 1), ("b", 5, 1)]


def test_a_stream_of_files_gives_the_batch_counts(spark, tmp_path):
    rows_ = [(i, i * 43_200_000) for i in range(8)]
    batch = spark.createDataFrame(rows_, "id long, ms long")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_millis("ms"))
    q = streams.daily_volume(stream, "at").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("daily").select("play_count")) == [(2,)] * 4
