"""Batches against a full run, and what a batch leaves alone."""

import random
import shutil

from pyspark.sql import functions as F

from sonograin.plans.reconciliation import reconciled
from sonograin.plans.snapshot import Snapshot
from sonograin.sources import history
from sonograin.streaming.incremental import Reconciler, components

PLAYS = "record_id long, listener long, stopped_at_ms long, ms_played long, artist string, track string, album string, track_uri string, skipped boolean"
SCROBBLES = "record_id long, listener long, instant_ms long, artist string, track string, album string, artist_mbid string, recording_mbid string"
KIND = "source string, record_id long, listener long, stopped_at_ms long, ms_played long, instant_ms long, artist string, track string, album string, track_uri string, skipped boolean, artist_mbid string, recording_mbid string"
T, MINUTE = 1_700_000_000_000, 60_000


def play(i, listener, at, artist, track="Song", album="LP", uri=None):
    return ("interval", i, listener, at + MINUTE, MINUTE, None, artist, track, album, uri, False, None, None)


def scrobble(i, listener, at, artist, track="Song", album="LP", mbid=None, rec=None):
    return ("instant", i, listener, None, None, at, artist, track, album, None, None, mbid, rec)


def reconciler(path, buckets=16):
    return Reconciler(str(path), PLAYS, SCROBBLES, history.SAME_PLAY, history.SAME_SCROBBLE, buckets)


def whole(spark, rows):
    e = spark.createDataFrame(rows, KIND)
    full = reconciled(e.where("source = 'interval'"), e.where("source = 'instant'"), history.SAME_PLAY, history.SAME_SCROBBLE)
    return sorted(map(str, full.events.collect())), sorted(map(str, full.links.collect()))


def kept(spark, r):
    links = r.links(spark).select("event_id", "record_id", "source", "role")
    return sorted(map(str, r.events(spark).collect())), sorted(map(str, links.collect()))


def test_batches_equal_a_full_run(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(60):
        at, listener, artist = T + r.randrange(40) * 20_000, r.randrange(3), r.choice(["Band", "Other", "The Group"])
        rows.append(play(2 * i, listener, at, artist, r.choice(["Song", "Air"]), r.choice(["LP", None]), r.choice([None, "u1", "u2"])))
        rows.append(scrobble(2 * i + 1, listener, at + r.randrange(20_000), r.choice([artist, "Band, The"]), "Song", None, r.choice([None, "m1"]), r.choice([None, None, "x"])))
    rows += [(*x[:1], 1000 + x[1], *x[2:]) for x in rows[::9]]  # exact duplicates
    r.shuffle(rows)
    one = reconciler(tmp_path)
    for number, end in enumerate((70, 100, len(rows))):
        batch = rows[(0, 70, 100)[number] : end]
        for _ in range(2 if number == 1 else 1):  # a batch that comes again replaces itself
            one.run(spark.createDataFrame(batch, KIND), number)
    assert kept(spark, one) == whole(spark, rows)
    one.run(spark.createDataFrame(rows[:5], KIND), 9)  # nothing new
    assert not (tmp_path / "commits" / "at=9").exists()


def test_other_partitions_are_neither_read_nor_written(spark, tmp_path):
    one = reconciler(tmp_path)
    rows = [play(10 * n + k, n, T + k * MINUTE, f"Band {n}") for n in range(6) for k in range(3)] + [scrobble(10 * n + 5, n, T, f"Band {n}") for n in range(6)]
    one.run(spark.createDataFrame(rows, KIND), 0)
    snap = Snapshot(spark, str(tmp_path), 1, 16)
    of = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in range(6)], "listener long").select("listener", snap.bucket(F.col("listener"))).collect()}
    name = {n: r.component for n in range(6) for r in snap.read("records", "listener long, component string").where(f"listener = {n}").limit(1).collect()}
    at = {n: r[0] for n, c in name.items() for r in spark.createDataFrame([(c,)], "c string").select(snap.bucket(F.col("c"))).collect()}
    for n in range(1, 6):  # were they opened, the run would fail
        for table, place in (("heard", of), ("events", of), ("links", of), ("records", at)):
            if place[n] != place[0]:
                shutil.rmtree(tmp_path / table / "version=0" / f"bucket={place[n]}", ignore_errors=True)
                (tmp_path / table / "version=0" / f"bucket={place[n]}").mkdir()
                (tmp_path / table / "version=0" / f"bucket={place[n]}" / "part-0.parquet").write_bytes(b"not read")
    one.run(spark.createDataFrame([scrobble(500, 0, T + MINUTE, "Band 0")], KIND), 1)
    wrote = spark.read.parquet(f"{tmp_path}/commits").where("version = 1").collect()
    assert {r.bucket for r in wrote if r.name in ("heard", "events", "links")} == {of[0]} and {r.bucket for r in wrote if r.name in ("records", "nodes")} == {at[0]}
    merged = Snapshot(spark, str(tmp_path), 2, 16).read("events", "event_id long, listener long, scrobble_id long", [of[0]]).where("listener = 0 and scrobble_id is not null")
    assert {(r.event_id, r.scrobble_id) for r in merged.collect()} == {(0, 5), (1, 500)}


def test_a_name_that_turns_ambiguous_reaches_other_listeners(spark, tmp_path):
    one = reconciler(tmp_path)
    first = [scrobble(1, 1, T, "Band", mbid="m1"), play(2, 2, T, "Band", album=None)]
    one.run(spark.createDataFrame(first, KIND), 0)
    later = [scrobble(3, 3, T, "Band", mbid="m2")]
    one.run(spark.createDataFrame(later, KIND), 1)
    assert kept(spark, one) == whole(spark, first + later)
    assert {r.event_id: r.artist_id for r in one.events(spark).collect()} == {1: 1, 2: 2, 3: 3}


def test_components(spark):
    edges = [("a", "b"), ("c", "b"), ("x", "x"), ("q", "r")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[n] for n in "abc"} == {"a"} and got["x"] == "x" and got["r"] == "q" and {got[f"n{i:03d}"] for i in range(41)} == {"n000"}
