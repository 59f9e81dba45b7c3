from pyspark.sql import functions as F

from sonograin.operators import decisions, identity

RECORDS = "record_id long, artist string, track string, album string, artist_mbid string, recording_id string, release_mbid string"


def solve(spark, rows, manual=None):
    found = identity.resolved(spark.createDataFrame(rows, RECORDS), manual and spark.createDataFrame(manual, "alias string, entity long"))
    return {r.record_id: r for r in found.collect()}


def test_strong_identifiers_names_and_albums(spark):
    got = solve(spark, [
        (1, "Blur", "Song 2", "Blur", "m1", "r1", None),
        (2, "BLUR!", "song 2", "blur", None, None, None),  # the only bearer of the name, the only track of that name there
        (3, "Blur", "Song 2", None, None, None, None),  # no album: another track, without a release
        (4, "Other name", "Song 2", None, "m1", "r1", None),
        (5, "New", "T", None, None, None, None),
        (6, "new", "t", None, None, None, None),
        (7, "...", "T", None, None, None, None),  # no match text
        (8, "...", "T", None, None, None, None),
    ])
    assert [(got[i].artist_id, got[i].track_id, got[i].release_id) for i in range(1, 9)] == [(1, 1, 1), (1, 1, 1), (1, 3, None), (1, 1, 1), (5, 5, None), (5, 5, None), (7, 7, None), (8, 8, None)]
    assert [got[i].kind for i in (1, 2, 3, 5, 6, 7)] == ["trusted_identifier", "conservative_composite", "known_alias", "new_unresolved", "conservative_composite", "new_unresolved"]


def test_a_shared_name_matches_nobody_and_conflicts_are_kept(spark):
    got = solve(spark, [(1, "Twin", "A", None, "m1", None, None), (2, "Twin", "B", None, "m2", "r1", None), (3, "twin", "C", None, None, None, None), (4, "Twin", "B", None, "m1", "r1", None)])
    assert got[3].artist_id == 3 and got[3].kind == "new_unresolved"
    assert got[4].artist_id == 2 and [tuple(c) for c in got[4].conflicts] == [("artist", 2, 1)]  # the track's artist wins
    manual = solve(spark, [(1, "Twin", "A", None, "m1", None, None), (3, "twin", "C", None, None, None, None)], [("TWIN", 77)])
    assert manual[3].artist_id == 77 and manual[3].kind == "manual_decision" and [tuple(c) for c in manual[1].conflicts] == [("artist", 1, 77)]
    assert solve(spark, [(1, None, None, None, None, None, None)])[1].track_id == 1
    assert identity.resolved(spark.createDataFrame([], RECORDS)).count() == 0


def test_merges_are_followed_and_split_again_unless_an_event_is_shared(spark):
    rows = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (12, 1), (13, 4)], "event long, artist long")
    merged = identity.merged(rows, "artist", spark.createDataFrame([(1, 2), (1, 3)], "subject long, object long"))
    assert {(r.event, r.artist, r.before_merge) for r in merged.collect()} == {(10, 1, None), (11, 1, 2), (12, 1, 3), (12, 1, None), (13, 4, None)}
    after, refused = identity.split(merged, "artist", spark.createDataFrame([(1, 2), (1, 3)], "subject long, object long"), "event")
    assert {(r.event, r.artist, r.before_merge) for r in after.collect()} == {(10, 1, None), (11, 2, None), (12, 1, 3), (12, 1, None), (13, 4, None)}
    assert [(r.subject, r.object) for r in refused.collect()] == [(1, 3)]


def test_decisions(spark):
    sha = "a" * 64
    rows = [("ok", "accept", "why", sha, 0, None), ("No", "accept", "why", sha, 0, None), ("t", None, "why", sha, 0, None), ("al", "alias", "why", sha, 0, ""), ("ref", "reject", "why", "x", 0, None), ("two", "merge", "why", sha, 1, None), ("two", "split", "why", sha, 1, None)]
    got = decisions.faults(spark.createDataFrame(rows, "decision_id string, type string, reason_code string, file_sha256 string, ordinal long, alias string"))
    assert {tuple(r) for r in got.collect()} == {("No", "decision_id"), ("t", "type"), ("al", "alias"), ("ref", "reference"), ("two", "repeated_id")}
    plan = decisions.import_plan(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "decision_id string, payload string"), spark.createDataFrame([("b", "2"), ("c", "4")], "decision_id string, payload string"))
    assert {(r.decision_id, r.outcome) for r in plan.collect()} == {("a", "imported"), ("b", "already_applied"), ("c", "conflict")}
    auto = spark.createDataFrame([(1, 1, "accept"), (2, 2, "ignore")], "play_id long, scrobble_id long, decision string")
    manual = spark.createDataFrame([(1, 1, "reject")], "play_id long, scrobble_id long, decision string")
    assert {(r.play_id, r.decision, r.origin) for r in decisions.with_manual(auto, manual).collect()} == {(1, "reject", "manual"), (2, "ignore", "automatic")}
    prior = auto.select("*", F.lit("v1").alias("version"), F.lit("active").alias("state"), F.lit(None).cast("string").alias("superseded_by"))
    history = decisions.superseded(prior, manual, "v2")
    assert {(r.play_id, r.version, r.state, r.superseded_by) for r in history.collect()} == {(1, "v1", "superseded", "v2"), (1, "v2", "active", None), (2, "v1", "active", None)}
    assert decisions.lineage_faults(history).count() == 0 and decisions.lineage_faults(history.where("version = 'v1'")).count() == 1
