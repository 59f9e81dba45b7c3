import random

import pytest

from sonograin import catalog
from sonograin.operators import reconcile
from sonograin.plans import reconciliation
from sonograin.sources import history

SF = "/root/testdata/sf0.001"


def test_decisions_use_the_ordering_score(spark):
    ordering = {(r.play_id, r.scrobble_id): r for r in catalog.QUERIES["r6_ordering_scores"](spark, SF).collect()}
    got = catalog.QUERIES["r7_scored_pairs"](spark, SF).collect()
    assert len(got) == len(ordering) > 0 and any(r.ordering_score is not None for r in ordering.values())
    for r in got:
        assert (r.confidence, r.decision) == (ordering[r.play_id, r.scrobble_id].confidence, ordering[r.play_id, r.scrobble_id].decision)


PLAY = "record_id long, listener long, stopped_at_ms long, ms_played long, artist string, track string, album string, track_uri string, skipped boolean"
SCROBBLE = "record_id long, listener long, instant_ms long, artist string, track string, album string, artist_mbid string, recording_mbid string"


def chain(spark, plays, scrobbles):
    p, s = spark.createDataFrame(plays, PLAY), spark.createDataFrame(scrobbles, SCROBBLE)
    return reconciliation.reconciled(p, s, history.SAME_PLAY, history.SAME_SCROBBLE)


def test_exact_duplicates_make_no_pairs_and_plays_with_copies_merge(spark):
    minute = 60_000
    plays = [(2 * i, 1, i * 10 * minute + minute, minute, "A", "t", "x", "u", False) for i in range(1, 6)]
    plays += [(1_000_000 + i, *plays[0][1:]) for i in range(3)]
    scrobbles = [(2 * i + 1, 1, i * 10 * minute, "A", "t", "x", None, None) for i in range(1, 6)]
    scrobbles.append((2001, *scrobbles[1][1:]))
    c = chain(spark, plays, scrobbles)
    assert {(r.play_id, r.scrobble_id) for r in c.pairs.collect()} == {(2 * i, 2 * i + 1) for i in range(1, 6)}
    assert {r.event_id: r.scrobble_id for r in c.events.where("scrobble_id is not null").collect()} == {2 * i: 2 * i + 1 for i in range(1, 6)} and c.events.count() == 5
    assert {(r.event_id, r.record_id) for r in c.links.where("role = 'exact_duplicate'").collect()} == {(2, 1_000_000), (2, 1_000_001), (2, 1_000_002), (4, 2001)}
    base = {r.event_id: r for r in reconcile.canonical_base(c.events, c.links).collect()}
    assert len(base) == 5 and base[2].source_record_count == 5 and base[6].source_record_count == 2


def test_features_tell_names_albums_identifiers_and_listeners_apart(spark):
    t, minute = 1_700_000_000_000, 60_000
    at = lambda k: t + k * 100 * minute
    play = lambda i, k, artist, track, album, uri, who=1: (i, who, at(k) + minute, minute, artist, track, album, uri, False)
    plays = [play(0, 0, "Band", "Song", "LP", "u1"), play(2, 1, "Band", "Song", None, "u1"), play(4, 2, "Band", "Other", "LP", "u2"), play(6, 3, "Band", "Song", "LP", "u1", 2)]
    scrobbles = [
        (1, 1, at(0), "BAND!", "song", "Live", "m1", None), (3, 1, at(1), "The Band", "Song", "LP", "m1", None), (5, 1, at(2), "Band", "Other", "LP", "m1", "rec2"),
        (7, 1, at(3), "Band", "Song", "LP", "m1", None),  # the play then is another listener's
    ]
    got = {(r.play_id, r.scrobble_id): r for r in chain(spark, plays, scrobbles).scores.collect()}
    assert set(got) == {(0, 1), (2, 3), (4, 5)}
    assert (got[0, 1].artist_score, got[0, 1].track_score, got[0, 1].album_score, got[0, 1].identifier_score) == (1.0, 1.0, 0.0, None)
    assert (got[2, 3].artist_score, got[2, 3].track_score, got[2, 3].album_score) == (0.75, 1.0, None)
    assert (got[4, 5].identifier_score, got[4, 5].decision, got[4, 5].ordering_score) == (0.0, "review", 1.0)


def test_window_bounds(spark):
    with pytest.raises(ValueError):
        reconciliation.candidates(spark.createDataFrame([], PLAY), spark.createDataFrame([], SCROBBLE), history.SAME_PLAY, history.SAME_SCROBBLE, 120_001)


def test_the_nearest_independent_pair_has_no_limit(spark):
    r, kind = random.Random(8), "listener long, play_id long, scrobble_id long, start_ms long, instant_ms long"
    rows, hour = {}, 3_600_000
    starts = [r.choice([r.randrange(6) * 1000, r.randrange(40) * hour, r.randrange(4) * 5000 * hour + r.randrange(3) * 1000]) for _ in range(70)]
    for a, start in enumerate(starts):
        for b in {r.randrange(60) // r.choice([1, 8]) for _ in range(r.choice([1, 1, 2, 3]))}:
            rows[a, 1000 + b] = (start, 7 * b)
    # one scrobble for plays next to each other, and one pair far from all
    rows |= {(200 + i, 2000): (90_000 * hour + i, 5) for i in range(6)} | {(300, 3000): (200_000 * hour, 9)}
    pairs = [(1, a, b, *t) for (a, b), t in rows.items()] + [(2, 10_000 + a, 20_000 + b, *t) for (a, b), t in rows.items() if a % 3]
    rows = list(dict.fromkeys((i // 6 * 1000, i % 3, 100 + r.randrange(9)) for i in range(60)))  # many pairs at equal distances
    pairs += [(3, 50_000 + 10 * (t // 1000) + a, 60_000 + b, t, b) for t, a, b in rows]
    want = {}
    for listener in (1, 2, 3):
        mine = sorted((a, b, s, i) for v, a, b, s, i in pairs if v == listener)
        row = sorted(range(len(mine)), key=lambda x: (mine[x][2], x))
        for at, index in enumerate(row):
            a, b, s, _ = mine[index]
            left, right, found, least = at - 1, at + 1, None, float("inf")
            while left >= 0 or right < len(row):
                heads = [(abs(mine[row[k]][2] - s), row[k], step) for k, step in ((left, -1), (right, 1)) if 0 <= k < len(row)]
                dist, k, step = min(heads)
                if dist > least:
                    break
                left, right = (left - 1, right) if step < 0 else (left, right + 1)
                if mine[k][0] != a and mine[k][1] != b:
                    found, least = mine[k][2:], dist
            want[a, b] = found
    df = spark.createDataFrame(pairs, kind)
    for blocks in (1024, 7):
        got = {(x.play_id, x.scrobble_id): (x.near_start, x.near_instant) for x in reconcile.nearest_independent(df, blocks).collect()}
        assert got == want
    assert reconcile.nearest_independent(spark.createDataFrame(pairs[:1], kind)).count() == 0 == reconcile.nearest_independent(df.limit(0)).count()


def test_refreshed_features_leave_decided_rows(spark):
    old = spark.createDataFrame([(1, 2, "v1", "pending", 0.1), (3, 4, "v1", "accepted", 0.2), (1, 2, "v0", "pending", 0.3), (7, 8, "v1", "pending", 0.4)], "play_id long, scrobble_id long, version string, state string, confidence double")
    new = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.8), (5, 6, 0.7)], "play_id long, scrobble_id long, confidence double")
    got = sorted(tuple(r) for r in reconcile.refreshed_features(old, new, "v1").collect())
    assert got == [(1, 2, "v0", "pending", 0.3), (1, 2, "v1", "pending", 0.9), (3, 4, "v1", "accepted", 0.2), (5, 6, "v1", "pending", 0.7), (7, 8, "v1", "pending", 0.4)]
