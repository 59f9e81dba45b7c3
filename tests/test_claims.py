"""Claims of manual and policy decisions against a walk in their order."""

import random

from sonograin.operators import decisions
from sonograin.plans.reconciliation import candidates, decided_events
from sonograin.sources import history

PAIR = "play_id long, scrobble_id long, decision string"


def walk(automatic, manual, one_to_one):
    by_hand = {(p, s): (o, d) for p, s, d, o in manual}
    known = {(p, s) for p, s, _ in automatic}
    rows = [(0, o, p, s, d, "manual") for (p, s), (o, d) in by_hand.items() if (p, s) in known] + [(1, 0, p, s, d, "automatic") for p, s, d in automatic if (p, s) not in by_hand]
    plays, scrobbles, out = set(), set(), set()
    for _, _, p, s, d, origin in sorted(rows):
        stale = d == "accept" and (s in scrobbles or (one_to_one and p in plays))
        if d == "accept" and not stale:
            plays.add(p)
            scrobbles.add(s)
        out.add((p, s, "review" if stale else d, origin, stale))
    return out


def test_claims_hold_in_their_order(spark):
    r = random.Random(3)
    for n, ids in ((0, 1), (12, 3), (60, 9), (150, 40)):
        pairs = sorted({(r.randrange(ids), 100 + r.randrange(ids)) for _ in range(n)})
        automatic = [(p, s, r.choice(["accept", "accept", "review", "ignore"])) for p, s in pairs]
        manual = [(p, s, r.choice(["accept", "reject"]), o) for o, (p, s) in enumerate(r.sample(pairs, len(pairs) // 3))] + [(777, 888, "accept", 99)]
        r.shuffle(manual)
        for one_to_one in (False, True):
            a, m = spark.createDataFrame(automatic, PAIR), spark.createDataFrame(manual, PAIR + ", ordinal int")
            assert {tuple(x) for x in decisions.arbitrated(a, m, one_to_one).collect()} == walk(automatic, manual, one_to_one)
            assert [x.play_id for x in decisions.stale_references(m, a).collect()] == [777]
    chain = [(i // 2, 100 + (i + 1) // 2, "accept") for i in range(41)]  # each claim waits for the one before
    got = decisions.arbitrated(spark.createDataFrame(chain, PAIR), None, True)
    assert {tuple(x) for x in got.collect()} == walk(chain, [], True)


def test_manual_decisions_change_events(spark):
    t, minute = 1_700_000_000_000, 60_000
    plays = [(2 * i, 1, t + 10 * i * minute + minute, minute, "Band", "Song", "LP", None, False) for i in range(3)] + [(6, 1, t + minute + 9000, minute, "Band", "Song", "LP", None, False)]
    scrobbles = [(2 * i + 1, 1, t + 10 * i * minute, "Band", "Song", "LP", None, None) for i in range(3)] + [(7, 1, t + 5000, "Band", "Song", None, None, None)]
    p = spark.createDataFrame(plays, "record_id long, listener long, stopped_at_ms long, ms_played long, artist string, track string, album string, track_uri string, skipped boolean")
    s = spark.createDataFrame(scrobbles, "record_id long, listener long, instant_ms long, artist string, track string, album string, artist_mbid string, recording_mbid string")
    _, p, s, pairs = candidates(p, s, history.SAME_PLAY, history.SAME_SCROBBLE)
    none = spark.createDataFrame([], "source string, record_id long, keeper long")
    run = lambda manual: decided_events(p, s, pairs, none, manual)[1:]
    _, events, _ = run(None)
    assert {r.event_id: r.scrobble_id for r in events.collect()} == {0: None, 2: 3, 4: 5, 6: None, 1: None, 7: None}  # the crowded start waits for review
    manual = spark.createDataFrame([(2, 3, "reject", 0), (6, 1, "accept", 5), (0, 1, "accept", 4), (0, 7, "accept", 6)], PAIR + ", ordinal int")
    decided, events, links = run(manual)
    assert {(r.play_id, r.scrobble_id): (r.decision, r.stale) for r in decided.where("origin = 'manual'").collect()} == {(2, 3): ("reject", False), (6, 1): ("review", True), (0, 1): ("accept", False), (0, 7): ("accept", False)}
    assert {r.event_id: r.scrobble_id for r in events.collect()} == {0: 1, 2: None, 3: None, 4: 5, 6: None}
    assert {(r.event_id, r.record_id) for r in links.where("role = 'cross_source_match'").collect()} == {(0, 1), (0, 7), (4, 5)}
