"""Replayed identities against a plain walk through the records."""

import random

from sonograin.operators import identity, replay

COLUMNS = "record_id long, artist string, track string, album string, artist_mbid string, recording_id string, release_mbid string"


def key(text):
    t = "".join(c for c in text.lower() if c.isalnum() or c == " ").strip() if text is not None else ""
    return t or None


def only(found):
    return next(iter(found)) if len(found) == 1 else None


def walk(records, manual=()):
    mbids, recordings, releases, names, titles, albums, artist_of, release_of, out = {}, {}, {}, {}, {}, {}, {}, {}, {}
    for rid, artist, track, album, mbid, rec, rel in sorted(records):
        an, tn, bn = key(artist), key(track), key(album)
        usable, clashes = an is not None and tn is not None, set()
        strong = mbids.get(mbid) if mbid else None
        by_hand = only({e for a, e, since in manual if key(a) == an and since < rid}) if usable else None
        source = only(names.get(an, set())) if usable else None
        alias = by_hand if by_hand is not None else source
        kind = "trusted_identifier" if mbid else "manual_decision" if by_hand is not None else "known_alias" if source is not None else "new_unresolved"
        own = strong if strong is not None else alias if alias is not None else rid
        if strong is not None and alias is not None and strong != alias:
            clashes.add(("artist", strong, alias))
        if mbid:
            mbids.setdefault(mbid, own)
        if an:
            names.setdefault(an, set()).add(own)
        found = {t for t, by in artist_of.items() if by == own and tn in titles[t] and (bn in albums[release_of[t]] if release_of[t] is not None and bn else release_of[t] is None and bn is None)} if usable else set()
        composite, artist_id, t = only(found), own, recordings.get(rec) if rec else None
        if t is not None:
            kind = "trusted_identifier"
            if composite is not None and composite != t:
                clashes.add(("track", t, composite))
            if artist_of[t] != own:
                clashes.add(("artist", artist_of[t], own))
                artist_id = artist_of[t]
        elif composite is not None:
            t, kind = composite, "conservative_composite"
        else:
            t = rid
            r = releases.get(rel) if rel else None
            if r is None and album is not None:
                r = rid
                albums[r] = set()
            artist_of[t], release_of[t], titles[t] = own, r, set()
            if rec:
                kind = "trusted_identifier"
        release = release_of[t]
        if rec:
            recordings.setdefault(rec, t)
        if rel and release is not None:
            releases.setdefault(rel, release)
        if tn:
            titles[t].add(tn)
        if release is not None and bn:
            albums[release].add(bn)
        out[rid] = [artist_id, t, release, kind, clashes, rel]
    for row in out.values():
        rel, row[4] = row.pop(), row[4]
        if rel and row[2] is not None and releases[rel] != row[2]:
            row[4].add(("release", releases[rel], row[2]))
    return out


def replay_of(spark, records, manual=None):
    m = spark.createDataFrame(manual, "alias string, entity long, since long") if manual else None
    return {r.record_id: [r.artist_id, r.track_id, r.release_id, r.kind, {tuple(c) for c in r.conflicts}] for r in replay.replayed(spark.createDataFrame(records, COLUMNS), m).collect()}


def history(r, n, k):
    """n records in any order of their ids; histories of different k share no names."""
    own = lambda x: x and f"{x} of {k}" if x not in ("?!", "--", "!") else x
    pick = lambda many, p: own(r.choice(many)) if r.random() < p else None
    ids = r.sample(range(10_000 * k + 1, 10_000 * k + 10 * n), n)
    return [(i, own(r.choice(["One", "Two", "Three", "?!"])), own(r.choice(["Song", "Tune", "Air", "--"])), pick(["LP", "EP", "!"], 0.5), pick(["m1", "m2", "m3"], 0.3), pick(["r1", "r2", "r3", "r4", "r5"], 0.3), pick(["l1", "l2"], 0.2)) for i in ids]


def test_shuffled_histories_equal_the_walk(spark):
    r = random.Random(8)
    records = [x for k, n in enumerate((1, 3, 8, 8, 20, 20, 40, 40, 60, 60)) for x in history(r, n, k)]
    r.shuffle(records)
    assert replay_of(spark, records) == walk(records)


def test_manual_aliases_hold_after_their_time(spark):
    r = random.Random(9)
    records = history(r, 40, 0)
    first = min(records)[0]
    manual = [("one of 0", first, 150), ("TWO of 0", first, 0), ("Three of 0", first, 100), ("three of 0", first + 1, 300)]
    assert replay_of(spark, records, manual) == walk(records, manual)


def test_names_are_unique_by_what_came_before(spark):
    rows = [
        (1, "Name", "A", None, None, None, None), (2, "Name", "A", None, "m1", "x", None),  # the identifier joins the known name, and so does the recording
        (3, "Other", "B", None, "m2", None, None), (4, "Name", "A", None, "m2", None, None),  # a second bearer of the name
        (5, "Name", "A", None, None, None, None), (6, "Name", "A", None, None, None, None),  # from here on it tells nothing
        (7, "Elsewhere", "A", None, "m1", None, None),
    ]
    got = replay_of(spark, rows)
    assert got == walk(rows)
    assert [got[i][0] for i in range(1, 8)] == [1, 1, 3, 3, 5, 6, 1] and got[2][1] == 1 and got[2][3] == "conservative_composite"
    at_once = {r.record_id: r.artist_id for r in identity.resolved(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert at_once[5] == at_once[6]  # the other mode looks at the whole set


def test_late_title_and_album_names_open_keys(spark):
    rows = [
        (1, "N", "Title", "LP", None, "r1", "l1"), (2, "N", "Renamed", "Deluxe", None, "r1", None),  # the same track under other names
        (3, "N", "Renamed", "LP", None, None, None), (4, "N", "Title", "Deluxe", None, None, None), (5, "N", "New", "X", None, None, "l1"), (6, "N", "New", "Deluxe", None, "r2", None),
    ]
    got = replay_of(spark, rows)
    assert got == walk(rows) and [got[i][1] for i in range(1, 7)] == [1, 1, 1, 1, 5, 5] and got[6][2] == 1


def test_empty(spark):
    assert replay.replayed(spark.createDataFrame([], COLUMNS)).count() == 0
