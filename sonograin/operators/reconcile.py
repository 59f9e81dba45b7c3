"""Events out of evidence, and the pairing of plays with scrobbles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

# Match weights, decision thresholds and the base window.
WEIGHTS = {"identifier": 0.25, "artist": 0.15, "track": 0.20, "album": 0.10, "time": 0.15, "duration": 0.05, "ordering": 0.05, "competing": 0.05, "short": 0.05}
ACCEPT, REVIEW, WINDOW_MS = 0.95, 0.70, 30_000


def keepers(records: DataFrame, *same: str, order: str = "record_id") -> DataFrame:
    """records with keeper (the first record of its exact duplicates; nulls are equal) and is_keeper."""
    # a minimum is added up before the shuffle and joined back, so that a large group of duplicates is never sorted in one task
    firsts = records.groupBy(*same).agg(F.min(order).alias("keeper")).select(*(F.col(c).alias(f"_same{i}") for i, c in enumerate(same)), "keeper")
    equal = [records[c].eqNullSafe(firsts[f"_same{i}"]) for i, c in enumerate(same)]
    return records.join(firsts, equal).drop(*(f"_same{i}" for i in range(len(same)))).withColumn("is_keeper", F.col(order) == F.col("keeper"))


def name_keys(records: DataFrame) -> DataFrame:
    """track_id, key: what a track may be met by: every name of its artist with every title of its own, and the track itself.

    records: artist_id, track_id, artist_key, track_key.  The names are those of all records of the entities, so there are a
    few keys a track; they are made once a track, not once a play.
    """
    tracks = records.select("track_id", "artist_id").distinct()
    names = records.where("artist_key is not null").select("artist_id", "artist_key").distinct()
    titles = records.where("track_key is not null").select("track_id", "track_key").distinct()
    met = tracks.join(names, "artist_id").join(titles, "track_id").select("track_id", F.to_json(F.struct("artist_key", "track_key")).alias("key"))
    return met.unionByName(tracks.select("track_id", F.col("track_id").cast("string").alias("key"))).distinct()


def candidate_pairs(plays: DataFrame, scrobbles: DataFrame, keys: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Pairs of a listener's plays and scrobbles of one track, or of tracks that share a title and a name of their artists, whose starts are at most window_ms (0 to 120,000) apart.

    plays: record_id, listener, stopped_at_ms, ms_played, skipped, artist_key, track_key, album_key, artist_id, track_id;
    scrobbles: record_id, listener, instant_ms, recording_mbid and the same keys and ids; both without exact duplicates.
    Time is cut into blocks as long as the window; a play is dealt to its own block and both neighbours, so the interval
    condition becomes an equi-join on listener, name and block, and the exact distance is a filter on few rows.
    """
    if not 0 <= window_ms <= 120_000:
        raise ValueError("window_ms must be from 0 to 120,000")
    block, names = max(1, window_ms), ["artist_key", "track_key", "album_key", "has_album", "artist_id", "track_id"]
    side = lambda r, *own: r.select("listener", F.col("track_id").alias("_track"), *own, *names)
    start = F.col("stopped_at_ms") - F.col("ms_played")
    p = side(plays, F.col("record_id").alias("play_id"), "ms_played", "skipped", start.alias("start_ms"))
    p = p.withColumn("block", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("start_ms") / block) + d)))
    s = side(scrobbles, F.col("record_id").alias("scrobble_id"), "instant_ms", "recording_mbid").withColumn("block", F.floor(F.col("instant_ms") / block))
    k = keys.withColumnRenamed("track_id", "_track")
    p, s = p.join(k, "_track").drop("_track"), s.join(k, "_track").drop("_track").withColumnsRenamed({n: f"scrobble_{n}" for n in names})
    met = p.join(s, ["listener", "key", "block"]).where(F.abs(F.col("instant_ms") - F.col("start_ms")) <= window_ms)
    reason = F.when(F.col("track_id") == F.col("scrobble_track_id"), "shared_track_identity").otherwise("matching_normalized_artist_track")
    return met.dropDuplicates(["play_id", "scrobble_id"]).drop("block", "key").withColumn("reason", reason)


def _sides(rows: DataFrame, *by: str) -> DataFrame:
    """rows (start_ms, only) with l1, l2, r1, r2 within ``by``: structs of the next row on each side, and of the next one beyond it whose ``only`` differs from its own.

    A null ``only`` differs from all, so nothing beyond it is ever needed.
    """
    out = rows
    for name, order in (("l", F.col("start_ms")), ("r", F.col("start_ms").desc())):
        w = Window.partitionBy(*by).orderBy(order)
        out = out.withColumn("_row", F.struct("start_ms", "only")).withColumn(f"{name}1", F.lag("_row").over(w))
        turn = F.col(f"{name}1").isNotNull() & (F.col("only").isNull() | F.col(f"{name}1.only").isNull() | (F.col("only") != F.col(f"{name}1.only")))
        out = out.withColumn("_before", F.last(F.when(turn, F.col(f"{name}1")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        out = out.withColumn(f"{name}2", F.lag("_before").over(w)).drop("_row", "_before")
    return out


def nearest_independent(pairs: DataFrame, blocks: int = 1024) -> DataFrame:
    """play_id, scrobble_id, near_start, near_instant of the listener's nearest pair by start that shares neither side.

    Among equally near ones the last wins that a walk from the pair outwards meets: pairs stand in the order of start, then ids;
    at one distance the earlier start is walked backwards and the later one forwards, the lower head first.  So the later start's last
    pair wins if it comes after all pairs of the earlier start by ids, else the earlier start's first one; at the pair's own start the
    last one after it, else the first.

    A play with one scrobble is of no use to the other pairs of that scrobble; any other play is of use to all pairs but its
    own.  So each play has a key, its only scrobble or else itself, and a pair (a, b) looks for the nearest play with a key
    other than b and that of a.  Of the plays of one start the first and the last three with different keys are enough.  On either side of a start
    the next one is enough, or, where that has the key b alone, the next one with another key.  Starts are looked at in
    blocks of time; each block gets the two such starts of the nearest blocks before and after it that have any, however
    far off.  Ties are fetched by an equi-join on the start.
    """
    p = stored(pairs.select("listener", "play_id", "scrobble_id", "start_ms", "instant_ms").withColumn("n", F.count("*").over(Window.partitionBy("play_id"))))
    key = F.struct((F.col("n") > 1).alias("many"), F.when(F.col("n") > 1, F.col("play_id")).otherwise(F.col("scrobble_id")).alias("id"))
    p = p.withColumn("key", key)
    mate = F.struct("scrobble_id", "instant_ms")
    plays = p.groupBy("listener", "start_ms", "key", "play_id").agg(F.min(mate).alias("s1"), F.max(mate).alias("t1"))
    # the second scrobble of a play from either end, for pairs that have its first
    ends_of = plays.select("play_id", F.col("s1.scrobble_id").alias("_s"), F.col("t1.scrobble_id").alias("_t"))
    other = p.join(ends_of, "play_id").groupBy("play_id").agg(F.min(F.when(F.col("scrobble_id") != F.col("_s"), mate)).alias("s2"), F.max(F.when(F.col("scrobble_id") != F.col("_t"), mate)).alias("t2"))
    each = F.struct("play_id", "key", "s1", "s2", "t1", "t2")
    groups = plays.join(other, "play_id", "left").groupBy("listener", "start_ms", "key").agg(F.min_by(each, "play_id").alias("lo"), F.max_by(each, "play_id").alias("hi"))
    place = lambda c: F.row_number().over(Window.partitionBy("listener", "start_ms").orderBy(c))
    groups = groups.withColumn("up", place(F.col("lo.play_id"))).withColumn("down", place(F.desc("hi.play_id"))).where("up <= 3 or down <= 3")
    listed = lambda c, nth: F.array_sort(F.collect_list(F.when(F.col(nth) <= 3, F.col(c))))
    firsts = stored(groups.groupBy("listener", "start_ms").agg(listed("lo", "up").alias("best"), F.reverse(listed("hi", "down")).alias("last")))

    ends = firsts.groupBy("listener").agg(F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    at = F.floor((F.col("start_ms") - F.col("lo")).cast("double") * blocks / (F.col("hi") - F.col("lo") + 1))
    starts = firsts.join(ends, "listener").select("listener", "start_ms", F.when((F.size("best") == 1) & ~F.col("best")[0]["key"]["many"], F.col("best")[0]["key"]["id"]).alias("only"), at.alias("block"))
    row = F.struct("start_ms", "only")
    edges = starts.groupBy("listener", "block").agg(F.min(row).alias("f"), F.max(row).alias("l"))
    unlike = lambda e: F.col(f"{e}.only").isNull() | F.col("only").isNull() | (F.col("only") != F.col(f"{e}.only"))
    inner = starts.join(edges, ["listener", "block"]).groupBy("listener", "block", "f", "l").agg(F.min(F.when(unlike("f"), row)).alias("f2"), F.max(F.when(unlike("l"), row)).alias("l2"))
    few = inner.select("listener", "block", F.explode(F.array_distinct(F.array("f", "f2", "l", "l2"))).alias("e")).where("e is not null").select("listener", "block", "e.*")
    few = _sides(few, "listener")  # four rows a block at most
    halo = few.groupBy("listener", "block").agg(F.min_by(F.array("l1", "l2"), "start_ms").alias("before"), F.max_by(F.array("r1", "r2"), "start_ms").alias("after"))
    halo = halo.select("listener", "block", F.explode(F.concat("before", "after")).alias("e")).where("e is not null").distinct().select("e.*", "listener", "block", F.lit(False).alias("own"))
    sides = _sides(starts.withColumn("own", F.lit(True)).unionByName(halo), "listener", "block").where("own").drop("own", "block", "only")

    q = p.select("listener", "play_id", "scrobble_id", "start_ms", "key").join(firsts, ["listener", "start_ms"]).join(sides, ["listener", "start_ms"])
    b = F.struct(F.lit(False).alias("many"), F.col("scrobble_id").alias("id"))
    here = F.exists("best", lambda x: (x["key"] != b) & (x["key"] != F.col("key")))
    side = lambda e: F.when(F.col(f"{e}1").isNull() | F.col(f"{e}1.only").isNull() | (F.col(f"{e}1.only") != F.col("scrobble_id")), F.col(f"{e}1.start_ms")).otherwise(F.col(f"{e}2.start_ms"))
    q = q.select("listener", "play_id", "scrobble_id", "key", "start_ms", here.alias("here"), side("l").alias("left"), side("r").alias("right"))
    d = F.least(F.col("start_ms") - F.col("left"), F.col("right") - F.col("start_ms"))  # least passes over nulls
    target = lambda side, at: F.struct(F.lit(side).alias("side"), at.alias("near_start"))
    near = lambda side, at: F.when(F.abs(F.col(at) - F.col("start_ms")) == d, target(side, F.col(at)))
    targets = F.when(F.col("here"), F.array(target("here", F.col("start_ms")))).otherwise(F.array_compact(F.array(near("left", "left"), near("right", "right"))))
    q = q.select("listener", "play_id", "scrobble_id", "key", F.inline(targets))
    met = q.join(firsts.withColumnRenamed("start_ms", "near_start"), ["listener", "near_start"])
    free = lambda c: F.filter(c, lambda x: (x["key"] != b) & (x["key"] != F.col("key")))[0]
    pair = lambda x, one, two: F.struct(x["play_id"].alias("play_id"), F.when(x[one]["scrobble_id"] == F.col("scrobble_id"), x[two]).otherwise(x[one]).alias("mate"), F.col("near_start"))
    met = met.withColumn("x", free("best")).withColumn("y", free("last")).where("x is not null")
    top = F.struct(F.col("last")[0]["play_id"].alias("play_id"), F.col("last")[0]["t1"]["scrobble_id"].alias("scrobble_id"))
    met = met.select("play_id", "scrobble_id", "side", pair(F.col("x"), "s1", "s2").alias("first"), pair(F.col("y"), "t1", "t2").alias("final"), top.alias("top"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    one = met.groupBy("play_id", "scrobble_id").agg(of("here", "first").alias("h1"), of("here", "final").alias("h2"), of("left", "first").alias("l"), of("left", "top").alias("top"), of("right", "final").alias("r"))
    ids = lambda c: F.struct(F.col(f"{c}.play_id").alias("play_id"), F.col(f"{c}.mate.scrobble_id").alias("scrobble_id"))
    own = F.struct("play_id", "scrobble_id")
    chosen = F.when(F.col("h1").isNotNull(), F.when(ids("h2") > own, F.col("h2")).otherwise(F.col("h1"))).when(F.col("l").isNull() | (ids("r") > F.col("top")), F.col("r")).otherwise(F.col("l"))
    return one.withColumn("b", chosen).select("play_id", "scrobble_id", "b.near_start", F.col("b.mate.instant_ms").alias("near_instant"))


def scored(pairs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """The features of each pair of ``candidate_pairs``, its confidence (a weighted mean of the known ones) and the policy's decision.

    identifier: whether both are one track, where the scrobble has a recording id; artist and track: 1 for equal names, 0.75
    for other names of one entity; album: equal or not, where both have one; ordering: whether the nearest independent pair
    lies on the same side by both clocks.
    """
    delta = F.col("instant_ms") - F.col("start_ms")
    w = pairs.withColumn("play_degree", F.count("*").over(Window.partitionBy("play_id"))).withColumn("scrobble_degree", F.count("*").over(Window.partitionBy("scrobble_id")))
    if near is None:
        w = w.withColumn("near_start", F.lit(None).cast("long")).withColumn("near_instant", F.lit(None).cast("long"))
    else:
        w = w.join(near, ["play_id", "scrobble_id"], "left")
    before, earlier = F.col("near_start") - F.col("start_ms"), F.col("near_instant") - F.col("instant_ms")
    ordering = F.when((before != 0) & (earlier != 0), ((before > 0) == (earlier > 0)).cast("double"))
    same = lambda n: F.col(f"{n}_key").eqNullSafe(F.col(f"scrobble_{n}_key"))
    text = lambda n: F.when(same(n), 1.0).when(F.col(f"{n}_id") == F.col(f"scrobble_{n}_id"), 0.75).otherwise(0.0)
    both_albums = F.col("has_album") & F.col("scrobble_has_album")
    features = {
        "identifier": F.when(F.col("recording_mbid").isNotNull(), (F.col("track_id") == F.col("scrobble_track_id")).cast("double")),
        "artist": text("artist"),
        "track": text("track"),
        "album": F.when(both_albums, same("album").cast("double")),
        "time": 1 - F.least(F.lit(1.0), F.abs(delta) / 30000.0),
        "duration": F.greatest(F.lit(0.0), 1 - F.abs(delta) / F.greatest(F.col("ms_played"), F.lit(30000)).cast("double")),
        "ordering": ordering,
        "competing": 1.0 / F.greatest("play_degree", "scrobble_degree"),
        "short": ((F.col("ms_played") >= 30000) & ~F.coalesce("skipped", F.lit(False))).cast("double"),
    }
    w = w.select("play_id", "scrobble_id", delta.alias("delta_ms"), "play_degree", "scrobble_degree", *(c.alias(f"{n}_score") for n, c in features.items()))
    known = lambda n: F.col(f"{n}_score").isNotNull()
    total, weight = F.lit(0.0), F.lit(0.0)
    for n, x in WEIGHTS.items():
        total, weight = total + F.coalesce(F.col(f"{n}_score") * x, F.lit(0.0)), weight + F.when(known(n), x).otherwise(0.0)
    w = w.withColumn("confidence", total / weight)
    decision = (
        F.when(F.col("identifier_score") == 0, "review").when(F.col("competing_score") != 1, "review").when(F.col("confidence") >= ACCEPT, "accept").when(F.col("confidence") >= REVIEW, "review").otherwise("ignore")
    )
    return w.withColumn("decision", decision)


def canonical_events(plays: DataFrame, scrobbles: DataFrame, decided: DataFrame) -> DataFrame:
    """One event per listen, out of records without exact duplicates: plays, scrobbles that no accepted pair merged, and merged ones with both records.

    decided: play_id, scrobble_id, decision; a scrobble is accepted once at most, a play takes all that are accepted for it,
    and scrobble_id is the least of them.  event_status is 'unresolved' where the own record's entities were new to all rules (column kind), else 'current'.
    """
    accepted = decided.where("decision = 'accept'").select("play_id", "scrobble_id")
    merged = accepted.groupBy("play_id").agg(F.min("scrobble_id").alias("scrobble_id"))
    state = F.when(F.col("kind") == "new_unresolved", "unresolved").otherwise("current").alias("event_status")
    own = ["listener", "artist_id", "track_id"]
    p = plays.join(merged, plays["record_id"] == merged["play_id"], "left")
    a = p.select(F.col("record_id").alias("event_id"), *own, (F.col("stopped_at_ms") - F.col("ms_played")).alias("started_ms"), F.col("stopped_at_ms").alias("ended_ms"), F.lit("derived_start").alias("time_basis"), state, F.col("ms_played").alias("listened_ms"), "scrobble_id")
    s = scrobbles.join(accepted, scrobbles["record_id"] == accepted["scrobble_id"], "left_anti")
    none = F.lit(None).cast("long")
    b = s.select(F.col("record_id").alias("event_id"), *own, F.col("instant_ms").alias("started_ms"), none.alias("ended_ms"), F.lit("observed_start").alias("time_basis"), state, none.alias("listened_ms"), none.alias("scrobble_id"))
    return a.unionByName(b)


def event_links(events: DataFrame, duplicates: DataFrame, decided: DataFrame) -> DataFrame:
    """event_id, record_id, source, role: each event's own record, the scrobbles merged into it, and exact duplicates (source, record_id, keeper) of any."""
    source = F.when(F.col("time_basis") == "derived_start", "interval").otherwise("instant")
    own = events.select("event_id", F.col("event_id").alias("record_id"), source.alias("source"), F.lit("primary").alias("role"))
    merged = decided.where("decision = 'accept'").select(F.col("play_id").alias("event_id"), F.col("scrobble_id").alias("record_id"), F.lit("instant").alias("source"), F.lit("cross_source_match").alias("role"))
    first = own.unionByName(merged)
    again = duplicates.join(first.select("event_id", F.col("record_id").alias("keeper"), "source"), ["keeper", "source"])
    return first.unionByName(again.select("event_id", "record_id", "source", F.lit("exact_duplicate").alias("role")))


def source_backing(links: DataFrame) -> DataFrame:
    """event_id, source_record_count, interval_record_count, instant_record_count, has_interval, has_instant; one row an event, so that joins don't multiply it."""
    of = lambda kind: (F.col("source") == kind).cast("long")
    g = links.groupBy("event_id").agg(F.count("*").alias("source_record_count"), F.sum(of("interval")).alias("interval_record_count"), F.sum(of("instant")).alias("instant_record_count"))
    return g.withColumn("has_interval", F.col("interval_record_count") > 0).withColumn("has_instant", F.col("instant_record_count") > 0)


def canonical_base(events: DataFrame, links: DataFrame) -> DataFrame:
    """The input of every analysis: events with calendar instant, backing and status."""
    b = events.join(source_backing(links), "event_id").withColumn("instant_ms", F.coalesce("started_ms", "ended_ms"))
    status = F.when(F.col("event_status") == "unresolved", "unresolved").when(F.col("has_interval") & F.col("has_instant"), "cross_source_reconciled").otherwise("single_source")
    return b.withColumn("status", status)


def refreshed_features(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """The feature table (play_id, scrobble_id, version, state, confidence) after scoring again: new pairs come in as pending, pending rows take new values, decided rows stay."""
    mine = old.where(F.col("version") == version)
    n = new.select("play_id", "scrobble_id", F.col("confidence").alias("_c"))
    j = mine.join(n, ["play_id", "scrobble_id"], "full")
    pending = F.coalesce("state", F.lit("pending")) == "pending"
    now = j.select("play_id", "scrobble_id", F.lit(version).alias("version"), F.coalesce("state", F.lit("pending")).alias("state"), F.when(pending, F.coalesce("_c", "confidence")).otherwise(F.col("confidence")).alias("confidence"))
    return old.where(F.col("version") != version).select(now.columns).unionByName(now)


def stratified_sample(candidates: DataFrame, stratum: str, k: int, version: str) -> DataFrame:
    """k rows per stratum in the order of sha256(version:id), the same in every run."""
    h = F.sha2(F.concat_ws(":", F.lit(version), F.col("play_id").cast("string"), F.col("scrobble_id").cast("string")), 256)
    n = F.row_number().over(Window.partitionBy(stratum).orderBy("hash", "play_id", "scrobble_id"))
    return candidates.withColumn("hash", h).withColumn("nth", n).where(F.col("nth") <= k)


def merge_roots(merges: DataFrame) -> DataFrame:
    """node, root of (subject, object) merges followed to the surviving entity; pointer doubling, so chains of n take log2(n) joins.

    An entity with several merges follows the least survivor; what runs into a cycle ends at the least entity on its way.
    """
    m = merges.groupBy(F.col("subject").alias("node")).agg(F.min("object").alias("root"))
    m = m.select("node", F.struct("root", F.least("node", "root").alias("low")).alias("x")).select("node", "x.*")
    m = stored(m)
    for _ in range(m.count().bit_length()):  # each round doubles the steps followed
        nxt = m.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("low").alias("_l"))
        j = m.join(nxt, m["root"] == nxt["_n"], "left")
        done = j.where("_n is not null and _r != root").limit(1).count() == 0
        m = stored(j.select("node", F.coalesce("_r", "root").alias("root"), F.least("low", F.coalesce("_l", "low")).alias("low")))
        if done:
            break
    live = m.select(F.col("node").alias("_n"))
    return m.join(live, m["root"] == live["_n"], "left").select("node", F.when(F.col("_n").isNotNull(), F.col("low")).otherwise(F.col("root")).alias("root"))
