"""Reconciliation kept up to date: a batch changes what depends on it, and nothing else is paired or written.

What an identity depends on is closed under shared names and identifiers: a batch reaches the components of that relation
which it touches, and those alone are resolved again.  Pairs, scores and events belong to one listener, so they are made anew for
listeners with new evidence, with evidence whose entities changed, or with tracks that can now be met by other names.  State
lies in buckets (``Snapshot``): components in ``records``, listeners in ``heard``, ``events`` and ``links``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import with_match_text
from ..operators import identity, reconcile
from ..plans.reconciliation import decided_events, duplicates_of, evidence_records
from ..plans.snapshot import Snapshot
from ..plans.storage import Rounds, stored

_STATE = {
    "nodes": "node string, component string",
    "records": "record_id long, artist string, track string, album string, artist_mbid string, recording_id string, release_mbid string, listener long, component string, artist_id long, track_id long, kind string, keys array<string>",
}
_EVENTS = "event_id long, listener long, artist_id long, track_id long, started_ms long, ended_ms long, time_basis string, event_status string, listened_ms long, scrobble_id long"
_LINKS = "event_id long, record_id long, source string, role string, listener long"
_ENTITIES = ["artist_id", "track_id", "kind", "keys"]


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the undirected edges (a, b); a loop (a, a) names a lone node.

    Every node takes the least label around it and then the label of its label, until nothing changes.
    """
    rounds = Rounds(edges.sparkSession)
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("low"))
        near = labels.join(around, labels["node"] == around["n"]).select("node", F.least("component", "low").alias("new"), F.col("component").alias("old"))
        of = near.select(F.col("node").alias("_n"), F.col("new").alias("_l"))
        new = rounds.keep(near.join(of, near["new"] == of["_n"]).select("node", F.least("new", "_l").alias("component"), "old"))
        moved = new.where("component != old").limit(1).count()
        labels = new.drop("old")
        if not moved:
            return labels


def _nodes(records: DataFrame) -> DataFrame:
    """record_id and node of everything that can tie a record to another one: names, titles with their names, and identifiers; a record without any is its own."""
    named = with_match_text(records.select("record_id", "artist", "artist_mbid", "recording_id", "release_mbid"), name="artist")
    parts = F.array_compact(F.array(*(F.concat(F.lit(f"{c}:"), F.col(c)) for c in ("name", "artist_mbid", "recording_id", "release_mbid"))))
    own = F.array(F.concat(F.lit("record:"), F.col("record_id").cast("string")))
    return named.select("record_id", F.explode(F.when(F.size(parts) == 0, own).otherwise(parts)).alias("node"))


def _tied(nodes: DataFrame) -> DataFrame:
    """Edges between the first node of each record and all its nodes."""
    first = nodes.groupBy("record_id").agg(F.min("node").alias("a"))
    return first.join(nodes, "record_id").select("a", F.col("node").alias("b")).distinct()


def _buckets(rows: DataFrame, snapshot: Snapshot, key: str) -> list[int]:
    return sorted(r[0] for r in rows.select(snapshot.bucket(F.col(key))).distinct().collect())  # as many as there are buckets at most


class Reconciler:
    """Keeps events and links under ``path``; ``run`` is a function for foreachBatch.

    A batch has a column source (interval or instant) and then the columns of plays and scrobbles.  A batch that comes again
    replaces itself.  ``events`` and ``links`` read the state after the newest batch.
    """

    def __init__(self, path: str, plays: str, scrobbles: str, same_play: list[str], same_scrobble: list[str], buckets: int = 64):
        self.path, self.plays, self.scrobbles, self.same_play, self.same_scrobble, self.buckets = path, plays, scrobbles, same_play, same_scrobble, buckets
        columns = {c.split()[0]: c for c in (plays + "," + scrobbles).replace(", ", ",").split(",")}
        self.evidence = ", ".join(columns.values())
        self.heard = f"source string, {self.evidence}, artist_id long, track_id long, kind string, keys array<string>"

    def events(self, spark) -> DataFrame:
        return Snapshot(spark, self.path, 1 << 62, self.buckets).read("events", _EVENTS)

    def links(self, spark) -> DataFrame:
        return Snapshot(spark, self.path, 1 << 62, self.buckets).read("links", _LINKS).drop("listener")

    def run(self, batch: DataFrame, number: int) -> None:
        snap = Snapshot(batch.sparkSession, self.path, number, self.buckets)
        rows = stored(batch)
        known = snap.read("heard", self.heard, _buckets(rows, snap, "listener")).select("source", "record_id")
        rows = stored(rows.join(known, ["source", "record_id"], "left_anti"))
        if not rows.take(1):
            return
        records, changed = self._identities(snap, rows)
        self._listeners(snap, rows, records, changed)
        snap.commit()

    def _identities(self, snap: Snapshot, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(records of the components that rows reach, resolved; record ids whose entities or names are new or other)."""
        e = evidence_records(rows.where("source = 'interval'"), rows.where("source = 'instant'")).join(rows.select("record_id", "listener"), "record_id")
        new_nodes = stored(_nodes(e))
        index = snap.read("nodes", _STATE["nodes"])  # two narrow columns
        met = stored(index.join(new_nodes.select("node").distinct(), "node", "left_semi"))
        edges = _tied(new_nodes).unionByName(met.select(F.col("node").alias("a"), F.col("component").alias("b")))
        now = stored(components(edges))
        touched = stored(met.select("component").distinct().join(now.withColumnRenamed("component", "to"), F.col("component") == F.col("node")).select("component", "to"))

        old_buckets = _buckets(touched, snap, "component")
        state = stored(snap.read("records", _STATE["records"], old_buckets))
        mine = state.join(touched, "component")
        old = mine.select("record_id", *(F.col(c).alias(f"old_{c}") for c in _ENTITIES))
        base = ["record_id", "artist", "track", "album", "artist_mbid", "recording_id", "release_mbid", "listener"]
        of_record = new_nodes.groupBy("record_id").agg(F.min("node").alias("node")).join(now, "node").select("record_id", "component")
        records = stored(mine.select(*base, F.col("to").alias("component")).unionByName(e.join(of_record, "record_id").select(*base, "component")))

        entities = stored(identity.resolved(records.drop("listener", "component"))).select("record_id", "artist_id", "track_id", "kind")
        named = with_match_text(records, artist_key="artist", track_key="track").join(entities, "record_id")
        keys = reconcile.name_keys(named.select("artist_id", "track_id", "artist_key", "track_key").distinct()).groupBy("track_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
        done = stored(named.drop("artist_key", "track_key").join(keys, "track_id", "left").select(*records.columns, *_ENTITIES))
        j = done.join(old, "record_id", "left")
        same = F.lit(True)
        for c in _ENTITIES:
            same &= F.col(c).eqNullSafe(F.col(f"old_{c}"))
        changed = stored(j.where(~same).select("record_id", "listener"))

        into = sorted({*old_buckets, *_buckets(done, snap, "component")})
        beside = snap.read("records", _STATE["records"], into).join(touched, "component", "left_anti")
        snap.write("records", beside.unionByName(done), "component", into)
        nodes = snap.read("nodes", _STATE["nodes"], into).join(touched, "component", "left_anti")
        mine_now = snap.read("nodes", _STATE["nodes"], old_buckets).join(touched, "component").select("node", F.col("to").alias("component"))
        snap.write("nodes", nodes.unionByName(mine_now.unionByName(now.join(new_nodes.select("node").distinct(), "node", "left_semi")).distinct()), "component", into)
        return done, changed

    def _listeners(self, snap: Snapshot, rows: DataFrame, records: DataFrame, changed: DataFrame) -> None:
        listeners = stored(changed.select("listener").distinct())
        into = _buckets(listeners, snap, "listener")
        heard = stored(snap.read("heard", self.heard, into).unionByName(rows.select("source", *(c.split()[0] for c in self.evidence.split(", "))), allowMissingColumns=True))
        fresh = records.join(changed.select("record_id"), "record_id", "left_semi").select(F.col("record_id").alias("_r"), *(F.col(c).alias(f"_{c}") for c in _ENTITIES))
        heard = heard.join(fresh, heard["record_id"] == fresh["_r"], "left")
        heard = stored(heard.select(*(F.when(F.col("_r").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in _ENTITIES else F.col(c) for c in [x.split()[0] for x in self.heard.split(", ")])))
        mine = heard.join(listeners, "listener", "left_semi")
        named = stored(with_match_text(mine, artist_key="artist", track_key="track", album_key="album").withColumn("has_album", F.col("album").isNotNull()))
        p, s = named.where("source = 'interval'"), named.where("source = 'instant'")
        again = stored(duplicates_of(p, s, self.same_play, self.same_scrobble))
        keep = lambda r, kind: r.join(again.where(F.col("source") == kind), "record_id", "left_anti")
        p, s = stored(keep(p, "interval")), stored(keep(s, "instant"))
        keys = named.select("track_id", F.explode("keys").alias("key")).distinct()
        pairs = stored(reconcile.candidate_pairs(p, s, keys))
        _, _, events, links = decided_events(p, s, pairs, again)
        events = stored(events)
        links = links.join(events.select("event_id", "listener"), "event_id")
        for name, schema, new in (("events", _EVENTS, events), ("links", _LINKS, links)):
            beside = snap.read(name, schema, into).join(listeners, "listener", "left_anti")
            snap.write(name, beside.unionByName(new.select(beside.columns)), "listener", into)
        snap.write("heard", heard, "listener", into)
