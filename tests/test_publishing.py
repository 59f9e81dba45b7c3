"""Bundles of published datasets, and the declared rules of stored tables."""

import pytest
from pyspark.sql import functions as F

from sonograin.operators import constraints
from sonograin.plans import envelope, publishing

EVENTS = "event_id long, instant_ms long, event_status string, artist_id long, track_id long, listened_ms long, has_interval boolean, has_instant boolean, rule_version string"


def found_of(spark, n):
    table = spark.range(n).withColumn("x", F.col("id") / 3)
    envelopes = publishing.full_envelope(spark.createDataFrame([], EVENTS), "volume", {"grain": "month"}, "UTC", ["b", "a", "b"])
    return publishing.Analyses({"volume": table, "coverage": spark.range(0)}, envelopes)


def test_bundles(spark, tmp_path):
    state, path = spark.range(5), str(tmp_path / "out")
    one = found_of(spark, 7)
    manifest = {r.dataset: r for r in publishing.publish(one, state, path, 1).collect()}
    assert {n: r.n for n, r in manifest.items()} == {"volume": 7, "coverage": 0, "envelopes": 1}
    assert manifest["volume"].digest == envelope.digest(one.datasets["volume"]).head().digest  # what was observed is what a second read gives
    with pytest.raises(Exception):  # a run that fails leaves the bundle before it in force
        publishing.publish(publishing.Analyses({"volume": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))}, one.envelopes), state, path, 2)
    assert publishing.newest(spark, path).endswith("bundle-000000000001")
    assert {r.status for r in publishing.verify(path, state, one).collect()} == {"valid"}
    assert {r.dataset: r.status for r in publishing.verify(path, state, found_of(spark, 8)).collect()} == {"volume": "invalid", "coverage": "valid", "envelopes": "valid"}
    assert {r.status for r in publishing.verify(path, spark.range(6)).collect()} == {"stale"}
    publishing.publish(found_of(spark, 8), state, path, 3)
    assert publishing.newest(spark, path).endswith("bundle-000000000003")


def test_full_envelope(spark):
    none = publishing.full_envelope(spark.createDataFrame([], EVENTS), "volume", {}, "UTC", ["b", "a", "b"]).head()
    assert (none.event_count, none.start_ms, none.as_of_ms, none.sources, none.unresolved_rate) == (0, None, None, [], 0.0)
    assert none.versions.identity_rules == ["a", "b"] and none.versions.reconciliation_rules == ["none"] and none.coverage["track_id"].asDict() == {"available": 0, "rate": 0.0, "total": 0}
    rows = [(1, 10, "current", 1, None, 5, True, False, "v2"), (2, 30, "unresolved", 1, 2, None, True, False, " "), (3, 99, "superseded", 1, 2, 5, False, True, "v3")]
    e = publishing.full_envelope(spark.createDataFrame(rows, EVENTS), "abandonment", {"b": 1, "a": "x"}, "UTC", [], "v0").head()
    assert (e.event_count, e.start_ms, e.end_ms, e.as_of_ms, e.sources, e.unresolved_rate, e.parameters) == (2, 10, 31, 31, ["interval"], 0.5, '{"a":"x","b":"1"}')
    assert e.versions.reconciliation_rules == ["v2"] and {k: v.available for k, v in e.coverage.items()} == {"artist_id": 2, "track_id": 1, "listened_ms": 1}


def test_rules(spark):
    tag = spark.createDataFrame([(1, "a", "a", "raw"), (2, "b", "b", "mine"), (2, "", "c", "raw"), (4, "d", "a", "raw"), (5, "e", None, "raw"), (6, "f", None, "raw")], "id int, tag_name string, normalized_tag string, tag_kind string")
    mapping = spark.createDataFrame([(1, 1, 2, "v", 0.5, "r"), (2, 9, 2, "v", 1.5, "r"), (3, 2, 2, "v", None, "")], "id int, source_tag_id int, curated_tag_id int, mapping_version string, confidence double, rationale string")
    got = {(r.table, r.rule): r.violations for r in constraints.violations({"genre_tag": tag, "genre_mapping": mapping}).where("violations > 0").collect()}
    assert got == {
        ("genre_tag", "tag_kind"): 1, ("genre_tag", "tag_name_filled"): 1, ("genre_tag", "normalized_tag_required"): 2, ("genre_tag", "id_unique"): 1, ("genre_tag", "normalized_tag_tag_kind_unique"): 1,
        ("genre_mapping", "confidence"): 1, ("genre_mapping", "confidence_required"): 1, ("genre_mapping", "rationale_filled"): 1, ("genre_mapping", "two_tags"): 1, ("genre_mapping", "source_tag_id_known"): 1,
    }
    empty = constraints.violations({"genre_tag": tag.limit(0)}).collect()
    assert len(empty) == 4 + 3 + 2 and all(r.violations == 0 for r in empty)
    for rules in constraints.RULES.values():  # every declaration is an expression of SQL
        assert all(F.expr(e) is not None for e in rules.checks.values())
