import pytest

from sonograin import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["v24_decision_lineage", "r11_superseded", "r12_manual_first"])
def test_pairs_are_scored_once_for_policy_and_manual_decisions(spark, monkeypatch, name):
    whole, calls = catalog.reconciliation.reconciled, []
    monkeypatch.setattr(catalog.reconciliation, "reconciled", lambda *a, **k: calls.append(name) or whole(*a, **k))
    found = catalog.QUERIES[name](spark, DATA)
    assert calls == [name] and found.columns[:2] == ["play_id", "scrobble_id"]
    found.count()
