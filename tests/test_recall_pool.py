"""Recall is computed from a pool without lists of shared items."""

from convgraph.operators import candidates
from convgraph.plans import catalog_candidates, inputs

SF = "/root/testdata/sf0.001"


def test_recall_writes_no_shared_items(spark, monkeypatch):
    make, seen = candidates.candidate_pool, []
    monkeypatch.setattr(candidates, "candidate_pool", lambda *a, **k: seen.append(make(*a, **k)) or seen[-1])
    p = catalog_candidates.build(spark, SF)
    want = candidates.recall_at(p.turns, p.pool, p.closed, catalog_candidates.KS)
    got = catalog_candidates.recall(spark, SF).drop("family")
    assert "shared_items" in seen[0].columns and seen[1].columns == ["sid", "idx", "sources", "cosine"]
    rows = sorted(map(str, got.select(*want.columns).collect()))
    assert rows and rows == sorted(map(str, want.collect()))


def test_counted_items_are_those_listed(spark):
    t = inputs.turns(spark, SF).cache()
    for least in (1, 2):
        listed = candidates.shared_items(t, inputs.items(t), least).select("sid", "idx")
        counted = candidates.shared_items(t, inputs.items(t), least, listed=False)
        rows = sorted(map(tuple, counted.collect()))
        assert rows == sorted(map(tuple, listed.collect()))
