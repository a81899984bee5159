"""Figures of judges read off one table of counted items."""

import pytest

from convgraph.operators import facts, stats
from convgraph.plans import catalog_stats

SF = "/root/testdata/sf0.001"


def test_kappa_of_counts_is_kappa_of_items(spark):
    rows = [("x", i, i % 3 == 0, i % 4 == 0) for i in range(50)] + [("y", 0, True, True), ("z", 0, True, False), ("z", 1, True, False)]
    items = spark.createDataFrame(rows, "judge string, i int, ref boolean, cand boolean")
    per = items.selectExpr("judge", "i % 7 AS k", "ref", "cand").groupBy("judge", "k").agg(
        *[stats.F.expr(e) for e in ("count(*) AS n", "count_if(ref = cand) AS n_equal", "count_if(ref) AS n_ref", "count_if(cand) AS n_cand")])
    want = {r.judge: r for r in stats.kappa(items, ["judge"]).collect()}
    got = {r.judge: r for r in stats.kappa_of_counts(per, ["judge"]).collect()}
    assert want.keys() == got.keys()
    for j in want:
        assert got[j].n_items == want[j].n_items and got[j].kappa == pytest.approx(want[j].kappa) and got[j].agreement == pytest.approx(want[j].agreement)


@pytest.mark.parametrize("name", ["d7_judge_bar", "d7_adopted_judge", "d8_judge_bar_v2"])
def test_judges_are_aligned_once(spark, monkeypatch, name):
    align, calls = facts.align_items, []
    monkeypatch.setattr(facts, "align_items", lambda *a: calls.append(1) or align(*a))
    getattr(catalog_stats, name)(spark, SF).collect()
    assert len(calls) == 1
