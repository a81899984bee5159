"""Context selection against plain loops."""

import random

import pytest

from convgraph.operators import metrics, select
from convgraph.operators.select import Method


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows, cos = [], []
    for sid in range(12):
        n = rng.randint(1, 60)
        for i in range(n):
            rows.append((sid, i, n - 1 - i, rng.randint(4, 60)))
            if i < n - 1:
                cos.append((sid, i, round(rng.random(), 2)))
    t = spark.createDataFrame(rows, "sid bigint, idx bigint, rev bigint, cost bigint")
    c = spark.createDataFrame(cos, "sid bigint, idx bigint, cosine double")
    return rows, cos, t, c


def chosen(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.sid, r.budget), set()).add(r.idx)
    return out


def test_sliding_window_stops_at_the_first_overflow(data):
    rows, _, t, _ = data
    got = chosen(select.sliding_window(t, [50, 200]))
    for sid in {r[0] for r in rows}:
        for b in (50, 200):
            used, want = 0, set()
            for _, i, rev, cost in sorted((r for r in rows if r[0] == sid and r[2] > 0), key=lambda r: r[2]):
                if used + cost > b:
                    break
                used += cost
                want.add(i)
            assert got.get((sid, b), set()) == want


def test_retrieval_skips_what_does_not_fit(data):
    rows, cos, t, c = data
    got = chosen(select.semantic_retrieval(t, c, [50, 200, 900]))
    cost = {(r[0], r[1]): r[3] for r in rows}
    for sid in {r[0] for r in rows}:
        for b in (50, 200, 900):
            used, want = 0, set()
            for _, i, _s in sorted((x for x in cos if x[0] == sid), key=lambda x: (-x[2], x[1])):
                if used + cost[(sid, i)] <= b:
                    used += cost[(sid, i)]
                    want.add(i)
            assert got.get((sid, b), set()) == want


def test_methods_are_checked(data, spark):
    _, _, t, _ = data
    e = spark.createDataFrame([], "sid bigint, child bigint, parent bigint, pos int")
    with pytest.raises(ValueError):
        select.select_context(t, e, [Method("sliding_window")])
    with pytest.raises(ValueError):
        select.select_context(t, e, [Method("telepathy")])


def test_metrics_of_empty_sets(spark):
    t = spark.createDataFrame([(s, i, 2 - i, 10, s == 1 and i == 0, i < 2 and not (s == 1 and i == 0)) for s in (1, 2) for i in range(3)],
                              "sid bigint, idx bigint, rev bigint, cost bigint, is_evidence boolean, is_distractor boolean")
    sel = spark.createDataFrame([(1, "full", None, 0, 10), (1, "full", None, 1, 10), (2, "full", None, 0, 10)],
                                "sid bigint, method string, budget bigint, idx bigint, cost bigint")
    plan = metrics.instances(t, [("full", None), ("none", None)])
    m = {(r.sid, r.method): r for r in metrics.selection_metrics(t, sel, plan).collect()}
    assert (m[1, "full"].context_precision, m[1, "full"].context_recall, m[1, "full"].context_sufficiency) == (0.5, 1.0, 1)
    assert m[1, "full"].irrelevant_context_ratio == 0.5 and m[1, "full"].n_distractors_selected == 1
    # evidence but nothing selected
    assert (m[1, "none"].context_precision, m[1, "none"].context_recall, m[1, "none"].context_f1) == (0.0, 0.0, 0.0)
    # no evidence: recall and sufficiency hold, precision only for an empty selection
    assert (m[2, "none"].context_precision, m[2, "none"].context_recall, m[2, "none"].context_sufficiency) == (1.0, 1.0, 1)
    assert (m[2, "full"].context_precision, m[2, "full"].context_recall) == (0.0, 1.0)


def test_candidate_oracle_falls_back_to_the_whole_history(spark):
    t = spark.createDataFrame([(s, i, 4 - i, 10) for s in (1, 2) for i in range(5)], "sid bigint, idx bigint, rev bigint, cost bigint")
    closed = spark.createDataFrame([(1, 0), (1, 2), (2, 3)], "sid bigint, idx bigint")
    ranked = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 0, 3), (2, 3, 1)], "sid bigint, idx bigint, rank int")
    sel, flags = select.candidate_oracle(t, closed, ranked, [2, 3])
    got = {}
    for r in sel.collect():
        got.setdefault((r.sid, r.budget), set()).add(r.idx)
    assert got == {(1, 2): {0, 1, 2, 3}, (1, 3): {0, 2}, (2, 2): {3}, (2, 3): {3}}
    assert {(r.sid, r.k): (r.recall_fallback, r.n_missing) for r in flags.collect()} == {
        (1, 2): (1, 1), (1, 3): (0, 0), (2, 2): (0, 0), (2, 3): (0, 0)}


def test_turns_of_cost_zero_and_one(spark):
    turns = spark.createDataFrame([(1, i, 600 - i, 0 if i % 3 == 0 else 1) for i in range(601)], "sid long, idx long, rev long, cost long")
    got = select.sliding_window(turns, [100]).collect()
    assert sum(r.cost for r in got) == 100 and len(got) >= 149
    cosine = turns.where("rev > 0").selectExpr("sid", "idx", "cost", "idx / 1000.0 AS cosine")
    picked = select.semantic_retrieval(turns, cosine.selectExpr("sid", "idx", "cost", "CAST(cosine AS DOUBLE) cosine"), [100]).collect()
    assert sum(r.cost for r in picked) == 100 and sum(r.cost == 0 for r in picked) == 200
