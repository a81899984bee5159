"""Graph operators against plain Python, in one block and in many."""

import random
import time

import pytest
from pyspark.sql import functions as F

from convgraph.operators import graph


def random_graphs(seed, sizes):
    rng = random.Random(seed)
    turns, edges = [], []
    for sid, n in enumerate(sizes):
        for i in range(n):
            turns.append((sid, i, n - 1 - i))
            if i and rng.random() < 0.9:
                near = [max(0, i - rng.randint(1, 4)) for _ in range(rng.choice([1, 1, 2]))]
                far = [rng.randrange(i)] if rng.random() < 0.05 else []
                for pos, p in enumerate(dict.fromkeys(near + far)):
                    edges.append((sid, i, p, pos))
    return turns, edges


def reach(edges, sid, start, primary_only=False):
    up = {}
    for s, c, p, pos in edges:
        if s == sid and (pos == 0 or not primary_only):
            up.setdefault(c, []).append(p)
    seen, todo = set(), [start]
    while todo:
        for p in up.get(todo.pop(), []):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


@pytest.fixture(scope="module")
def graphs(spark):
    turns, edges = random_graphs(7, [1, 2, 9, 40, 130, 300])
    t = spark.createDataFrame(turns, "sid bigint, idx bigint, rev bigint")
    e = spark.createDataFrame(edges, "sid bigint, child bigint, parent bigint, pos int")
    return turns, edges, t, e


@pytest.mark.parametrize("block", [1024, 64, 8])
@pytest.mark.parametrize("primary", [False, True])
def test_closure_is_the_same_for_all_blocks(graphs, block, primary):
    turns, edges, t, e = graphs
    got = {}
    for r in graph.closure(t, e, primary_only=primary, block=block).collect():
        assert r.idx not in got.setdefault(r.sid, set())
        got[r.sid].add(r.idx)
    for sid in {s for s, _, _ in turns}:
        last = max(i for s, i, _ in turns if s == sid)
        assert got.get(sid, set()) == reach(edges, sid, last, primary)


@pytest.mark.parametrize("block", [1024, 8, 3])
def test_donor_branches(graphs, block):
    turns, edges, t, e = graphs
    gold = graph.closure(t, e, primary_only=True)
    gold_set = {(r.sid, r.idx) for r in gold.collect()}
    primary = {(s, c): p for s, c, p, pos in edges if pos == 0}
    want = {}
    for s, i, rev in sorted(turns):
        if rev > 0 and (s, i) not in gold_set:
            want[(s, i)] = want.get((s, primary.get((s, i))), i)
    got = {(r.sid, r.idx): r.root for r in graph.donor_branches(t, e, gold, block=block).collect()}
    assert got == want


def test_heads_and_active_branch(spark):
    t = spark.createDataFrame([(1, i, 4 - i) for i in range(5)], "sid bigint, idx bigint, rev bigint")
    e = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 1, 0), (1, 4, 2, 0)],
                              "sid bigint, child bigint, parent bigint, pos int")
    # the query's own parent (2) still counts as a head
    assert {r.idx for r in graph.branch_heads(t, e).collect()} == {2, 3}
    assert [(r.idx, r.hop) for r in graph.active_branch(t, e, 3).orderBy("hop").collect()] == [(3, 0), (1, 1), (0, 2)]


def test_subsequence_and_pattern(spark):
    d = spark.createDataFrame([([1, 3], [1, 2, 3]), ([3, 1], [1, 2, 3]), ([], [1]), ([1, 1], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in d.select(graph.is_subsequence(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    word = "abracadabra"
    t = spark.createDataFrame([(1, i, c) for i, c in enumerate(word)], "sid bigint, idx bigint, v string")
    for block in (2, 3, 100):
        for pat, want in (("brad", True), ("rcbb", False), ("aaaaa", True), ("aaaaaa", False)):
            got = graph.follows_pattern(t, "v", list(pat), "ok", block).first().ok
            assert got == want, (block, pat)


def test_long_conversation_with_many_far_edges_is_walked_in_time(spark):
    # one conversation of 40 blocks whose turns are entered from far later ones; each block was folded once per entry before
    n = 40 * 1024
    rows = [(1, i, i - 1 - i % 3, 0) for i in range(1, n)] + [(1, i, i // 2, 1) for i in range(1, n, 40)]
    rows = [r for r in rows if r[2] >= 0]
    t = spark.createDataFrame([(1, i, n - 1 - i) for i in range(n)], "sid bigint, idx bigint, rev bigint")
    e = spark.createDataFrame(rows, "sid bigint, child bigint, parent bigint, pos int")
    start = time.time()
    got = sorted(r.idx for r in graph.closure(t, e).collect())
    assert got == sorted(reach(rows, 1, n - 1))
    assert time.time() - start < 20


def test_branches_and_names_of_all_conversations_are_not_broadcast(spark):
    from convgraph.operators import longrules

    t = spark.createDataFrame([(1, i, 4 - i, "asks k1", "says Click") for i in range(5)], "sid bigint, idx bigint, rev bigint, user_message string, assistant_message string")
    b = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 1)], "sid bigint, idx bigint, root bigint")
    names = spark.createDataFrame([(1, "click"), (1, "K1"), (1, "absent")], "sid bigint, name string")
    hits = longrules.branch_entities(t, b, names, 2)
    assert sorted(tuple(r) for r in hits.collect()) == [(1, 1, 2, False), (1, 2, 2, False)]
    assert "BroadcastHashJoin" not in hits._jdf.queryExecution().executedPlan().toString()
