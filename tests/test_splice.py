"""Scoring and choice of donors in blocks against plain loops over all pairs."""

import numpy as np
import pytest

from convgraph.operators import splice


def world(spark, n_sids=40, dim=5):
    rng = np.random.default_rng(8)
    donors, vectors, members, items = [], [], [], []
    for sid in range(n_sids):
        for b, root in enumerate(range(0, 30, 10)):
            n = int(rng.integers(1, 9))
            donors.append((sid, root, b, n))
            v = rng.normal(size=dim) if sid % 4 else np.ones(dim)  # equal vectors tie
            if sid != 7:
                vectors.append((sid, root, (v / np.linalg.norm(v)).tolist()))
            for i in range(n):
                members.append((sid, root + i, root))
                items.append((sid, root + i, f"k{rng.integers(0, 60)}"))
    targets = [(100 + k, 10 + k % 7) for k in range(30)] + [(3, 12), (5, 12)]
    queries = [(sid, (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=dim))) for sid, _ in targets]
    items += [(sid, n, f"k{rng.integers(0, 60)}") for sid, n in targets if sid >= 100]
    closed = [(sid, 1) for sid, _ in targets if sid >= 100]
    items += [(sid, 1, f"k{sid % 60}") for sid, _ in targets if sid >= 100]
    df = spark.createDataFrame
    return dict(t=df(targets, "sid bigint, base_n bigint"), query_vectors=df(queries, "sid bigint, u array<double>"),
                donors=df(donors, "sid bigint, root bigint, branch bigint, n_turns bigint"), donor_vectors=df(vectors, "sid bigint, root bigint, u array<double>"),
                closed=df(closed, "sid bigint, idx bigint"), members=df(members, "sid bigint, idx bigint, root bigint"),
                items=df(items, "sid bigint, idx bigint, item string")), targets, queries, donors, vectors, members, items, closed


@pytest.mark.parametrize("sizes", [(1024, 256), (7, 5)])
def test_blocks_equal_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(splice, "DONORS", sizes[0])
    monkeypatch.setattr(splice, "TARGETS", sizes[1])
    lengths, slack = (20, 30), 3
    tables, targets, queries, donors, vectors, members, items, closed = world(spark)
    best, reports = splice.score_donors(**tables, lengths=lengths, slack=slack)
    u, q = {(s, r): np.array(v) for s, r, v in vectors}, {s: np.array(v) for s, v in queries}
    item = {}
    for s, i, x in items:
        item.setdefault((s, i), set()).add(x)
    has = {}
    for s, i, r in members:
        has.setdefault((s, r), set()).update(item.get((s, i), ()))
    got_reports = {r.target: r for r in reports.collect()}
    got_picks = {}
    for r in splice.choose_donors(best, lengths, slack).collect():
        got_picks.setdefault(r.target, []).append((r.pick, r.length, r.sid, r.root, r.branch, r.n_turns))
    for sid, n in targets:
        gold = set().union(*[item.get((s, i), set()) for s, i in closed if s == sid], item.get((sid, n), set()))
        others = [d for d in donors if d[0] != sid]
        scored = [(float((u[d[0], d[1]] * q[sid]).sum()), d) for d in others if (d[0], d[1]) in u]
        free = sorted(((-c, d[0], d[1], d[2], d[3]) for c, d in scored if not has[d[0], d[1]] & gold))
        r = got_reports[sid]
        assert (r.n_donors, r.n_rejected) == (len(scored), sum(1 for d in others if has[d[0], d[1]] & gold))
        assert (r.n_admissible, r.turns_admissible) == (len(free), sum(f[4] for f in free))
        assert r.best_cosine == pytest.approx(max(c for c, _ in scored)) and r.mean_cosine == pytest.approx(np.mean([c for c, _ in scored]))
        picks, used, total = [], set(), n
        for length in lengths:
            for f in free:
                if f[1:3] not in used and total < length and total + f[4] <= length + slack:
                    used.add(f[1:3])
                    total += f[4]
                    picks.append((len(picks), length, *f[1:]))
        assert sorted(got_picks.get(sid, [])) == picks


def test_nothing_to_score(spark):
    tables = world(spark)[0]
    for name in ("donors", "t"):
        best, reports = splice.score_donors(**(tables | {name: tables[name].where("false")}), lengths=(20,))
        assert best.count() == 0 and reports.count() == 0


def text_world(spark):
    df = spark.createDataFrame
    turns = [(1, i, 4 - i, f"body {i}") for i in range(5)]
    order = [("x", 9), (1, 0), ("x", 8), (1, 1), (1, 2), (1, 3), (1, 4)]
    new = [(1, 7, k, 6 - k, f"body {i}" if s == 1 else f"other {i}") for k, (s, i) in enumerate(order)]
    return dict(turns=df(turns, "sid bigint, idx bigint, rev bigint, body string"), closed=df([(1, 0), (1, 2)], "sid bigint, idx bigint"),
                new_closed=df([(1, 7, 1), (1, 7, 4)], "target bigint, length bigint, new_idx bigint"),
                checklist=df([(1, 0, "a"), (1, 1, "b")], "sid bigint, item_id int, text string"),
                new_checklist=df([(1, 7, 0, "a"), (1, 7, 1, "b")], "target bigint, length bigint, item_id int, text string"),
                new_turns=df(new, "target bigint, length bigint, new_idx bigint, rev bigint, body string"))


def test_text_checks_find_planted_faults(spark):
    from pyspark.sql import functions as F

    t = text_world(spark)
    flags = lambda t: tuple(splice.text_checks(**t).select("context_same", "query_same", "checklist_same").first())
    assert flags(t) == (True, True, True)
    changed = t["new_turns"].withColumn("body", F.when(F.col("new_idx") == 4, "body 2.").otherwise(F.col("body")))
    assert flags(t | {"new_turns": changed}) == (False, True, True)
    moved = t["new_turns"].withColumn("body", F.when(F.col("new_idx") == 4, "body 0").when(F.col("new_idx") == 1, "body 2").otherwise(F.col("body")))
    assert flags(t | {"new_turns": moved}) == (False, True, True)
    assert flags(t | {"new_closed": t["new_closed"].where("new_idx = 1")}) == (False, True, True)
    assert flags(t | {"new_turns": t["new_turns"].withColumn("body", F.when(F.col("rev") == 0, "?").otherwise(F.col("body")))}) == (True, False, True)
    assert flags(t | {"new_checklist": t["new_checklist"].where("item_id = 0")}) == (True, True, False)


def test_digest_of_many_runs_is_that_of_the_order(spark):
    import hashlib

    from convgraph.functions.digest import ordered_digest

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = [None if i % 50 == 3 else f"text {i}" for i in range(1000)]
    df = spark.createDataFrame([("k", i * 3, t) for i, t in enumerate(texts)], "k string, o bigint, t string").repartition(7)
    leaves = ["-" if t is None else h(t) for t in texts]
    want = h("".join(h("".join(leaves[a:a + 256])) for a in range(0, 1000, 256)))
    assert [tuple(r) for r in ordered_digest(df, ["k"], "o", "t").collect()] == [("k", want, 1000)]
    assert ordered_digest(df.where("false"), ["k"], "o", "t").count() == 0
