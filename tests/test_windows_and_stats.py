"""Split windows, resampling and statistics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convgraph.functions import splitwin
from convgraph.operators import gates, resample, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.randint(0, 1000), rng.random()) for i in range(3000)] + [(f"k{i % 7}", i, i, rng.random()) for i in range(60)]
    return rows, spark.createDataFrame(rows, "k string, id bigint, o bigint, v double")


def test_split_row_number_and_cumsum(skewed):
    rows, df = skewed
    d = splitwin.split_row_number(df, ["k"], F.floor(F.col("o") / 50), [F.col("o"), F.col("id")], "pos", "n")
    d = splitwin.split_cumsum(d, ["k"], F.floor(F.col("o") / 50), [F.col("o"), F.col("id")], F.col("o"))
    got = {(r.k, r.id): (r.pos, r.n, r.cum) for r in d.collect()}
    for k in {r[0] for r in rows}:
        run = 0
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        for p, r in enumerate(mine, 1):
            run += r[2]
            assert got[k, r[1]] == (p, len(mine), run)


def test_split_percentile(skewed):
    rows, df = skewed
    got = {r.k: (r.q10, r.med) for r in splitwin.split_percentile(df, ["k"], "v", {"q10": 0.1, "med": 0.5}, F.floor(F.col("v") * 10)).collect()}
    for k in {r[0] for r in rows}:
        v = [r[3] for r in rows if r[0] == k]
        assert got[k] == pytest.approx((np.percentile(v, 10), np.median(v)))


def place(b, block, t, size, s, m=2147483647):
    """Place in the block of its draw t in resample b."""
    u = (b * 48271 + s) % m
    u2 = u * u % m
    first = (pow(u2 + block * 16807 + 12345, 2, m) + u) % m
    second = (first * 69621 + u2) % m // 4
    w = pow(first + t * 69621, 2, m) + second
    return (w * w % m * size) >> 31


def halved(k, u2, start, size, left, units, m=2147483647):
    base = (u2 + start * 69621 + size * 16807 + 7) % m
    total = 0
    for t in range(1, 13):
        w = (base * 48271 + t * 69621) % m
        w = (w * w + base) % m
        total += (w * w + t) % m
    mean = float(k) * float(left) / float(units)
    x = math.floor(mean + math.sqrt(mean * float(units - left) / float(units)) * (total / 2147483647.0 - 6.0) + 0.5)
    return min(max(x, 0), k)


def drawn(b, n, s, block, m=2147483647):
    """Positions drawn in resample b of n units, block by block."""
    u2 = pow((b * 48271 + s) % m, 2, m)
    nodes, out = [(0, -(-n // block), n)], []
    while nodes:
        start, size, k = nodes.pop()
        if size > 1:
            half, units = size // 2, min(n, (start + size) * block) - start * block
            left = halved(k, u2, start, size, half * block, units)
            nodes += [(start, half, left), (start + half, size - half, k - left)]
        else:
            width = min(n - start * block, block)
            out += [start * block + place(b, start, t, width, s) for t in range(k)]
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_bootstrap_mean_equals_plain_loop(spark, monkeypatch, block):
    rng = random.Random(5)
    rows = [(g, i * 3, rng.random()) for g, n in (("a", 37), ("b", 1), ("c", 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, unit bigint, m double")
    seeds = {r.g: r.s for r in df.select("g").distinct().withColumn("s", resample.seed_column(11, F.col("g"))).collect()}
    got = {r.g: r for r in resample.bootstrap_mean(df, ["g"], "unit", "m", 200, 11).collect()} if block == 4096 else None
    monkeypatch.setattr(resample, "BLOCK", block)
    for g in "abc":
        v = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] % 64, r[1]))]
        n = len(v)
        sums = np.zeros(200)
        for c in range(-(-n // block)):
            sums += resample.block_weights(np.arange(200), n, seeds[g], c) @ np.array(v[c * block:(c + 1) * block])
        means = [np.mean([v[i] for i in drawn(b, n, seeds[g], block)]) for b in range(200)]
        assert sums / n == pytest.approx(means)
        if got is None:
            continue
        assert got[g].n == n and got[g].mean == pytest.approx(np.mean(v))
        if n < 2:
            assert got[g].ci_low is None
        else:
            assert (got[g].ci_low, got[g].ci_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_groups_of_many_blocks(spark):
    """Three blocks: weights add up to the units, and the sums are those of the plain loop."""
    n, v = 9000, np.random.default_rng(2).random(9000)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "g string, unit bigint, m double").repartition(5)
    s = df.limit(1).select(resample.seed_column(4, F.col("g"))).first()[0]
    got = {r._b: r for r in resample.resample(df, ["g"], "unit", ["m"], 1200, 4).collect()}
    assert len(got) == 1200 and all(r.k_m == n for r in got.values())
    ordered = [v[i] for i in sorted(range(n), key=lambda i: (i % 64, i))]
    for b in (0, 7, 1199):
        assert got[b].s_m == pytest.approx(sum(ordered[i] for i in drawn(b, n, s, 4096)))
    assert np.std([r.s_m / n for r in got.values()]) == pytest.approx(v.std() / math.sqrt(n), rel=0.08)


def test_halving_has_the_spread_of_a_binomial():
    b = np.arange(20000)
    parts = np.stack([resample.block_draws(b, 20000, 77, c) for c in range(5)])
    assert (parts.sum(axis=0) == 20000).all()
    sizes = np.array([4096] * 4 + [20000 - 4 * 4096])
    assert parts.mean(axis=1) == pytest.approx(sizes, rel=0.002)
    assert parts.std(axis=1) == pytest.approx(np.sqrt(sizes * (1 - sizes / 20000)), rel=0.03)
    assert np.corrcoef(parts[0], parts[1])[0, 1] == pytest.approx(-4096 / (20000 - 4096), abs=0.03)


def test_draws_are_even_and_independent():
    w = resample.block_weights(np.arange(4000), 60, 9, 0)
    expected = 4000
    assert ((w.sum(axis=0) - expected) ** 2 / expected).sum() < 110  # chi-square of 59 degrees
    assert w.var(axis=0).mean() == pytest.approx(59 / 60, rel=0.03)
    assert abs(np.corrcoef(w[:-1, 3], w[1:, 3])[0, 1]) < 0.06 and abs(np.corrcoef(w[:, 3], w[:, 4])[0, 1] + 1 / 59) < 0.06


@pytest.mark.parametrize("n", [5, 4096, 4097, 100_001])
def test_resamples_of_a_block_are_drawn_together(monkeypatch, n):
    """One pass over all draws of a block's resamples, whatever their numbers, equals the draws one by one."""
    places, calls = resample._places, []
    monkeypatch.setattr(resample, "_places", lambda *a: calls.append(1) or places(*a))
    b, block, seed = np.arange(20) * 499, (n - 1) // 4096, 77
    got = resample.block_weights(b, n, seed, block)
    assert len(calls) == 1
    size = min(n - block * 4096, 4096)
    for k, draws in enumerate(resample.block_draws(b, n, seed, block)):
        want = np.zeros(size)
        u = (int(b[k]) * 48271 + seed) % 2147483647
        e = (u * u % 2147483647 + block * 16807 + 12345) % 2147483647
        first = (e * e + u) % 2147483647
        second = (first * 69621 + u * u % 2147483647) % 2147483647 // 4
        for t in range(int(draws)):
            w = ((first + t * 69621) ** 2 + second) ** 2 % 2147483647
            want[w * size >> 31] += 1
        assert (got[k] == want).all()


def test_bootstrap_spread_is_that_of_the_mean(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=145)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "g string, unit bigint, m double")
    r = resample.resample(df, ["g"], "unit", ["m"], 2000, 3).withColumn("mb", resample.mean_of("m")).agg(F.stddev("mb"), F.avg("mb")).first()
    assert r[0] == pytest.approx(v.std() / math.sqrt(145), rel=0.08)
    assert r[1] == pytest.approx(v.mean(), abs=0.02)


def test_missing_values_are_not_drawn_into_means(spark):
    df = spark.createDataFrame([("a", i, float(i) if i % 2 else None) for i in range(50)], "g string, unit bigint, m double")
    r = resample.resample(df, ["g"], "unit", ["m"], 50, 3).collect()
    assert all(0 < x.k_m < 50 and 1 <= x.s_m / x.k_m <= 49 for x in r)
    assert resample.resample(df.where("false"), ["g"], "unit", ["m"], 5, 3).count() == 0


def test_holm_golden(spark):
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.20])], "s string, i int, p double")
    got = [r.p_holm for r in stats.holm(df, ["s"], "p", 4).orderBy("i").collect()]
    assert got == pytest.approx([0.04, 0.09, 0.09, 0.20])
    assert all(r.p_holm is None for r in stats.holm(df, ["s"], "p", 5).collect())


def test_pooled_is_the_mean_of_the_models(spark):
    rng = random.Random(0)
    rows = [(m, s, lab, rng.random(), 100) for m in "abc" for s in range(20) for lab in ("x", "y")]
    f = spark.createDataFrame(rows, "model_key string, scenario_id bigint, method_label string, checklist_score double, context_tokens bigint")
    p = resample.paired_values(f, [("x", "y")]).groupBy("model", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("q_diff"))
    d = {r.model: r.q_diff for r in p.collect()}
    assert d["pooled"] == pytest.approx(sum(d[m] for m in "abc") / 3)
    assert stats.pooled_guard(p, resample.pooled_models(f, [("x", "y")])).count() == 0
    one_sided = f.where("not (model_key = 'c' and method_label = 'y')")
    q = resample.paired_values(one_sided, [("x", "y")])
    assert {r.model for r in q.select("model").distinct().collect()} == {"a", "b", "pooled"}
    assert resample.pooled_models(one_sided, [("x", "y")]).first().pooled_models == "a,b"


def test_kappa_of_constant_raters(spark):
    rows = [("same", True, True)] * 3 + [("opposite", True, False)] * 3 + [("single", True, True)] + [
        ("mixed", True, True), ("mixed", True, False), ("mixed", False, False), ("mixed", False, False)]
    k = {r.g: r.kappa for r in stats.kappa(spark.createDataFrame(rows, "g string, ref boolean, cand boolean"), ["g"]).collect()}
    assert (k["same"], k["opposite"], k["single"]) == (1.0, 0.0, None)
    assert k["mixed"] == pytest.approx(0.5)


def test_quota_sample(spark):
    rows = [(f"{f}{s}{m}", f"{f}{s}", f, m, "x") for f, n in (("p", 30), ("q", 9), ("r", 1)) for s in range(n) for m in "ab"]
    df = spark.createDataFrame(rows, "key string, scenario_id string, family string, model_key string, method_label string")
    q = {r.family: r.quota for r in stats.quotas(df, 20).collect()}
    assert sum(q.values()) == 20 and q["r"] == 2
    got = stats.quota_sample(df, 20, 1).collect()
    assert len(got) == len({r.key for r in got}) == 20
    per = {f: [r for r in got if r.family == f] for f in q}
    assert all(len(per[f]) == q[f] for f in q)
    assert len({r.scenario_id for r in per["p"]}) == q["p"]


def test_gates(spark):
    s = spark.createDataFrame([("m", "oracle_dag", 0.80, 60.0), ("m", "full_history", 0.84, 0.0), ("n", "oracle_dag", 0.7, 60.0),
                               ("n", "full_history", 0.8, 0.0)], "model_key string, method_label string, checklist_score double, token_reduction_pct double")
    adv = spark.createDataFrame([("m", 0.2), ("n", 0.2)], "model_key string, join_adv double")
    v = {r.model_key: r.verdict for r in gates.feasibility(s, adv).collect()}
    assert v == {"m": "GO", "n": "PIVOT (dependency semantics)"}
    amp = lambda xs: gates.amplification(spark.createDataFrame([(str(i), x) for i, x in enumerate(xs)], "model string, q_diff double")).first().verdict
    assert [amp(x) for x in ([.06, .05, 0.], [.06, .041, 0.], [.06, .0, -.1], [.06])] == ["AMPLIFIES", "PARTIAL", "FLAT", "AWKWARD"]
    j = spark.createDataFrame([("a", 0.65, 0.01, True), ("b", 0.80, 0.015, True), ("c", 0.95, 0.05, True), ("d", 0.99, 0.001, False)],
                              "judge string, kappa double, usd_per_call double, passes boolean")
    assert gates.adopt_judge(j).first().adopted == "b"
    assert gates.cheapest_passer(j).first().adopted == "a"


def test_quotas_add_up(spark):
    def of(sizes, total):
        rows = [(f"f{i:02d}", f"{i}-{k}") for i, n in enumerate(sizes) for k in range(n)]
        return {r.family: r.quota for r in stats.quotas(spark.createDataFrame(rows, "family string, scenario_id string"), total).collect()}

    many = of([3] * 50, 20)
    assert sum(many.values()) == 20
    few = of([900, 2, 2, 2, 2], 20)
    assert sum(few.values()) == 20 and min(few.values()) == 2 and few["f00"] == 12
