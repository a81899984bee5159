import random

import numpy as np

from convgraph.llm import labels, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_training_labels(spark):
    rows = [(i, i % 2) for i in range(60)] + [(0, 0), (2, 1), (None, 1), (61, None), (62, 5)]
    got = {r.doc_id: r.y for r in labels.training_labels(spark.createDataFrame(rows, "doc_id long, quality int"), "quality").collect()}
    import zlib

    assert got == {i: i % 2 for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1 and i != 2}


def test_statistics_are_finite():
    for t in [None, "", " ", "\n", "a", "A" * 10, "x " * 100_000, "é" * 50, "||| !!! $$$", "\ud800"]:
        x = quality.statistics(t)
        assert len(x) == len(quality.NAMES) and np.isfinite(x).all()


def test_discriminant_equals_plain_density():
    rng = np.random.default_rng(1)
    xs = [rng.normal(size=(300, 3)) @ np.diag([1, 2, 3]) + k for k in (0, 2)]
    aug = [np.column_stack([np.ones(len(x)), x]) for x in xs]
    model = quality.fit([a.T @ a for a in aug], to_pooled=0.0, to_diagonal=0.0)
    x = rng.normal(size=(50, 3)) * 2
    dens = []
    for s in xs:
        cov, mu = np.cov(s.T, bias=True) + 1e-6 * np.eye(3), s.mean(axis=0)
        d = x - mu
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(dens[0] - dens[1])), atol=1e-9)
    assert quality.fit([np.zeros((4, 4)), aug[1].T @ aug[1]]).score(x)[0] > 0.99


def test_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 9.0), (1, "", 9.0), (None, "a b", 9.0), (2, "you idiot " * 40_000, 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, y int")
    for make in (quality.score_documents, toxicity.score_documents):
        got = make(df, none).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
        assert make(df.limit(0), none).count() == 0


def accuracy(spark, name, label):
    got = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").where("held_out").collect()
    return np.mean([r.predicted == r[label] for r in got]), got


def test_held_out_quality(spark):
    acc, _ = accuracy(spark, "op1_quality", "quality")
    assert acc >= 0.95


def test_held_out_toxicity(spark):
    acc, _ = accuracy(spark, "op9_toxicity", "toxic")
    assert acc >= 0.94


def test_counterfactuals_lower_bias(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta omega sigma kappa".split())
    rows, known = [], []
    for i in range(600):
        bad = i % 3 == 0
        w = [word() for _ in range(12)] + (["awful"] if bad and i % 2 else []) + (["gay"] if bad and rng.random() < 0.7 or rng.random() < 0.02 else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        known.append((i, int(bad)))
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, y int")
    fair, none = toxicity.train(df, y), toxicity.train(df, y, identity_terms=())
    neutral = ["alpha beta gay gamma", "alpha beta straight gamma", "alpha beta gamma"]
    a, b = fair.logits(neutral), none.logits(neutral)
    assert abs(a[0] - a[2]) < 0.35 * abs(b[0] - b[2]) and abs(a[0] - a[1]) < 0.35 * abs(b[0] - b[1])
    assert fair.score(["alpha awful beta"])[0] > fair.score(["alpha beta"])[0]
