import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convgraph.llm import covertree, queries, sketch

SF = "/root/testdata/sf0.001"


def check_edits(rows, got):
    def tie(r):
        return (-(r[0] if r[0] is not None else -(2**63)),)

    order = sorted(rows, key=tie)
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)


@pytest.mark.parametrize("per_range", [1, 3, 512])
def test_edited_texts(spark, monkeypatch, tmp_path, per_range):
    monkeypatch.setattr(sketch, "ROWS_PER_RANGE", per_range)
    rng = random.Random(per_range)
    rows = [(i * 7 - 50, "".join(rng.choice("ab cé🙂\n") for _ in range(rng.randint(0, 60)))) for i in rng.sample(range(200), 41)] + [(None, "null id"), (2**60, None), (-5_000, "word " * 30_000)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sketch int").write.parquet(str(tmp_path / "documents.parquet"))
    check_edits(rows, queries.QUERIES["op8_sketch"](spark, str(tmp_path)).collect())


def test_small_tables(spark, tmp_path):
    for k, rows in enumerate([[], [(1, "abcd")], [(1, None)], [(None, "x")]]):
        p = tmp_path / str(k)
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(p / "documents.parquet"))
        check_edits(rows, queries.QUERIES["op8_sketch"](spark, str(p)).collect())


def values(fingerprint):
    return {fingerprint[i:i + 6] for i in range(0, len(fingerprint), 6)}


def alike(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else float(a == b)


def test_likeness_is_that_of_the_printed_fingerprints(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op8_sketch"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_edits(list(texts.items()), got.values())
    order = sorted(texts, reverse=True)
    grams = lambda t: set(zip(*[t.lower().split()[i:] for i in range(5)]))
    off, by_text = [], {}
    for k, i in enumerate(order):
        r, nxt = got[i], order[(k + 1) % len(order)]
        assert r.near_edited == pytest.approx(alike(values(r.fingerprint), values(r.edited_fingerprint)), abs=0)
        assert r.near_next == pytest.approx(alike(values(r.fingerprint), values(got[nxt].fingerprint)), abs=0)
        assert len(values(r.fingerprint)) * 6 == len(r.fingerprint)
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint
        t = texts[i]
        a, b = grams(t), grams(t[:len(t) - len(t) // 2] + texts[nxt][:len(t) // 2])
        if min(len(a), len(b)) > 400:
            off.append(r.near_edited - len(a & b) / min(len(a), len(b)))
    assert abs(np.mean(off)) < 0.05 and np.std(off) < 0.1
    assert sum(len(r.fingerprint) for r in got.values()) < 0.1 * sum(map(len, texts.values()))


def test_merge_and_containment(spark):
    words = [f"w{i}" for i in range(6000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:600]), " ".join(words[4000:]), "")], "a string, b string, c string, d string")
    for c in "abcd":
        df = sketch.with_sketch(df, c, f"s{c}")
    a, b, c, d = (F.col(f"s{x}") for x in "abcd")
    r = df.select(sketch.containment(b, a).alias("in_a"), sketch.containment(a, b).alias("a_in"), sketch.likeness(b, c).alias("bc"), (sketch.merge(a, c) == a).alias("sub"),
                  F.size(a).alias("n"), sketch.likeness(a, d).alias("ad"), sketch.likeness(d, d).alias("dd"), sketch.containment(d, a).alias("da")).first()
    assert r.in_a == 1.0 and abs(r.a_in - 0.1) < 0.06 and r.bc == 0.0 and r.sub
    assert abs(r.n - 6000 / 12) < 90 and (r.ad, r.dd, r.da) == (0.0, 1.0, 0.0)


def test_short_texts_estimate_without_bias(spark):
    """A twelfth of the shingles of a short text is few, but over many texts the shares add up, and nothing is null."""
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n)) for n in range(1, 41) for _ in range(12)]
    df = spark.createDataFrame([(i, t, " ".join(texts[i % 7::7])) for i, t in enumerate(texts)], "doc_id long, a string, b string")
    for c in "ab":
        df = sketch.with_sketch(df, c, f"s{c}")
    a, b = F.col("sa"), F.col("sb")
    got = df.select(sketch.containment(a, b).alias("inside"), sketch.likeness(a, b).alias("near"), F.size("sa").alias("n"), F.size(F.split("a", " ")).alias("words")).collect()
    whole = [r for r in got if r.words >= 5]
    assert all(r.inside == float(r.n > 0) == r.near for r in whole)
    assert sum(r.n for r in whole) / sum(r.words - 4 for r in whole) == pytest.approx(1 / 12, rel=0.15)


def brute(rows, cosine):
    def good(r):
        return r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    link = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    link[i].append(j)
                    link[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in link[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[i][0], len(link[i]), comp, rows[i][0] is not None and rows[i][0] == comp))
    return sorted(map(str, out))


def sample(seed, n, dim=6, labels=3):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    while len(rows) < n:
        v = rng.normal(size=dim)
        for _ in range(rng.integers(1, 6)):
            rows.append((k, (v + rng.normal(size=dim) * 0.12).tolist(), int(rng.integers(labels))))
            k += 1
    return rows[:n]


@pytest.mark.parametrize("cell", [40, 2048])
def test_cover_tree_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(covertree, "CELL", cell)
    rows = sample(cell, 220)
    v = rows[0][1]
    rows += [(1000 + i, v, rows[0][2]) for i in range(30)] + [(2000, None, 1), (2001, [0.0] * 6, 1), (2002, v, None), (2003, [float("nan")] + v[1:], 1), (2004, [None] + v[1:], 1),
             (2005, [], 1), (2006, v[:3], rows[0][2]), (2007, v[:3], rows[0][2]), (None, v, rows[0][2]), (2008, [x * 1e-200 for x in v], rows[0][2]), (2009, [x * 1e200 for x in v], rows[0][2]), (5, v, rows[0][2]), (5, v, rows[0][2]), (2010, [float("inf")] + v[1:], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n int")
    got = covertree.near_duplicates(df, cosine=0.93).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == brute(rows, 0.93)


def test_cover_tree_of_nothing(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_tree_invariants():
    x = np.random.default_rng(3).normal(size=(300, 4))
    t = covertree.Tree(x / np.linalg.norm(x, axis=1, keepdims=True))
    for node, kids in enumerate(t.children):
        assert t.far[t.centre[node], t.members[node]].max() == t.radius[node]
        if kids:
            assert t.centre[node] in [t.centre[k] for k in kids]
            assert sorted(np.concatenate([t.members[k] for k in kids])) == sorted(t.members[node])


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.QUERIES["op7_cover_tree"](spark, SF).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == brute(rows, 0.93)
