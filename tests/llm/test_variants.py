"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convgraph.llm import fmindex, variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, ratio=5):
    form, n_near = {}, {}
    for w, n in counts.items():
        others = [(-m, v) for v, m in counts.items() if near(w, v)]
        n_near[w] = len(others)
        best = min(others, default=(0, None))
        form[w] = best[1] if others and -best[0] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], counts.get(form[w])))
    return out


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé\U0001f600", min_size=1, max_size=7), min_size=1, max_size=40), st.lists(st.text("abéz", max_size=7), max_size=20, unique=True))
def test_the_two_schemes_find_each_pair_once(words, extra):
    words = sorted(words)
    queries = sorted(set(words) | set(extra))
    index = fmindex.WordIndex(words)
    got = [(queries[q], words[w]) for forward in (True, False) for q, w in zip(*index.neighbours(queries, forward))]
    assert sorted(got) == sorted((q, w) for q in queries for w in words if near(q, w))


def grouped(spark, counts, **kw):
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return {tuple(r) for r in variants.group_variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_many_shards_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(variants, "SHARD", 40)
    monkeypatch.setattr(variants, "SPLIT", 7)  # a third of the words share one key
    rng = random.Random(3)
    words = {"same" + "".join(rng.choice("xyz") for _ in range(rng.randint(2, 6))) for _ in range(150)}
    words |= {"".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(200)}
    counts = {w: 5 * 6 ** rng.randint(0, 4) for w in sorted(words)}
    assert grouped(spark, counts) == plain(counts)


def test_ties_chains_and_the_ratio(spark):
    counts = {"letter": 10000, "lettar": 1000, "littar": 100, "letters": 10000, "letterz": 2001, "zzzzzz": 5, "zzzzzza": 25, "zzzzzzb": 25, "y" * 3000: 5, "y" * 2999: 30}
    got = {r[0]: r for r in grouped(spark, counts)}
    assert set(got.values()) == plain(counts)
    assert got["littar"][2] == "letter" and got["letterz"][1] is None and got["zzzzzz"][1] == "zzzzzza"


SCHEMA = "doc_id bigint, text string, word string, n int, key string"


def of_documents(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], SCHEMA)
    return {tuple(r) for r in variants.document_variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_documents_with_lost_letters(spark):
    rng = random.Random(5)
    words = ["Country", "countryÉ", "Élégant", "straße×", "number", "short", "numbers"]
    rows = [(None if i % 9 == 0 else i, " ".join(rng.choice(words) + rng.choice(["", ".", "-x"]) for _ in range(40))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "123 !"), (3, rows[3][1]), (600, "country " * 20000)]
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 7 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    want = plain({w: n for w, n in counts.items() if n >= 5})
    assert of_documents(spark, rows, every=7) == want and any(r[1] for r in want)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a few words")]])
def test_nothing_to_group(spark, rows):
    assert of_documents(spark, rows) == set()
