import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from convgraph.llm import mixing, packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash", "clash") for i, t, s in rows], DOCS)


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 9, 40, 40, 40, 300]))), rng.choice(["a", "b", "b", "b", "b", "c", None, "d"])) for i in range(900)]
    rows += [(5, "x y z", "e"), (5, "x y z", "e"), (None, None, "a"), (7, "one", "f")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight, total, target, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(size.values()), {}, set()
    while True:  # plain resharing, round by round
        rest = total - sum(3 * size[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 3 * size[s]}
        if not over:
            target = {**share, **{s: 3.0 * size[s] for s in capped}}
            break
        capped |= over
    key = {s: (size[s], round(target[s], 6)) for s in names}
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[(r.source_size, round(r.target, 6))] += r.taken
    assert set(taken) == set(key.values())
    for s in names:
        assert abs(taken[key[s]] - target[s]) <= max(1.0, 0.002 * target[s])
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert {(r.size, r.taken) for r in mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).collect()} == {(0, 0)}


def test_repeat_documents(spark):
    df = spark.createDataFrame([(1, 0), (2, 3)], "doc_id long, copies long")
    assert [r.doc_id for r in mixing.repeat_documents(df).collect()] == [2, 2, 2]


def slow_best_fit(lengths, window):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in left if r >= n]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - n)
        else:
            left.append(window - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(12))
def test_grouped_best_fit_equals_one_by_one(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 30, 64])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 400))]
    counts = Counter(lengths)
    moves = packing.best_fit_decreasing(counts, window)
    seen, fill = defaultdict(list), defaultdict(list)
    for length, rank, n, first, per, offset in moves:
        for i in range(n):
            seen[length].append(rank + i)
            fill[first + i // per].append((offset + i % per * length, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(c)) for k, c in counts.items()}
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
    assert sorted(fill) == list(range(len(fill)))
    assert sorted(window - sum(n for _, n in p) for p in fill.values()) == slow_best_fit(lengths, window)


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    bpe, lib, rng = packing.ByteBpe(path), Tokenizer.from_file(path), random.Random(1)
    assert bpe.exact
    parts = ["the", "Der", "ñandú", " ", "  ", "\n", "\r\n", "\t", "!!", "don't", "it's", "123", "é", "中文", "🙂", "<|endoftext|>", "\u00a0", "\u2003", "a_b", "'s", "\x1c", "\x85", "—", ""]
    for _ in range(1500):
        t = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))
        assert bpe.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t
    # many texts at once
    texts = [t for t in ("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 12))) for _ in range(1500)) if bpe.by_chunks(t)]
    ids, n = bpe.encode_together(texts, 7)
    at = np.cumsum(n)
    assert len(texts) > 60 and [x.tolist() for x in np.split(ids, at[:-1])] == [lib.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_large_ids_beside_null_ids(spark):
    ids = [2**53 + 1, None, -(2**62) - 1, 9007199254740995]
    rows = [(i, "some text", "s") for i in ids] + [(2**53 + 1, "two  spaces", "s")]
    got = packing.pack(docs(spark, rows).coalesce(1), packing.default_tokenizer()).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (i for i, *_ in rows)))


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "word " * 3000, "s"), (None, "x", "s")] + [(10 + i, "some text " * (i * 7 % 90), "s") for i in range(60)]
    got = packing.pack(docs(spark, rows), packing.default_tokenizer(), window=256).collect()
    made = Counter()
    by_doc = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 256
        by_doc[r.doc_id].append(r)
    for key, parts in by_doc.items():
        want = [lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in rows if i == key]
        if len(want) == 1:
            ids = [x for p in sorted(parts, key=lambda p: p.start) for x in np.frombuffer(p.ids, dtype="<u4").tolist()]
            assert ids == want[0] and all(p.doc_tokens == len(ids) for p in parts)
        made[key] += len(parts)
    seqs = {r.sequence_id: r for r in packing.sequences(packing.pack(docs(spark, rows), packing.default_tokenizer(), window=256)).collect()}
    for s, r in seqs.items():
        parts = sorted((p for p in got if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
        assert r.length == sum(p.length for p in parts) <= 256 and len(r.ids) == 4 * r.length
    assert packing.pack(docs(spark, []), packing.default_tokenizer()).count() == 0


def test_packing_query_is_whole_and_tight(spark):
    got = queries.QUERIES["op5_packing"](spark, SF)
    sums = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert all(r.n == r.d for r in sums) and len(sums) == spark.read.parquet(f"{SF}/documents.parquet").count()
    seqs = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padded = sum(0 if r.n & (r.n - 1) == 0 else 1024 - r.n for r in seqs)
    assert padded / sum(r.n for r in seqs) < 0.02
    row = got.where("doc_tokens <= 1024").first()
    from tokenizers import Tokenizer

    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    ids = Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids + [0]
    assert row.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
