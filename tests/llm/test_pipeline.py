import re

import numpy as np

import corpus_pipeline as pipe
from convgraph.llm import labels, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, SF)
        if k < len(pipe.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs.collect())

    before, after = kept["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels.training_labels(spark.read.parquet(f"{SF}/labels.parquet"), "toxic"))
    score = model.score([r.text for r in before])
    assert sorted(r.doc_id for r, s in zip(before, score) if s < 0.7) == sorted(r.doc_id for r in after)

    before, after = kept["near_copies"]
    grams = [set(simhash.shingle_hashes(r.text, 5).tolist()) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if not grams[i] | grams[j] or len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                root[find(i)] = find(j)
    left = {r.doc_id for r in after}
    classes = {}
    for i, r in enumerate(before):
        classes.setdefault(find(i), set()).add(r.doc_id)
    assert all(len(c & left) == 1 for c in classes.values())

    before, after = kept["secrets"]
    pattern = r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}"
    want = {r.doc_id: re.sub(pattern, "[SECRET]", r.text) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)

    before, after = kept["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    times = {i: sum(r.doc_id == i for r in after) for i in {r.doc_id for r in after}}
    assert max(times.values()) <= 3
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(after) - size(before)) < 0.1 * size(before)

    before, after = kept["packing"]
    from tokenizers import Tokenizer

    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == want == sum(len(np.frombuffer(r.ids, dtype="<u4")) for r in after)


def test_odd_documents_pass_all_stages(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x y z", "en", "a", 5), (3, "word " * 30_000, "en", None, 9), (4, " \n", "en", "b", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, r in enumerate((rows, [])):
        d = tmp_path / str(k)
        spark.createDataFrame(r, schema).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        got = pipe.run(spark, str(d)).collect()
        assert bool(got) == bool(r)


def test_columns_of_any_name_pass_all_stages(spark, tmp_path):
    names = ["_found", "_between", "_judged", "_toxic", "_rid", "findings", "rid", "row", "toxic", "same", "size", "rank", "copy", "a b.c"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, f"text of document number {i} with some words of its own {i * i}", "en", "web", 1, *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(pipe.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        got = docs.collect()
        assert got and all([r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] for r in got), name
    assert pipe.pack_sequences(spark, docs, str(tmp_path)).count() >= len(got)
