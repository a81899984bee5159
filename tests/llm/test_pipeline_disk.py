"""Stages leave texts where they lie: what they write is narrow, and lists of any length pick rows without a shuffle."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from convgraph.functions import lineage
from convgraph.llm import common, packing


def _written(spark):
    return sum(p.stat().st_size for p in Path(lineage.shared_dir(spark).removeprefix("file://")).rglob("*.parquet"))


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies])
def test_texts_are_not_written_again(spark, tmp_path, stage):
    rng = random.Random(4)
    rows = [(i % 900, " ".join(f"{rng.getrandbits(40):x}" for _ in range(100))) for i in range(1000)]
    spark.createDataFrame([*rows, *rows[:30], (None, None)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    size, before = sum(p.stat().st_size for p in tmp_path.glob("documents/*.parquet")), _written(spark)
    kept = stage(spark, spark.read.parquet(str(tmp_path / "documents")), str(tmp_path))
    assert kept.count() == (1031 if stage is corpus_pipeline.drop_toxic else 1001)
    assert _written(spark) - before < size / 4


def test_long_lists_of_ids_pick_rows_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(common, "IDS", 2)
    ids = [0, 7, 8, 32767, 32768, (5 << 33) + 31, (5 << 33) + 70_000, -1, -32_769]
    rows = spark.createDataFrame([(i + d, f"t{i + d}") for i in ids for d in (0, 1, 9) for _ in range(2)] + [(None, "none")], "rid long, text string")
    want = sorted(r.text for r in rows.collect() if r.rid in ids)
    some = lineage.cut_lineage(spark.createDataFrame([(i,) for i in ids], "rid long"))
    got = common.among(rows, some, "rid")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and got.columns == rows.columns
    assert sorted(r.text for r in got.collect()) == want
    monkeypatch.setattr(common, "BLOCKS", 1)  # scattered ids
    assert sorted(r.text for r in common.among(rows, some, "rid").collect()) == want


def test_numbers_of_rows_stay(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for df in (read, read.where("id % 3 = 0"), read.limit(0)):
        d = common.numbered(df, F.struct("id").alias("row"))
        first = {r.row.id: r.rid for r in d.collect()}
        with lineage.setting(spark, "spark.sql.files.maxPartitionBytes", "100"):
            assert {r.row.id: r.rid for r in d.select("rid", "row").collect()} == first
        assert len(set(first.values())) == len(first) == df.count()


def test_documents_are_encoded_in_small_batches(spark, monkeypatch):
    cut, seen = packing.cut_lineage, []
    monkeypatch.setattr(packing, "cut_lineage", lambda df: seen.append(spark.conf.get(lineage.BATCH, None)) or cut(df))
    docs, before = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.conf.get(lineage.BATCH, None)
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 2
    assert seen == [str(corpus_pipeline.ROWS)] and spark.conf.get(lineage.BATCH, None) == before
