"""Documents reach Python in small batches."""

import corpus_pipeline
from convgraph.functions import lineage

SF = "/root/testdata/sf0.001"


def test_toxic_documents_are_scored_in_small_batches(spark, monkeypatch):
    cut, seen = corpus_pipeline.cut_lineage, []
    monkeypatch.setattr(corpus_pipeline, "cut_lineage", lambda df: seen.append(spark.conf.get(lineage.BATCH, None)) or cut(df))
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), spark.conf.get(lineage.BATCH, None)
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert seen == [str(corpus_pipeline.ROWS)] and kept.columns == docs.columns
    assert 0 < kept.count() <= docs.count()
    assert spark.conf.get(lineage.BATCH, None) == before
