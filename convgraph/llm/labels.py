"""Labels for the learned scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convgraph.llm.common import id_remainder

FOLDS, HELD_OUT = 3, 1  # fixed values: rows with crc32(id) mod 3 = 1 are never learned from


def training_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, y) to learn from: not held out, label 0 or 1, and no contradiction among repeated ids."""
    ok = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    ok = ok.where(id_remainder("doc_id", FOLDS) != HELD_OUT)
    return ok.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_z")).where("y = _z").drop("_z")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(id_remainder(doc_id, FOLDS) == HELD_OUT, F.lit(False))
