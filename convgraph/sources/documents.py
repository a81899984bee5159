"""Scenario documents and sidecars: one JSON object per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convgraph.sources.schemas import SCENARIO


def read_documents(spark: SparkSession, path: str, schema: str | StructType, lines: bool = False) -> DataFrame:
    """Documents with the keys of ``schema``; unknown keys are ignored, missing ones NULL.

    A file is one document, or with ``lines`` one document per line, as ``write_scenarios`` writes them.
    """
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def with_defaults(scenarios: DataFrame) -> DataFrame:
    """Values older documents leave out."""
    no_ids = F.array().cast("array<string>")
    turns = F.transform("turns", lambda t: F.struct(
        t["turn_id"].alias("turn_id"), t["turn_index"].alias("turn_index"), t["user_message"].alias("user_message"),
        t["assistant_message"].alias("assistant_message"), F.coalesce(t["gold_parents"], no_ids).alias("gold_parents"),
        F.coalesce(t["stale"], F.lit(False)).alias("stale"), t["superseded_by"].alias("superseded_by")))
    items = F.transform("answer_checklist", lambda c: F.struct(
        c["id"].alias("id"), c["criterion"].alias("criterion"), F.coalesce(c["required"], F.lit(True)).alias("required")))
    return scenarios.withColumns({
        "benchmark_version": F.coalesce("benchmark_version", F.lit("1.0")), "notes": F.coalesce("notes", F.lit("")),
        "turns": turns, "answer_checklist": items, "evidence_turn_ids": F.coalesce("evidence_turn_ids", no_ids),
        "distractor_turn_ids": F.coalesce("distractor_turn_ids", no_ids)})


def read_scenarios(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """All scenarios of a folder.  Order, where it matters, is by ``scenario_id``."""
    return with_defaults(read_documents(spark, path, SCENARIO, lines))


def write_scenarios(scenarios: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line, in a folder per benchmark version."""
    scenarios.write.mode(mode).partitionBy("benchmark_version").json(path)


def explode_turns(scenarios: DataFrame, cost) -> tuple[DataFrame, DataFrame]:
    """Long tables of the graph operators: turns and edges.

    ``cost`` maps a turn column to its token cost.
    """
    t = scenarios.select(
        F.col("scenario_id").alias("sid"), "family", F.size("turns").cast("bigint").alias("_n"), F.posexplode("turns").alias("_p", "t"))
    turns = t.select("sid", "family", F.col("_p").cast("bigint").alias("idx"), (F.col("_n") - 1 - F.col("_p")).alias("rev"),
                     "t.turn_id", cost(F.col("t")).alias("cost"), "t.stale", "t.superseded_by")
    at = scenarios.select(F.col("scenario_id").alias("sid"), F.posexplode("turns").alias("_p", "t")).select(
        "sid", F.col("t.turn_id").alias("_id"), F.col("_p").cast("bigint").alias("parent"))
    e = t.select("sid", F.col("_p").cast("bigint").alias("child"), F.posexplode("t.gold_parents").alias("pos", "_id"))
    return turns, e.join(at, ["sid", "_id"]).select("sid", "child", "parent", "pos")


def read_sidecars(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Sidecars, one JSON document of any number of lines per file, with the file's ``name`` (without folder and ending)."""
    d = read_documents(spark, path, schema)
    return d.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("name"), *d.columns)
