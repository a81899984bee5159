"""Selection caches: JSON objects of ``"sid|budget" -> [turn ids]`` entries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage


def parse_selection_cache(lines: DataFrame) -> DataFrame:
    """``lines(value, priority)`` -> (scenario_id, budget, selected, matched_budget).

    An entry of a higher priority replaces the same entry of a lower one.  An
    entry named ``sid|matched_budget`` holds a number instead of turn ids.
    """
    entries = lines.select("priority", F.explode(F.from_json("value", "map<string,string>")).alias("_k", "_v"))
    last = entries.groupBy("_k").agg(F.max_by("_v", "priority").alias("_v"))
    name = F.regexp_extract("_k", r"^(.*)\|([^|]*)$", 2)
    return last.select(
        F.regexp_extract("_k", r"^(.*)\|([^|]*)$", 1).alias("scenario_id"),
        F.expr("try_cast(regexp_extract(_k, '[^|]*$', 0) as bigint)").alias("budget"),
        F.when(name != "matched_budget", F.from_json("_v", "array<string>")).alias("selected"),
        F.when(name == "matched_budget", F.expr("try_cast(_v as bigint)")).alias("matched_budget"))


def read_selection_cache(spark: SparkSession, *paths: str) -> DataFrame:
    """Later paths overlay earlier ones."""
    parts = [spark.read.text(p, wholetext=True).withColumn("priority", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return parse_selection_cache(out)


def read_cache_folder(spark: SparkSession, path: str) -> DataFrame:
    """A cache that ``update_selection_cache`` wrote: one JSON object per line, any number of files."""
    return parse_selection_cache(spark.read.text(path).withColumn("priority", F.lit(0)))


def cached_keys(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, budget) of a cache folder; an absent one is empty."""
    try:
        rows = read_cache_folder(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], "scenario_id string, budget bigint")
    return rows.where("selected is not null").select("scenario_id", "budget")


def update_selection_cache(turns: DataFrame, budgets: Sequence[int], choose: Callable[[DataFrame, Sequence[int]], DataFrame], path: str) -> int:
    """Add the selections of all conversations x budgets that a cache folder lacks; the number of keys added.

    ``choose(turns, budgets)`` gives (sid, budget, idx).  Only conversations with a missing key are given to it, and only
    missing keys are written, one JSON object per line, in files added to the folder: what is there is never rewritten,
    and a run that stops half way leaves whole files.  A key whose selection is empty is kept with an empty list.
    """
    spark = turns.sparkSession
    b = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in budgets]))
    wanted = turns.select("sid").distinct().select("sid", F.col("sid").cast("string").alias("scenario_id"), b.alias("budget"))
    pending = cut_lineage(wanted.join(cached_keys(spark, path), ["scenario_id", "budget"], "left_anti"))
    n = pending.count()
    if n:
        some = turns.join(pending.select("sid").distinct(), "sid", "left_semi")
        ids = choose(some, budgets).groupBy("sid", F.col("budget").cast("bigint").alias("budget")).agg(F.sort_array(F.collect_list("idx")).alias("ids"))
        rows = pending.join(ids, ["sid", "budget"], "left").select(
            F.concat_ws("|", "scenario_id", F.col("budget").cast("string")).alias("k"), F.coalesce(F.transform("ids", lambda x: x.cast("string")), F.array().cast("array<string>")).alias("v"))
        rows.select(F.to_json(F.create_map("k", "v")).alias("value")).write.mode("append").text(path)
    return n
