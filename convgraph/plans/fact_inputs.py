"""Answer, verdict and checklist-item logs derived from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convgraph.operators import facts
from convgraph.plans.inputs import NEEDS, VIEWS, table

ARMS = {"1-URGENT": "full_history", "2-HIGH": "oracle_dag", "3-MEDIUM": "oracle_tree",
        "4-NOT SPECIFIED": "candidate_oracle@15", "5-LOW": "semantic_retrieval@1024"}
MODELS = ("F", "O", "P")
JUDGES = ("alpha", "beta", "gamma")

_LABEL_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ARMS.items()) + " END"


def answers_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answer log; the same key occurs several times."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    label = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(v)) for p, v in ARMS.items()])
    return o.select(
        F.concat_ws("|", F.col("o_custkey").cast("string"), label, F.lit("-"), "o_orderstatus").alias("key"),
        F.col("o_custkey").alias("scenario_id"), F.concat(F.lit("family_"), F.col("o_custkey") % 13).alias("family"),
        label.alias("method_label"), F.col("o_orderstatus").alias("model_key"),
        (300 + (k * 31) % 1500).alias("context_tokens"), (50 + (k * 7) % 400).alias("output_tokens"),
        (((k * 11) % 101) / F.lit(100.0)).alias("context_precision"),
        (((k * 17) % 101) / F.lit(100.0)).alias("irrelevant_context_ratio"),
        F.when(k % 4 == 0, 0).otherwise(1).cast("bigint").alias("context_sufficiency"),
        F.when(k % 6 == 0, 1).otherwise(0).cast("bigint").alias("recall_fallback"),
        F.array(F.col("o_custkey") % 3, k % 2).alias("selected"),
        F.round(F.col("o_totalprice") / 1e7, 6).alias("usd"),
        F.when(k % 8 == 0, F.lit("I cannot verify that part."))
        .when(k % 9 == 0, F.lit("This was MADE UP earlier.")).otherwise(F.lit("The plan holds.")).alias("response"),
        F.concat(F.lit("prompt "), F.col("o_custkey").cast("string"), F.lit(" "),
                 F.when(k % 3 == 0, k).otherwise(F.lit(0)).cast("string")).alias("prompt"),
        F.when(k % 10 == 0, F.concat_ws("|", F.col("o_custkey").cast("string"), F.lit("full_history"), F.lit("-"),
                                        "o_orderstatus")).alias("copied_from"),
        F.coalesce(*[F.when(k % 3 == i, F.lit(v)) for i, v in enumerate(("base", "30", "60"))]).alias("length"),
        F.col("o_orderdate").alias("ts"), k.alias("tie"))


def verdict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw verdicts of two judges; some answers have none, some scores are NULL."""
    a = answers_log(spark, sf_dir).select("key", "tie", "ts", "usd")
    k = F.col("tie")
    judge = F.explode(F.array(F.lit("ref"), F.lit("alt"))).alias("judge_model")
    v = a.select("*", judge)
    ref = F.col("judge_model") == "ref"
    v = v.where((ref & (k % 7 != 0)) | (~ref & (k % 5 != 0)))
    score = F.when(ref, F.when(k % 17 != 0, ((k * 13) % 5) / F.lit(4.0))).otherwise(((k * 29) % 7) / F.lit(6.0))
    return v.select(
        "key", "judge_model", score.alias("checklist_score"),
        F.when(k % 13 != 0, F.when(k % F.when(ref, 6).otherwise(4) == 0, 1).otherwise(0)).cast("bigint").alias("distractor_leakage"),
        F.when(k % 3 == 0, F.lit("east")).when(k % 11 == 0, F.lit(None)).otherwise(F.lit("west")).alias("judge_route"),
        F.when(k % 19 == 0, F.lit("fallback")).otherwise(F.lit("primary")).alias("judge_prompt_variant"),
        (F.col("usd") / 10).alias("usd"), F.when(k % 10 == 0, F.lit("x")).alias("copied_from"), "ts", "tie")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.last_by_key(answers_log(spark, sf_dir), ["key"], ["ts", "tie"])


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.first_by_key(verdict_log(spark, sf_dir), ["key", "judge_model"], ["ts", "tie"])


def facts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last answer per key with the first verdict of both judges."""
    v = facts.side_by_side(verdict_log(spark, sf_dir), {"ref": "", "alt": "_alt"}, ["checklist_score", "distractor_leakage"], ["ts", "tie"])
    return answers(spark, sf_dir).join(v, "key", "left")


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per checklist item of an answer, with the reference verdict."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("bigint").alias("item"), "l_partkey", "l_suppkey",
        "l_extendedprice", (F.col("l_returnflag") != "R").alias("satisfied"),
        (F.col("l_linestatus") == "O").alias("other"))
    one = facts.first_by_key(li, ["key", "item"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return one.withColumn("required", F.col("item") <= 4)


def candidate_items(log: DataFrame) -> DataFrame:
    """Verdicts of three candidate judges on the same items; some items are missing."""
    p = F.col("l_partkey")
    each = F.array(
        F.struct(F.lit("alpha").alias("judge"), F.col("other").alias("satisfied")),
        *[F.struct(F.lit(j).alias("judge"),
                   F.when(p % m == 0, ~F.col("satisfied")).otherwise(F.col("satisfied")).alias("satisfied"))
          for j, m in (("beta", 10), ("gamma", 25))])
    return log.where("l_suppkey % 20 <> 0").select("key", "item", F.inline(each))


def judged_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the answers the items belong to: (key, scenario_id, family, method_label, model_key)."""
    o = table(spark, sf_dir, "orders")
    label = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(v)) for p, v in ARMS.items()])
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("scenario_id"),
                    F.concat(F.lit("family_"), F.col("o_custkey") % 13).alias("family"), label.alias("method_label"),
                    F.col("o_orderstatus").alias("model_key"))


VIEWS.update({
    "alog": f"""
      SELECT concat_ws('|', o_custkey, {_LABEL_SQL}, '-', o_orderstatus) AS key, o_custkey AS scenario_id,
        concat('family_', o_custkey % 13) AS family, {_LABEL_SQL} AS method_label, o_orderstatus AS model_key,
        300 + (o_orderkey * 31) % 1500 AS context_tokens, 50 + (o_orderkey * 7) % 400 AS output_tokens,
        CAST((o_orderkey * 11) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS context_precision,
        CAST((o_orderkey * 17) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS irrelevant_context_ratio,
        CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS context_sufficiency,
        CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS recall_fallback,
        concat(o_custkey % 3, '/', o_orderkey % 2) AS selected,
        round(o_totalprice / CAST(10000000 AS DOUBLE), 6) AS usd,
        CASE WHEN o_orderkey % 8 = 0 THEN 'I cannot verify that part.'
             WHEN o_orderkey % 9 = 0 THEN 'This was MADE UP earlier.' ELSE 'The plan holds.' END AS response,
        concat('prompt ', o_custkey, ' ', CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 0 END) AS prompt,
        CASE WHEN o_orderkey % 10 = 0 THEN concat_ws('|', o_custkey, 'full_history', '-', o_orderstatus) END AS copied_from,
        CASE o_orderkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN '30' ELSE '60' END AS length,
        o_orderdate AS ts, o_orderkey AS tie
      FROM orders""",
    "vlog": """
      SELECT key, judge_model,
        CASE WHEN judge_model = 'ref' THEN CASE WHEN tie % 17 <> 0 THEN CAST((tie * 13) % 5 AS DOUBLE) / CAST(4 AS DOUBLE) END
             ELSE CAST((tie * 29) % 7 AS DOUBLE) / CAST(6 AS DOUBLE) END AS checklist_score,
        CASE WHEN tie % 13 <> 0 THEN CASE WHEN tie % (CASE WHEN judge_model = 'ref' THEN 6 ELSE 4 END) = 0
             THEN 1 ELSE 0 END END AS distractor_leakage,
        CASE WHEN tie % 3 = 0 THEN 'east' WHEN tie % 11 = 0 THEN NULL ELSE 'west' END AS judge_route,
        CASE WHEN tie % 19 = 0 THEN 'fallback' ELSE 'primary' END AS judge_prompt_variant,
        usd / CAST(10 AS DOUBLE) AS usd, CASE WHEN tie % 10 = 0 THEN 'x' END AS copied_from, ts, tie
      FROM alog CROSS JOIN (VALUES ('ref'), ('alt')) j(judge_model)
      WHERE (judge_model = 'ref' AND tie % 7 <> 0) OR (judge_model = 'alt' AND tie % 5 <> 0)""",
    "ans": """
      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, tie DESC) AS rn FROM alog) x
      WHERE rn = 1""",
    "ver": """
      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key, judge_model ORDER BY ts, tie) AS rn FROM vlog) x
      WHERE rn = 1""",
    "facts": """
      SELECT a.*, r.checklist_score, r.distractor_leakage, l.checklist_score AS checklist_score_alt,
             l.distractor_leakage AS distractor_leakage_alt
      FROM ans a LEFT JOIN ver r ON r.key = a.key AND r.judge_model = 'ref'
      LEFT JOIN ver l ON l.key = a.key AND l.judge_model = 'alt'""",
    "ilog": """
      SELECT * EXCLUDE (rn), item <= 4 AS required FROM (
        SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS item, l_partkey, l_suppkey,
               l_returnflag <> 'R' AS satisfied, l_linestatus = 'O' AS other,
               row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn
        FROM lineitem) x WHERE rn = 1""",
    "cand": """
      SELECT key, item, 'alpha' AS judge, other AS satisfied FROM ilog WHERE l_suppkey % 20 <> 0
      UNION ALL SELECT key, item, 'beta', CASE WHEN l_partkey % 10 = 0 THEN NOT satisfied ELSE satisfied END
      FROM ilog WHERE l_suppkey % 20 <> 0
      UNION ALL SELECT key, item, 'gamma', CASE WHEN l_partkey % 25 = 0 THEN NOT satisfied ELSE satisfied END
      FROM ilog WHERE l_suppkey % 20 <> 0""",
    "aligned": """
      SELECT j.key, j.judge, i.item, i.satisfied AS ref, coalesce(c.satisfied, false) AS cand
      FROM (SELECT DISTINCT key, judge FROM cand) j JOIN ilog i ON i.key = j.key AND i.required
      LEFT JOIN cand c ON c.key = j.key AND c.judge = j.judge AND c.item = i.item""",
    "inst": f"""
      SELECT o_orderkey AS key, o_custkey AS scenario_id, concat('family_', o_custkey % 13) AS family,
             {_LABEL_SQL} AS method_label, o_orderstatus AS model_key FROM orders""",
    "iscore": """
      SELECT a.judge, a.key, any_value(i.scenario_id) AS scenario_id, any_value(i.family) AS family,
             any_value(i.method_label) AS method_label, any_value(i.model_key) AS model_key,
             avg(CAST(ref AS INT)) AS ref_score, avg(CAST(cand AS INT)) AS cand_score
      FROM aligned a JOIN inst i ON i.key = a.key GROUP BY a.judge, a.key""",
})
NEEDS.update({"vlog": ("alog",), "ans": ("alog",), "ver": ("vlog",), "facts": ("ans", "ver"), "cand": ("ilog",),
              "aligned": ("cand", "ilog"), "iscore": ("aligned", "inst")})
