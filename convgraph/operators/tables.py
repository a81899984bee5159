"""Result tables over facts: grouped means, pivots, shares and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convgraph.functions.splitwin import split_percentile


def summary(facts: DataFrame, by: Sequence[str], metrics: Sequence[str], scored: str = "checklist_score") -> DataFrame:
    """Means, row count and number scored per group."""
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(scored).alias("n_scored"), *[F.avg(m).alias(m) for m in metrics])


def with_median(table: DataFrame, facts: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    med = split_percentile(facts, by, value, {out: 0.5}, F.floor(F.col(value) / 64)).select(*by, out)
    return table.join(med, list(by), "left")


def token_reduction(table: DataFrame, base: str = "full_history", model: str = "model_key") -> DataFrame:
    """Adds ``token_reduction_pct`` against the same model's base arm; ``table`` has one row per arm."""
    full = F.max(F.when(F.col("method_label") == base, F.col("context_tokens"))).over(Window.partitionBy(model))
    return table.withColumn("token_reduction_pct", 100 * (1 - F.col("context_tokens") / full))


def recall_holds(facts: DataFrame, method: str = "candidate_oracle") -> DataFrame:
    """Facts plus a relabelled copy of the candidate arm without its fallbacks."""
    held = facts.where(F.col("method_label").startswith(method) & (F.col("recall_fallback") == 0))
    return facts.unionByName(held.withColumn("method_label", F.concat("method_label", F.lit("[recall-holds]"))))


def pivot_mean(facts: DataFrame, row: str, col: Column, labels: Sequence[str], value: str) -> DataFrame:
    return facts.withColumn("_label", col).groupBy(row).pivot("_label", list(labels)).agg(F.avg(value))


def context_identity(facts: DataFrame, arms: Sequence[str], base: str = "oracle_dag") -> DataFrame:
    """Share of selections equal to the base arm's, and fallback rate, per model and arm."""
    keys = ["model_key", "scenario_id"]
    b = facts.where(F.col("method_label") == base).select(*keys, F.col("selected").alias("_s"))
    j = facts.where(F.col("method_label").isin(list(arms))).join(b, keys)
    return j.groupBy("model_key", "method_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("selected").eqNullSafe(F.col("_s")), 1.0).otherwise(0.0)).alias("same_context"),
        F.avg("recall_fallback").alias("fallback_rate"))


def judge_shift(facts: DataFrame, old: str, new: str) -> DataFrame:
    both = facts.where(F.col(old).isNotNull() & F.col(new).isNotNull())
    return both.groupBy("model_key", "method_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(old).alias("old_mean"), F.avg(new).alias("new_mean")).withColumn(
        "delta", F.col("new_mean") - F.col("old_mean"))


def failure_cases(facts: DataFrame, a: str = "oracle_dag", b: str = "full_history") -> DataFrame:
    """Insufficient graph contexts, and scenarios where the full history does at least as well."""
    insufficient = facts.where((F.col("method_label") == a) & (F.col("context_sufficiency") == 0)).select(
        F.lit("insufficient").alias("type"), "scenario_id", "model_key", F.lit(None).cast("double").alias("full"),
        F.lit(None).cast("double").alias("dag"))
    keys = ["model_key", "scenario_id"]
    d = facts.where(F.col("method_label") == a).select(*keys, F.col("checklist_score").alias("dag"))
    f = facts.where(F.col("method_label") == b).select(*keys, F.col("checklist_score").alias("full"))
    worse = d.join(f, keys).where((F.col("full") >= F.col("dag")) & (F.col("full") > 0) & (F.col("dag") < 1))
    return insufficient.unionByName(worse.select(
        F.lit("full_history_not_worse").alias("type"), "scenario_id", "model_key", "full", "dag"))


def failure_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("type", "model_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("full") == F.col("dag")).alias("n_tied"),
        F.count_if(F.col("full") > F.col("dag")).alias("n_strict"))


def leakage_by_length(facts: DataFrame, lengths: Sequence[str], arm: str = "full_history") -> DataFrame:
    """Leakage of one arm by length, per model and pooled, and whether it rises."""
    rows = facts.where(F.col("method_label") == arm).withColumn(
        "model", F.explode(F.array(F.col("model_key"), F.lit("pooled"))))
    out = rows.groupBy("model").agg(*[
        F.avg(F.when(F.col("length") == x, F.col("distractor_leakage"))).alias(f"leak_{x}") for x in lengths])
    return out.withColumn("rises", F.coalesce(F.col(f"leak_{lengths[-1]}") > F.col(f"leak_{lengths[0]}"), F.lit(False)))


def retraction_table(facts: DataFrame) -> DataFrame:
    r, s = F.col("retraction"), F.col("checklist_score")
    return facts.groupBy("model_key", "method_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(r).alias("retractions"), F.avg(r).alias("retraction_rate"),
        F.avg(F.when(r == 1, s)).alias("score_retracted"), F.avg(F.when(r == 0, s)).alias("score_other"))


def first_attempt_rate(attempts: DataFrame, accepted: DataFrame, stop_below: float) -> DataFrame:
    """Pass rate of first attempts over accepted scenarios with gold turns, and the stop flag."""
    from convgraph.operators.facts import first_by_key

    first = first_by_key(attempts, ["scenario_id"], ["attempt"]).join(
        accepted.select("scenario_id"), "scenario_id", "left_semi")
    rated = first.where(F.col("gold_median").isNotNull())
    return rated.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pass").cast("int")).alias("first_attempt_rate")).withColumn(
        "stop", F.col("first_attempt_rate") < stop_below)


def recall_summary(recall: DataFrame, k: int, no_gold: list[str], long_families: list[str], threshold: float) -> DataFrame:
    """Headline recall row with its gate, read after rounding to four places."""
    at = lambda x: F.col("k") == x
    mean = lambda cond, c="strict": F.avg(F.when(cond, F.col(c)))
    fam = F.col("family")
    out = recall.agg(
        mean(at(k)).alias("strict_at_k"), mean(at(k), "fractional").alias("fractional_at_k"),
        mean(at(k) & ~fam.isin(no_gold)).alias("strict_excl_new_root"),
        mean(at(k) & fam.isin(long_families)).alias("strict_long"), mean(at(5)).alias("strict_at_5"),
        mean(at(5) & (F.col("k_feasible") == 1)).alias("strict_at_5_feasible"),
        F.count_if(at(5) & (F.col("k_feasible") == 1)).alias("n_feasible_at_5"),
        mean(F.col("k").isNull()).alias("strict_uncapped"),
        F.count_if(at(k) & (F.col("cap_binds") == 1)).alias("n_cap_binds"),
        F.sum(F.when(F.col("k").isNull(), F.col("n_gold"))).alias("gold_turns_total"),
        F.sum(F.when(F.col("k").isNull(), F.col("n_gold") - F.col("n_found"))).alias("gold_turns_missed"))
    return out.select(F.lit(k).cast("bigint").alias("primary_k"), "*",
                      (F.round("strict_at_k", 4) >= threshold).alias("passes_recall_gate"))


def judge_costs(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("judge_model").agg(
        F.sum("usd").alias("usd_total"), F.avg("usd").alias("usd_per_call"),
        F.count_if(F.col("judge_prompt_variant") == "fallback").alias("fallback_prompt_uses"),
        F.array_join(F.sort_array(F.collect_set(F.coalesce("judge_route", F.lit("")))), ";").alias("routes"))


def family_matrix(comparisons: DataFrame, baselines: Sequence[str], noise: float, by: Sequence[str] = ()) -> DataFrame:
    """family x baseline text cells ``diff [low, high]``, starred outside the noise floor; one such table per ``by``."""
    star = F.when(F.abs("q_diff") > noise, F.lit("*")).otherwise(F.lit(""))
    shown = [F.round(F.round(c, 9), 3) + F.lit(0.0) for c in ("q_diff", "q_ci_low", "q_ci_high")]
    cell = F.concat(F.format_string("%.3f [%.3f, %.3f]", *shown), star)
    return comparisons.withColumn("_c", cell).groupBy(*by, "family").pivot("b", list(baselines)).agg(F.first("_c"))


def percent_ci(mean: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.1f%% [%.1f, %.1f]", 100 * mean, 100 * low, 100 * high)
