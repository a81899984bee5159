"""Decision gates: small tables in, one verdict row per model (or judge) out.

Where the rule reads published numbers, values are rounded to four places first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the gates."""

    quality_margin_pp: float = 5.0
    token_reduction_pct: float = 40.0
    join_advantage_required: bool = True
    candidate_recall: float = 0.85
    noninferiority_margin: float = -0.03
    token_ratio_fail: float = 1.3
    token_ratio_pass: float = 0.7
    amplifies: float = 0.05
    partial: float = 0.04
    models_required: int = 2
    directional: float = 0.02
    kappa: float = 0.6
    score_delta: float = 0.05
    kappa_lead: float = 0.10
    cost_factor: float = 2.0
    contrast_error: float = 0.02
    first_attempt: float = 0.80
    stage_usd: float = 7.0


T = Thresholds()


def _at(label: str, value: str) -> Column:
    return F.max(F.when(F.col("method_label") == label, F.round(value, 4)))


def _quality_and_tokens(summary: DataFrame, arm: str, base: str) -> DataFrame:
    """summary(model_key, method_label, checklist_score, token_reduction_pct) -> one row per model."""
    w = summary.groupBy("model_key").agg(
        _at(arm, "checklist_score").alias("_a"), _at(base, "checklist_score").alias("_b"),
        _at(arm, "token_reduction_pct").alias("token_reduction_pct"))
    return w.where("_a is not null").select(
        "model_key", (100 * (F.col("_a") - F.col("_b"))).alias("quality_diff_pp"), "token_reduction_pct")


def feasibility(summary: DataFrame, join_advantage: DataFrame, t: Thresholds = T) -> DataFrame:
    """GO / PIVOT / STOP.  ``join_advantage(model_key, join_adv)`` over the join families."""
    d = _quality_and_tokens(summary, "oracle_dag", "full_history").join(join_advantage, "model_key", "left")
    q = F.col("quality_diff_pp") >= -t.quality_margin_pp
    k = F.col("token_reduction_pct") >= t.token_reduction_pct
    j = F.coalesce(F.round("join_adv", 4) > 0, F.lit(False)) if t.join_advantage_required else F.lit(True)
    return d.withColumn("verdict", F.when(q & k & j, "GO").when(q & k, "PIVOT (tree only)")
                        .when(k, "PIVOT (dependency semantics)").otherwise("STOP"))


def candidate_gate(summary: DataFrame, strict_recall: DataFrame, arm: str, t: Thresholds = T) -> DataFrame:
    """PASS / PIVOT with reasons.  ``strict_recall`` is the one-row recall summary."""
    d = _quality_and_tokens(summary, arm, "full_history").join(
        F.broadcast(strict_recall.select(F.round("strict_at_k", 4).alias("recall"))))
    r = F.col("recall") >= t.candidate_recall
    q = F.col("quality_diff_pp") >= -t.quality_margin_pp
    k = F.col("token_reduction_pct") >= t.token_reduction_pct
    why = F.array(F.when(~r, "candidate recall below threshold"), F.when(~q, "quality below margin"),
                  F.when(~k, "token reduction below threshold"))
    return d.withColumn("verdict", F.when(r & q & k, "PASS").otherwise("PIVOT")).withColumn(
        "reasons", F.array_join(F.filter(why, lambda x: x.isNotNull()), "; "))


def comparability(forward: DataFrame, reverse: DataFrame, frontier: DataFrame, reference: str,
                  baselines: Sequence[str], t: Thresholds = T) -> DataFrame:
    """PASS / FAIL / INDETERMINATE / insufficient data per model.

    ``forward(model, b, noninferior_ci)``: reference against each baseline,
    ``reverse(model, a, noninferior_ci)``, ``frontier(model, method_label,
    context_tokens, checklist)``.
    """
    bases = list(baselines)
    f = frontier.withColumn("_q", F.round("checklist", 4)).withColumn("_t", F.round("context_tokens", 4))
    is_base = F.col("method_label").isin(bases) & F.col("_q").isNotNull()
    rank = [F.when(F.col("method_label") == b, F.lit(-i)) for i, b in enumerate(bases)]
    fr = f.groupBy("model").agg(
        F.count_if(is_base).alias("n_bases"),
        F.max(F.when(is_base, F.struct("_q", F.coalesce(*rank).alias("o"), "method_label", "_t"))).alias("_best"),
        F.max(F.when(F.col("method_label") == reference, F.col("_t"))).alias("ref_tokens"))
    fr = fr.select("model", "n_bases", F.col("_best.method_label").alias("best_baseline"),
                   F.col("_best._t").alias("best_tokens"), "ref_tokens")
    fw = forward.where(F.col("b").isin(bases)).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_fwd"), F.bool_and("noninferior_ci").alias("ni_all"))
    rv = reverse.where(F.col("a").isin(bases)).select("model", F.col("a").alias("best_baseline"),
                                                      F.col("noninferior_ci").alias("best_ni"))
    n_rv = reverse.where(F.col("a").isin(bases)).groupBy("model").agg(F.count(F.lit(1)).alias("n_rev"))
    d = fr.join(fw, "model", "left").join(n_rv, "model", "left").join(rv, ["model", "best_baseline"], "left")
    n = len(bases)
    enough = (F.col("n_bases") == n) & F.col("ref_tokens").isNotNull() & (F.col("n_fwd") == n) & (F.col("n_rev") == n)
    fail = F.col("best_ni") & (F.col("best_tokens") <= t.token_ratio_fail * F.col("ref_tokens"))
    passed = F.col("ni_all") & (F.col("ref_tokens") <= t.token_ratio_pass * F.col("best_tokens"))
    return d.select(
        "model", "best_baseline", "ref_tokens", "best_tokens",
        F.when(~F.coalesce(enough, F.lit(False)), "insufficient data").when(fail, "FAIL").when(passed, "PASS")
        .otherwise("INDETERMINATE").alias("verdict"))


def amplification(deltas: DataFrame, t: Thresholds = T) -> DataFrame:
    """One row from the per-model differences ``(model, q_diff)``."""
    q = F.round("q_diff", 4)
    d = deltas.where("model <> 'pooled'").agg(
        F.count_if(q >= t.amplifies).alias("n_amplifies"), F.count_if(q >= t.partial).alias("n_partial_or_more"),
        F.count_if(q < t.partial).alias("n_flat"))
    need = t.models_required
    return d.withColumn("verdict", F.when(F.col("n_amplifies") >= need, "AMPLIFIES")
                        .when(F.col("n_partial_or_more") >= need, "PARTIAL").when(F.col("n_flat") >= need, "FLAT")
                        .otherwise("AWKWARD"))


def length_reading(comparisons: DataFrame, leakage: DataFrame, t: Thresholds = T) -> DataFrame:
    """Reading per model of base minus longest; void when pooled leakage does not rise."""
    q, lo = F.round("q_diff", 4), F.round("q_ci_low", 4)
    reading = (F.when(q.isNull(), "n/a").when((q >= t.amplifies) & (lo > 0), "AMPLIFIES")
               .when((q >= t.directional) & (q < t.amplifies), "DIRECTIONAL")
               .when(q >= t.amplifies, "DIRECTIONAL (interval includes zero)").otherwise("CLOSED"))
    valid = leakage.where("model = 'pooled'").select(F.col("rises").alias("valid"))
    return comparisons.join(F.broadcast(valid)).select(
        "model", "q_diff", "q_ci_low", "valid", reading.alias("reading"),
        F.when(F.col("valid"), reading).otherwise("VOID").alias("outcome"))


def judge_bar(judges: DataFrame, t: Thresholds = T) -> DataFrame:
    """First adoption bar: adds ``passes``.  judges(judge, kappa, mean_abs_delta, n_violations)."""
    return judges.withColumn("passes", (F.round("kappa", 4) >= t.kappa) & (F.round("mean_abs_delta", 4) <= t.score_delta)
                             & (F.col("n_violations") == 0))


def adopt_judge(judges: DataFrame, t: Thresholds = T) -> DataFrame:
    """Cheapest passer, replaced in order of cost by one clearly better at under twice the cost.

    The handful of judges is folded in one row.
    """
    item = F.struct("usd_per_call", "judge", "kappa")
    q = judges.where("passes").agg(F.sort_array(F.collect_list(item)).alias("_q"))
    chosen = F.aggregate(
        F.slice("_q", F.lit(2), F.greatest(F.size("_q") - 1, F.lit(0))), F.get("_q", F.lit(0)),
        lambda cur, x: F.when((x["kappa"] - cur["kappa"] >= t.kappa_lead)
                              & (x["usd_per_call"] < t.cost_factor * cur["usd_per_call"]), x).otherwise(cur))
    return q.select(chosen.alias("_c"), F.size("_q").cast("bigint").alias("n_passers")).select(
        F.col("_c.judge").alias("adopted"), "n_passers")


def judge_bar_v2(judges: DataFrame, t: Thresholds = T) -> DataFrame:
    """Second bar: judges(judge, kappa, n_violations, max_abs_err, usd_per_call) adds ``passes``."""
    return judges.withColumn("passes", (F.col("kappa") >= t.kappa) & (F.col("n_violations") == 0)
                             & (F.col("max_abs_err") <= t.contrast_error))


def cheapest_passer(judges: DataFrame) -> DataFrame:
    return judges.where("passes").agg(F.min_by("judge", F.struct("usd_per_call", "judge")).alias("adopted"),
                                      F.count(F.lit(1)).alias("n_passers"))


def small_budget(reverse: DataFrame, t: Thresholds = T) -> DataFrame:
    """Whether an arm is competitive: non-inferior everywhere and within the token ratio.

    ``reverse(model, noninferior_ci, tok_ratio, q_ci_high)``: arm minus reference.
    """
    return reverse.agg(
        F.bool_and(F.col("noninferior_ci") & (F.col("tok_ratio") <= t.token_ratio_fail)).alias("competitive"),
        F.count_if(F.col("q_ci_high") < 0).alias("n_models_worse"))


def overall(verdicts: DataFrame, passing: str = "PASS") -> DataFrame:
    return verdicts.agg(F.bool_and(F.col("verdict") == passing).alias("passes"), F.count(F.lit(1)).alias("n_models"))


def stage_allowed(ledger: DataFrame, limit: float = T.stage_usd) -> DataFrame:
    return ledger.agg(F.sum("usd").alias("usd")).select("usd", (F.col("usd") < limit).alias("allowed"))
