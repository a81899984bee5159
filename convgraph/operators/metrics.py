"""Selection quality against annotated evidence, as sums over long selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("context_precision", "context_recall", "context_f1", "context_sufficiency",
           "irrelevant_context_ratio")


def flag_evidence(turns: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds ``is_evidence`` and ``is_distractor`` (history turns outside the evidence)."""
    e = evidence.select("sid", "idx", F.lit(True).alias("_e"))
    return turns.join(e.hint("merge"), ["sid", "idx"], "left").select(  # small as a file, large as a broadcast
        *[F.col(c) for c in turns.columns],
        F.coalesce("_e", F.lit(False)).alias("is_evidence"),
        (F.col("_e").isNull() & (F.col("rev") > 0)).alias("is_distractor"))


def instances(turns: DataFrame, arms: list[tuple[str, int | None]]) -> DataFrame:
    """One row per conversation and arm, also where an arm selects nothing."""
    arm = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(b).cast("bigint").alias("budget")) for m, b in arms])
    return turns.where("rev = 0").select("sid", F.inline(arm))


def selection_metrics(flagged: DataFrame, selections: DataFrame, plan: DataFrame) -> DataFrame:
    """Metrics per (sid, method, budget) of ``plan``.

    ``flagged``: turns with evidence flags.  Without evidence recall and
    sufficiency are 1 and precision is 1 only for an empty selection; an empty
    selection with evidence has precision 0.
    """
    flags = flagged.select("sid", "idx", "is_evidence", "is_distractor")
    count_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per_arm = (
        selections.join(flags, ["sid", "idx"])
        .groupBy("sid", "method", F.col("budget"))
        .agg(
            F.count(F.lit(1)).alias("n_selected"),
            count_if(F.col("is_evidence")).alias("n_hit"),
            count_if(F.col("is_distractor")).alias("n_distractors_selected"),
            F.sum("cost").alias("selected_turn_tokens"),
            F.sum(F.when(F.col("is_evidence"), 0).otherwise(F.col("cost"))).alias("_irrelevant"),
        )
    )
    per_sid = flagged.groupBy("sid").agg(count_if(F.col("is_evidence")).alias("n_evidence"))
    p, a = plan.alias("p"), per_arm.alias("a")
    same = (F.col("p.sid") == F.col("a.sid")) & (F.col("p.method") == F.col("a.method")) & F.col(
        "p.budget").eqNullSafe(F.col("a.budget"))
    wide = p.join(a, same, "left").select("p.*", *[
        F.coalesce(F.col(f"a.{c}"), F.lit(0)).cast("bigint").alias(c)
        for c in ("n_selected", "n_hit", "n_distractors_selected", "selected_turn_tokens", "_irrelevant")
    ]).join(per_sid, "sid")
    sel, hit, ev = F.col("n_selected"), F.col("n_hit"), F.col("n_evidence")
    precision = F.when(sel == 0, F.when(ev == 0, 1.0).otherwise(0.0)).otherwise(hit / sel)
    recall = F.when(ev == 0, 1.0).otherwise(hit / ev)
    wide = wide.withColumn("context_precision", precision).withColumn("context_recall", recall)
    pr, rc = F.col("context_precision"), F.col("context_recall")
    return wide.select(
        *plan.columns, "context_precision", "context_recall",
        F.when(pr + rc == 0, 0.0).otherwise(2 * pr * rc / (pr + rc)).alias("context_f1"),
        F.when(hit == ev, 1).otherwise(0).cast("bigint").alias("context_sufficiency"),
        F.when(F.col("selected_turn_tokens") == 0, 0.0)
        .otherwise(F.col("_irrelevant") / F.col("selected_turn_tokens")).alias("irrelevant_context_ratio"),
        "n_selected", "n_evidence", "n_distractors_selected", "selected_turn_tokens")


def stale_superseder_missing(selections: DataFrame, superseded: DataFrame) -> DataFrame:
    """Selected stale turns whose superseder is not selected.

    ``superseded(sid, idx, by_idx)`` lists stale turns.
    """
    stale = selections.select("sid", "method", "budget", "idx").join(superseded, ["sid", "idx"])
    have = selections.select("sid", F.col("method").alias("_m"), F.col("budget").alias("_b"),
                             F.col("idx").alias("by_idx"), F.lit(1).alias("_have"))
    s, h = stale.alias("s"), have.alias("h")
    on = ((F.col("s.sid") == F.col("h.sid")) & (F.col("s.by_idx") == F.col("h.by_idx"))
          & (F.col("s.method") == F.col("h._m")) & F.col("s.budget").eqNullSafe(F.col("h._b")))
    return s.join(h, on, "left_anti").select("sid", "method", "budget", "idx", "by_idx")


def invariant_violations(metrics: DataFrame) -> DataFrame:
    """Rows that break what holds by construction: (sid, method, violation)."""
    bad: Column = (
        F.when((F.col("method") == "full_history") & (F.col("context_recall") != 1.0), "full_history recall below 1")
        .when((F.col("method") == "oracle_dag") & (F.col("context_sufficiency") != 1), "oracle_dag not sufficient"))
    return metrics.withColumn("violation", bad).where("violation is not null").select("sid", "method", "violation")


def mean_metrics(metrics: DataFrame, by: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    cols = [*METRICS, *extra]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
