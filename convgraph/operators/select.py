"""Context selection: which earlier turns go with the query.

All selectors take and return the long form.  A selection is
``(sid, method, budget, idx, cost)``; ``budget`` is NULL for methods without one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convgraph.functions.splitwin import salted_join, split_cumsum
from convgraph.functions.vectors import dot, unit
from convgraph.operators import graph

BUDGETED = ("sliding_window", "rolling_summary", "semantic_retrieval")


@dataclass(frozen=True)
class Method:
    name: str
    budget: int | None = None
    k: int | None = None

    @property
    def label(self) -> str:
        n = self.budget if self.budget is not None else self.k
        return self.name if n is None else f"{self.name}@{n}"


def _tag(df: DataFrame, method: str, budget: Column | None = None) -> DataFrame:
    b = F.lit(None) if budget is None else budget
    return df.select("sid", F.lit(method).alias("method"), b.cast("bigint").alias("budget"), "idx", "cost")


def full_history(turns: DataFrame) -> DataFrame:
    return _tag(turns.where("rev > 0"), "full_history")


def _with_budgets(df: DataFrame, budgets: Sequence[int]) -> DataFrame:
    return df.withColumn("budget", F.explode(F.array(*[F.lit(int(b)).cast("bigint") for b in budgets])))


def sliding_window(turns: DataFrame, budgets: Sequence[int], method: str = "sliding_window") -> DataFrame:
    """Newest whole turns while their running cost fits; ends at the first overflow.

    Costs are not negative, so "fits so far" is a running sum; long conversations are summed in splits.
    """
    past = turns.where("rev > 0").select("sid", "idx", "cost", "rev")
    run = split_cumsum(past, ["sid"], F.floor(F.col("rev") / 4096), [F.col("rev")], F.col("cost"), "_run").where(F.col("_run") <= max(budgets))
    return _tag(_with_budgets(run, budgets).where("_run <= budget"), method, F.col("budget"))


def rolling_summary(
    turns: DataFrame, budgets: Sequence[int], summaries: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Sliding window plus a summary of what it leaves out.

    ``summaries(sid, budget, summary)``.  Returns the selection (inside turns
    only) and the prefix per (sid, budget); without outside turns there is none.
    """
    inside = sliding_window(turns, budgets, "rolling_summary")
    n_hist = turns.groupBy("sid").agg(F.sum(F.when(F.col("rev") > 0, 1).otherwise(0)).alias("n_history"))
    n_in = inside.groupBy("sid", "budget").agg(F.count(F.lit(1)).alias("n_inside"))
    per = _with_budgets(n_hist, budgets).join(n_in, ["sid", "budget"], "left")
    per = per.withColumn("n_inside", F.coalesce("n_inside", F.lit(0)))
    prefix = per.join(summaries, ["sid", "budget"], "left").select(
        "sid", "budget", "n_inside", (F.col("n_history") - F.col("n_inside")).alias("n_outside"),
        F.when(F.col("n_history") > F.col("n_inside"),
               F.concat(F.lit(SUMMARY_HEAD), F.col("summary"), F.lit(SUMMARY_TAIL))).alias("prefix"))
    return inside, prefix


# The text around a summary.
SUMMARY_HEAD = "[Summary of earlier conversation]\n"
SUMMARY_TAIL = "\n\n[Recent turns]\n"


def similarity(turns: DataFrame, vectors: DataFrame, digits: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Cosine of every history turn with its query: (sid, idx, *carry, cosine).

    ``turns`` carries ``vec_id``; ``vectors(vec_id, embedding)``.  Columns of
    ``turns`` named in ``carry`` come along and need no join later.
    """
    v = vectors.select("vec_id", unit(F.col("embedding")).alias("u"))
    q = turns.where("rev = 0").join(v, "vec_id").select("sid", F.col("u").alias("qu"))
    h = turns.where("rev > 0").select("sid", "idx", "vec_id", *carry).join(v, "vec_id")
    cos = dot(F.col("u"), F.col("qu"))
    return salted_join(h, q, ["sid"], F.col("idx")).select(
        "sid", "idx", *carry, (cos if digits is None else F.round(cos, digits)).alias("cosine"))


def _with_cost(turns: DataFrame, cosine: DataFrame) -> DataFrame:
    if "cost" in cosine.columns:
        return cosine.select("sid", "idx", "cost", "cosine")
    return turns.where("rev > 0").select("sid", "idx", "cost").join(cosine, ["sid", "idx"])


def greedy_fill(scored: DataFrame, budgets: Sequence[int] | None = None) -> DataFrame:
    """Take turns by descending cosine, older first on ties, skipping what does not fit.

    ``scored(sid, idx, cost, cosine)``, with a column ``budget`` per conversation
    if no ``budgets`` are given.  The pass is sequential, but a turn of cost c can
    only be taken if fewer than budget / c turns of that very cost come before it
    (once one is skipped, all later ones of its cost are), so the array per (sid,
    budget) is bounded by the budget, not by the conversation.
    """
    # turns without a cost always fit and take nothing from the budget
    free = scored.where("cost <= 0")
    free = (free if budgets is None else _with_budgets(free, budgets)).where("budget >= 0").select(
        "sid", F.col("budget").cast("bigint").alias("budget"), F.col("idx").cast("bigint").alias("idx"), F.col("cost").cast("bigint").alias("cost"))
    w = Window.partitionBy("sid", "cost").orderBy(F.desc("cosine"), "idx")
    ranked = scored.where("cost > 0").withColumn("_rk", F.row_number().over(w))
    if budgets is not None:  # whole costs: of cost 1 or more, no more turns than the budget can be taken
        ranked = _with_budgets(ranked.where(F.col("_rk") <= int(max(budgets))), budgets)
    ranked = ranked.where(F.col("_rk") <= F.floor(F.col("budget") / F.col("cost")))
    queue = ranked.groupBy("sid", "budget").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("o"), "idx", "cost"))).alias("_q"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"),
                     F.array().cast("array<struct<idx:bigint,cost:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= F.col("budget")
        item = F.struct(x["idx"].cast("bigint").alias("idx"), x["cost"].cast("bigint").alias("cost"))
        return F.when(fits, F.struct((acc["used"] + x["cost"]).cast("bigint").alias("used"),
                                     F.array_append(acc["taken"], item).alias("taken"))).otherwise(acc)

    taken = queue.select("sid", "budget", F.inline(F.aggregate("_q", start, step)["taken"]))
    return taken.withColumn("budget", F.col("budget").cast("bigint")).unionByName(free)


def semantic_retrieval(turns: DataFrame, cosine: DataFrame, budgets: Sequence[int]) -> DataFrame:
    return _tag(greedy_fill(_with_cost(turns, cosine), budgets), "semantic_retrieval", F.col("budget"))


def matched_retrieval(turns: DataFrame, cosine: DataFrame, closed: DataFrame) -> DataFrame:
    """Retrieval whose budget is the token cost of the conversation's own closure."""
    cost = turns.select("sid", "idx", "cost")
    budget = cost.join(closed.select("sid", "idx"), ["sid", "idx"], "left_semi").groupBy("sid").agg(
        F.sum("cost").alias("budget"))
    scored = salted_join(_with_cost(turns, cosine), budget, ["sid"], F.col("idx"))
    return _tag(greedy_fill(scored), "semantic_retrieval_matched", F.col("budget"))


def from_closure(turns: DataFrame, closed: DataFrame, method: str) -> DataFrame:
    rows = turns.select("sid", "idx", "cost").join(closed.select("sid", "idx"), ["sid", "idx"])
    return _tag(rows, method)


def oracle_dag(turns: DataFrame, edges: DataFrame, **kw) -> DataFrame:
    return from_closure(turns, graph.closure(turns, edges, **kw), "oracle_dag")


def oracle_tree(turns: DataFrame, edges: DataFrame, **kw) -> DataFrame:
    return from_closure(turns, graph.closure(turns, edges, primary_only=True, **kw), "oracle_tree")


def candidate_gaps(closed: DataFrame, ranked: DataFrame, ks: Sequence[int | None]) -> DataFrame:
    """Closure turns outside the first k of the pool: (sid, k, idx); k NULL = whole pool.

    ``ranked(sid, idx, rank)``.
    """
    kcol = F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks]))
    have = ranked.select("sid", "idx", "rank")
    return (
        closed.select("sid", "idx").join(have, ["sid", "idx"], "left").withColumn("k", kcol)
        .where(F.col("rank").isNull() | (F.col("k").isNotNull() & (F.col("rank") > F.col("k"))))
        .select("sid", "k", "idx")
    )


def candidate_oracle(
    turns: DataFrame, closed: DataFrame, ranked: DataFrame, ks: Sequence[int]
) -> tuple[DataFrame, DataFrame]:
    """Closure if it lies inside the top-k pool, else the whole history.

    Returns the selection (budget = k) and (sid, k, recall_fallback, n_missing).
    """
    gaps = candidate_gaps(closed, ranked, ks).groupBy("sid", "k").agg(F.count(F.lit(1)).alias("n_missing"))
    sids = turns.where("rev = 0").select("sid")
    flags = (
        _with_budgets(sids, ks).withColumnRenamed("budget", "k").join(gaps, ["sid", "k"], "left")
        .select("sid", "k", F.when(F.col("n_missing") > 0, 1).otherwise(0).cast("bigint").alias("recall_fallback"),
                F.coalesce("n_missing", F.lit(0)).cast("bigint").alias("n_missing"))
    )
    marked = turns.where("rev > 0").select("sid", "idx", "cost").join(
        closed.select("sid", "idx", F.lit(True).alias("_gold")), ["sid", "idx"], "left")
    per_sid = flags.groupBy("sid").agg(F.collect_list(F.struct("k", "recall_fallback")).alias("_ks"))
    rows = salted_join(marked, per_sid, ["sid"], F.col("idx")).select("sid", "idx", "cost", "_gold", F.inline("_ks"))
    rows = rows.where((F.col("recall_fallback") == 1) | F.col("_gold"))
    return _tag(rows, "candidate_oracle", F.col("k")), flags


def select_context(
    turns: DataFrame,
    edges: DataFrame,
    methods: Sequence[Method],
    cosine: DataFrame | None = None,
    summaries: DataFrame | None = None,
    ranked: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """Union of the selections of all ``methods``; each method family is planned once."""
    known = {"full_history", "sliding_window", "rolling_summary", "semantic_retrieval",
             "semantic_retrieval_matched", "oracle_tree", "oracle_dag", "candidate_oracle"}
    budgets: dict[str, list[int]] = {}
    for m in methods:
        if m.name not in known:
            raise ValueError(f"unknown method {m.name!r}")
        if m.name in BUDGETED and m.budget is None:
            raise ValueError(f"method {m.name!r} needs a budget")
        if m.name == "candidate_oracle" and m.k is None:
            raise ValueError("candidate_oracle needs k")
        budgets.setdefault(m.name, []).append(m.k if m.name == "candidate_oracle" else m.budget)
    dag = None
    if {"oracle_dag", "candidate_oracle", "semantic_retrieval_matched"} & set(budgets):
        dag = graph.closure(turns, edges, **kw)
    parts: list[DataFrame] = []
    for name, bs in budgets.items():
        if name == "full_history":
            parts.append(full_history(turns))
        elif name == "sliding_window":
            parts.append(sliding_window(turns, bs))
        elif name == "rolling_summary":
            parts.append(rolling_summary(turns, bs, summaries)[0] if summaries is not None
                         else sliding_window(turns, bs, "rolling_summary"))
        elif name == "semantic_retrieval":
            parts.append(semantic_retrieval(turns, cosine, bs))
        elif name == "semantic_retrieval_matched":
            parts.append(matched_retrieval(turns, cosine, dag))
        elif name == "oracle_tree":
            parts.append(oracle_tree(turns, edges, **kw))
        elif name == "oracle_dag":
            parts.append(from_closure(turns, dag, "oracle_dag"))
        else:
            parts.append(candidate_oracle(turns, dag, ranked, bs)[0])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
