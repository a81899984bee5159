"""Candidate turns from five sources, their ranking and their recall.

Everything is long: a pool row is ``(sid, idx, cosine, n_sources, sources,
shared_items)``.  Rankings are only needed up to the largest k, so the window
keeps that many rows per conversation on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convgraph.functions.splitwin import salted_join, split_row_number
from convgraph.operators import graph

# Names of the sources.
SOURCES = ("active_branch", "inactive_heads", "semantic", "entity_overlap", "recency")


def source_active_branch(turns: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    return graph.active_branch(turns, edges, depth).select("sid", "idx", F.lit("active_branch").alias("source"))


def source_inactive_heads(turns: DataFrame, edges: DataFrame) -> DataFrame:
    heads = graph.branch_heads(turns, edges).where("rev <> 1")
    return heads.select("sid", "idx", F.lit("inactive_heads").alias("source"))


def source_semantic(cosine: DataFrame, top: int = 10) -> DataFrame:
    w = Window.partitionBy("sid").orderBy(F.desc("cosine"), "idx")
    best = cosine.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= top)
    return best.select("sid", "idx", F.lit("semantic").alias("source"))


def shared_items(turns: DataFrame, items: DataFrame, min_shared: int = 1, listed: bool = True) -> DataFrame:
    """History turns sharing items with the query: (sid, idx, shared_items).

    ``items(sid, idx, item)``.  An equi-join on (sid, item), salted by turn.  Unless ``listed``, items are only counted:
    (sid, idx).
    """
    role = turns.select("sid", "idx", "rev")
    it = items.dropDuplicates(["sid", "idx", "item"]).join(role, ["sid", "idx"])
    q = it.where("rev = 0").select("sid", "item")
    hits = salted_join(it.where("rev > 0"), q, ["sid", "item"], F.col("idx"))
    if not listed:  # an item is one row per turn
        return hits.groupBy("sid", "idx").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_shared).select("sid", "idx")
    return (
        hits.groupBy("sid", "idx").agg(F.sort_array(F.collect_set("item")).alias("shared_items"))
        .where(F.size("shared_items") >= min_shared)
    )


def source_recency(turns: DataFrame, n: int = 5) -> DataFrame:
    return turns.where((F.col("rev") > 0) & (F.col("rev") <= n)).select("sid", "idx", F.lit("recency").alias("source"))


def candidate_pool(
    turns: DataFrame,
    edges: DataFrame,
    cosine: DataFrame,
    items: DataFrame,
    depth: int = 3,
    top: int = 10,
    recency: int = 5,
    min_shared: int = 1,
    heads: bool = True,
    listed: bool = True,
) -> DataFrame:
    """Union of the sources, one row per (sid, idx); cosine rounded to four places; without ``listed`` no ``shared_items``."""
    shared = shared_items(turns, items, min_shared, listed)
    hits = source_active_branch(turns, edges, depth)
    if heads:
        hits = hits.unionByName(source_inactive_heads(turns, edges))
    hits = hits.unionByName(source_semantic(cosine, top)).unionByName(source_recency(turns, recency))
    own = ["shared_items"] if listed else []
    hits = hits.withColumns({c: F.lit(None).cast("array<string>") for c in own}).unionByName(
        shared.select("sid", "idx", F.lit("entity_overlap").alias("source"), *own))
    pool = hits.groupBy("sid", "idx").agg(
        F.sort_array(F.collect_set("source")).alias("sources"),
        *[F.coalesce(F.max(c), F.array().cast("array<string>")).alias(c) for c in own])
    return pool.join(cosine.select("sid", "idx", F.round("cosine", 4).alias("cosine")), ["sid", "idx"])


def rank_pool(pool: DataFrame, limit: int | None = None, drop_source: str | None = None) -> DataFrame:
    """Adds ``rank``: more sources first, then higher cosine, then later turns.

    ``drop_source`` ranks as if a source did not exist.  With ``limit`` only that
    many rows per conversation are kept; without it the ranking is split by its
    own leading keys, so that no task holds a whole pool.
    """
    p = pool
    if drop_source is not None:
        p = p.withColumn("sources", F.array_remove("sources", drop_source))
    p = p.withColumn("n_sources", F.size("sources")).where("n_sources > 0")
    order = [F.desc("n_sources"), F.desc("cosine"), F.desc("idx")]
    if limit is not None:
        w = Window.partitionBy("sid").orderBy(*order)
        return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    split = F.struct((-F.col("n_sources")).alias("a"), (-F.floor(F.col("cosine") * 50)).alias("b"))
    return split_row_number(p, ["sid"], split, order, "rank")


def drop_each_source(pool: DataFrame) -> DataFrame:
    """The pool once per dropped source, remaining sources only: adds ``dropped``."""
    each = pool.withColumn("dropped", F.explode(F.array(*[F.lit(s) for s in SOURCES])))
    return each.withColumn("sources", F.expr("array_remove(sources, dropped)")).where(F.size("sources") > 0)


def _ranked_within(pool: DataFrame, key: Sequence[str], limit: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(F.size("sources")), F.desc("cosine"), F.desc("idx"))
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def recall_at(
    turns: DataFrame,
    pool: DataFrame,
    closed: DataFrame,
    ks: Sequence[int | None],
    key: Sequence[str] = ("sid",),
) -> DataFrame:
    """Recall of the closure in the first k of the pool, per ``key`` and k.

    NULL k is the whole pool.  ``key`` may add columns of ``pool`` to ``sid``
    (such as ``dropped``); every conversation appears under each of their values.
    """
    key = list(key)
    extra = [k for k in key if k != "sid"]
    limit = max(k for k in ks if k is not None)
    top = _ranked_within(pool, key, limit).select(*key, "idx", "rank")
    gold = closed.select("sid", "idx", F.lit(1).alias("_gold"))
    per_turn = pool.select(*key, "idx").join(top, [*key, "idx"], "left").join(gold, ["sid", "idx"], "left")
    aggs = []
    for i, k in enumerate(ks):
        inside = F.lit(True) if k is None else F.coalesce(F.col("rank") <= k, F.lit(False))
        aggs += [F.count_if(inside).alias(f"_p{i}"), F.count_if(inside & (F.col("_gold") == 1)).alias(f"_f{i}")]
    found = per_turn.groupBy(*key).agg(*aggs)
    base = turns.groupBy("sid").agg(F.count_if(F.col("rev") > 0).alias("n_history")).join(
        closed.groupBy("sid").agg(F.count(F.lit(1)).alias("n_gold")), "sid", "left").withColumn(
        "n_gold", F.coalesce("n_gold", F.lit(0)))
    if extra:
        base = base.withColumn("dropped", F.explode(F.array(*[F.lit(s) for s in SOURCES])))
    wide = base.join(found, key, "left")
    per_k = F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("k"), F.coalesce(f"_p{i}", F.lit(0)).alias("pool_size"),
                 F.coalesce(f"_f{i}", F.lit(0)).alias("n_found")) for i, k in enumerate(ks)])
    r = wide.select(*key, "n_history", "n_gold", F.inline(per_k))
    k = F.col("k")
    return r.select(
        *key, "k", "n_history", "pool_size", F.try_divide("pool_size", "n_history").alias("pool_frac_of_history"),
        F.when(k.isNotNull() & (F.col("n_history") > k), 1).otherwise(0).alias("cap_binds"),
        F.when(k.isNull() | (k >= F.col("n_gold")), 1).otherwise(0).alias("k_feasible"),
        "n_gold", "n_found", F.when(F.col("n_found") == F.col("n_gold"), 1).otherwise(0).alias("strict"),
        F.when(F.col("n_gold") == 0, 1.0).otherwise(F.try_divide("n_found", "n_gold")).alias("fractional"))


def k_label(k):
    return F.coalesce(k.cast("string"), F.lit("uncapped"))


def with_cohorts(recall: DataFrame, no_gold: list[str], long_families: list[str]) -> DataFrame:
    """Repeats each row under every cohort it belongs to; the cohorts overlap."""
    fam = F.col("family")
    member = F.array(
        F.lit("all"), F.when(~fam.isin(no_gold), "excl_new_root"), F.when(fam.isin(long_families), "long_families"),
        F.when(F.col("cap_binds") == 1, "cap_binds_only"),
        F.when(F.col("k_feasible") == 1, "feasible_k_ge_closure"))
    return recall.withColumn("cohort", F.explode(F.filter(member, lambda x: x.isNotNull())))


def recall_by(recall: DataFrame, by: Sequence[str]) -> DataFrame:
    return recall.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("strict").alias("strict_recall"),
        F.avg("fractional").alias("fractional_recall"), F.avg("pool_size").alias("mean_pool_size"),
        F.avg("pool_frac_of_history").alias("mean_pool_frac_of_history"),
        F.sum("cap_binds").alias("n_cap_binds"))


def source_ablation(turns: DataFrame, pool: DataFrame, closed: DataFrame, ks: Sequence[int | None]) -> DataFrame:
    """Recall with each source left out, and its difference from the full pool."""
    full = recall_at(turns, pool, closed, ks).groupBy("k").agg(F.avg("strict").alias("_full"))
    part = recall_at(turns, drop_each_source(pool), closed, ks, ("sid", "dropped")).groupBy("dropped", "k").agg(
        F.avg("strict").alias("strict_recall"), F.avg("fractional").alias("fractional_recall"))
    f = full.withColumnRenamed("k", "_k")
    return part.join(F.broadcast(f), F.col("k").eqNullSafe(F.col("_k"))).select(
        "dropped", "k", "strict_recall", (F.col("strict_recall") - F.col("_full")).alias("delta_vs_full"),
        "fractional_recall")


def source_attribution(pool: DataFrame, closed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source: gold turns found, found by it alone, share; and the union's misses."""
    gold = closed.select("sid", "idx").join(pool.select("sid", "idx", "sources"), ["sid", "idx"], "left")
    totals = gold.agg(F.count(F.lit(1)).alias("n_gold"), F.count_if(F.col("sources").isNull()).alias("n_missed"))
    listed = gold.where("sources is not null").select(
        F.explode("sources").alias("source"), (F.size("sources") == 1).alias("_sole"))
    per = listed.groupBy("source").agg(
        F.count(F.lit(1)).alias("gold_turns_found"), F.count_if("_sole").alias("found_only_by_this"))
    per = per.join(F.broadcast(totals)).select(
        "source", "gold_turns_found", "found_only_by_this",
        F.try_divide("gold_turns_found", "n_gold").alias("share_of_gold_turns"))
    return per, totals


def misses(closed: DataFrame, ranked: DataFrame, ks: Sequence[int | None]) -> DataFrame:
    """Closure turns outside the first k: (sid, k, idx)."""
    from convgraph.operators.select import candidate_gaps

    return candidate_gaps(closed, ranked, ks)


def pool_view(pool: DataFrame, closed: DataFrame, limit: int) -> DataFrame:
    """Inspection view: rank, gold mark, sources, first shared items; a gold turn outside the pool has no rank."""
    marks = closed.select("sid", "idx", F.lit(True).alias("_g"))
    r = rank_pool(pool, limit).join(marks, ["sid", "idx"], "left")
    shown = r.select("sid", "rank", "idx", F.coalesce("_g", F.lit(False)).alias("gold"), "cosine",
                     F.array_join("sources", "+").alias("sources"),
                     F.array_join(F.slice("shared_items", 1, 3), ",").alias("shared"))
    missing = closed.select("sid", "idx").join(pool.select("sid", "idx"), ["sid", "idx"], "left_anti")
    kind = {f.name: f.dataType for f in shown.schema}
    none = lambda c: F.lit(None).cast(kind[c]).alias(c)
    return shown.unionByName(missing.select("sid", none("rank"), "idx", F.lit(True).alias("gold"), none("cosine"), F.lit("missing").alias("sources"), F.lit("").alias("shared")))
