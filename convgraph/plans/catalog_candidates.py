"""Queries on candidate generation and recall."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage
from convgraph.operators import candidates, select
from convgraph.plans import inputs
from convgraph.plans.inputs import conversation_graph, with_views
from convgraph.plans.catalog_context import HEADS_SQL
from convgraph.plans.registry import big, query, r6

KS = (3, 5, 10, 15, 20, None)
NO_GOLD = ["family_3"]
LONG = ["family_7", "family_8", "family_10"]

POOL_SQL = f""",
  cos4 AS MATERIALIZED (SELECT sid, idx, round(cosine, 4) AS cosine FROM cosine),
  hop0 AS (SELECT sid, idx FROM turns WHERE rev = 1),
  hop1 AS (SELECT e.sid, e.parent AS idx FROM hop0 h JOIN edges e ON e.sid = h.sid AND e.child = h.idx AND e.pos = 0),
  hop2 AS (SELECT e.sid, e.parent AS idx FROM hop1 h JOIN edges e ON e.sid = h.sid AND e.child = h.idx AND e.pos = 0),
  shared AS (SELECT h.sid, h.idx, string_agg(DISTINCT h.item, ',' ORDER BY h.item) AS items,
                    count(DISTINCT h.item) AS n_items
             FROM items h JOIN turns th ON th.sid = h.sid AND th.idx = h.idx AND th.rev > 0
             JOIN turns tq ON tq.sid = h.sid AND tq.rev = 0
             JOIN items q ON q.sid = tq.sid AND q.idx = tq.idx AND q.item = h.item GROUP BY 1, 2),
  heads AS ({HEADS_SQL}),
  hits AS (
    SELECT sid, idx, 'active_branch' AS source FROM hop0 UNION SELECT sid, idx, 'active_branch' FROM hop1
    UNION SELECT sid, idx, 'active_branch' FROM hop2
    UNION SELECT sid, idx, 'inactive_heads' FROM heads WHERE rev <> 1
    UNION SELECT sid, idx, 'semantic' FROM (SELECT sid, idx, row_number() OVER (PARTITION BY sid ORDER BY cosine DESC, idx) AS rk
                                            FROM cos4) s WHERE rk <= 10
    UNION SELECT sid, idx, 'entity_overlap' FROM shared
    UNION SELECT sid, idx, 'recency' FROM turns WHERE rev BETWEEN 1 AND 5),
  pool AS MATERIALIZED (
    SELECT h.sid, h.idx, c.cosine, count(*) AS n_sources, string_agg(h.source, '+' ORDER BY h.source) AS sources,
           any_value(s.items) AS items
    FROM hits h JOIN cos4 c ON c.sid = h.sid AND c.idx = h.idx
    LEFT JOIN shared s ON s.sid = h.sid AND s.idx = h.idx GROUP BY h.sid, h.idx, c.cosine),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n_sources DESC, cosine DESC, idx DESC) AS rank FROM pool)
"""

RECALL_SQL = POOL_SQL.rstrip() + """,
  ks AS (SELECT * FROM (VALUES (3), (5), (10), (15), (20), (NULL)) v(k)),
  base AS (SELECT t.sid, any_value(t.family) AS family, count(*) FILTER (WHERE t.rev > 0) AS n_history,
                  count(c.idx) AS n_gold
           FROM turns t LEFT JOIN clo c ON c.sid = t.sid AND c.idx = t.idx GROUP BY t.sid),
  recall AS (
    SELECT b.sid, b.family, CAST(ks.k AS BIGINT) AS k, b.n_history, b.n_gold, count(r.idx) AS pool_size,
           count(c.idx) AS n_found,
           CASE WHEN ks.k IS NOT NULL AND b.n_history > ks.k THEN 1 ELSE 0 END AS cap_binds,
           CASE WHEN ks.k IS NULL OR ks.k >= b.n_gold THEN 1 ELSE 0 END AS k_feasible,
           CASE WHEN count(c.idx) = b.n_gold THEN 1 ELSE 0 END AS strict,
           CASE WHEN b.n_gold = 0 THEN 1.0 ELSE count(c.idx)::DOUBLE / b.n_gold END AS fractional
    FROM base b CROSS JOIN ks
    LEFT JOIN ranked r ON r.sid = b.sid AND (ks.k IS NULL OR r.rank <= ks.k)
    LEFT JOIN clo c ON c.sid = r.sid AND c.idx = r.idx
    GROUP BY b.sid, b.family, ks.k, b.n_history, b.n_gold)
"""

_P = "turns edges cosine items clo"


def pool_sql(body: str) -> str:
    return with_views(_P, POOL_SQL + body)


def recall_sql(body: str) -> str:
    return with_views(_P, RECALL_SQL + body)


class Pool(NamedTuple):
    turns: DataFrame
    edges: DataFrame
    closed: DataFrame
    pool: DataFrame


def build(spark, sf_dir, listed: bool = True) -> Pool:
    t, e, closed = conversation_graph(spark, sf_dir)
    cos = select.similarity(t, inputs.vectors(spark, sf_dir), digits=4)
    return Pool(t, e, closed, cut_lineage(candidates.candidate_pool(t, e, cut_lineage(cos), inputs.items(t), listed=listed)))


def recall(spark, sf_dir) -> DataFrame:
    p = build(spark, sf_dir, listed=False)  # recall needs no list of the shared items
    r = candidates.recall_at(p.turns, p.pool, p.closed, KS)
    return r.join(p.turns.where("rev = 0").select("sid", "family"), "sid")


def _count(df: DataFrame, by: str = "sid") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("idx").cast("bigint").alias("sum_idx"))


_COUNT_SQL = "SELECT sid, count(*) AS n, CAST(sum(idx) AS BIGINT) AS sum_idx FROM hits WHERE source = '{s}' GROUP BY sid"


@query("k1_active_branch", pool_sql(_COUNT_SQL.format(s="active_branch")))
def k1_active_branch(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return _count(candidates.source_active_branch(t, inputs.edges(t)))


@query("k2_inactive_heads", pool_sql(_COUNT_SQL.format(s="inactive_heads")))
def k2_inactive_heads(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return _count(candidates.source_inactive_heads(t, inputs.edges(t)))


@query("k3_semantic_top", pool_sql(_COUNT_SQL.format(s="semantic")))
def k3_semantic_top(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return _count(candidates.source_semantic(select.similarity(t, inputs.vectors(spark, sf_dir), 4)))


@query("k4_entity_overlap", pool_sql(
    "SELECT sid, idx, items AS shared, n_items AS n_shared FROM shared"))
def k4_entity_overlap(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    s = candidates.shared_items(t, inputs.items(t))
    return s.select("sid", "idx", F.array_join("shared_items", ",").alias("shared"),
                    F.size("shared_items").cast("bigint").alias("n_shared"))


@query("k5_recency", pool_sql(_COUNT_SQL.format(s="recency")))
def k5_recency(spark, sf_dir):
    return _count(candidates.source_recency(inputs.turns(spark, sf_dir)))


@query("k6_candidate_pool", pool_sql(
    "SELECT sid, idx, cosine, sources, n_sources, coalesce(items, '') AS shared FROM pool"))
def k6_candidate_pool(spark, sf_dir):
    p = build(spark, sf_dir).pool
    return p.select("sid", "idx", "cosine", F.array_join("sources", "+").alias("sources"),
                    F.size("sources").cast("bigint").alias("n_sources"),
                    F.array_join("shared_items", ",").alias("shared"))


@query("k7_rank_pool", pool_sql("SELECT sid, idx, rank, n_sources FROM ranked"))
def k7_rank_pool(spark, sf_dir):
    r = candidates.rank_pool(build(spark, sf_dir).pool)
    return r.select("sid", "idx", big("rank"), big("n_sources"))


@query("k8_all_pools", pool_sql("""
  SELECT t.family, count(*) AS n_rows, count(DISTINCT p.sid) AS n_sids, CAST(sum(n_sources) AS BIGINT) AS n_hits
  FROM pool p JOIN turns t ON t.sid = p.sid AND t.rev = 0 GROUP BY t.family"""))
def k8_all_pools(spark, sf_dir):
    p = build(spark, sf_dir)
    rows = p.pool.groupBy("sid").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("sources")).alias("_h"))
    fam = p.turns.where("rev = 0").select("sid", "family")
    return rows.join(fam, "sid").groupBy("family").agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_sids"), F.sum("_h").alias("n_hits"))


@query("k9_pool_view", pool_sql("""
  SELECT r.sid, r.rank, r.idx, c.idx IS NOT NULL AS gold, r.cosine, r.sources,
         coalesce(array_to_string(list_slice(string_split(r.items, ','), 1, 3), ','), '') AS shared
  FROM ranked r LEFT JOIN clo c ON c.sid = r.sid AND c.idx = r.idx WHERE r.rank <= 10
  UNION ALL SELECT c.sid, NULL, c.idx, true, NULL, 'missing', '' FROM clo c WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.sid = c.sid AND r.idx = c.idx)"""))
def k9_pool_view(spark, sf_dir):
    p = build(spark, sf_dir)
    return candidates.pool_view(p.pool, p.closed, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("k10_recall_at_k", recall_sql("""
  SELECT sid, k, n_history, pool_size, round(pool_size::DOUBLE / n_history, 6) AS pool_frac_of_history,
         CAST(cap_binds AS BIGINT) AS cap_binds, CAST(k_feasible AS BIGINT) AS k_feasible, n_gold, n_found,
         CAST(strict AS BIGINT) AS strict, round(fractional, 6) AS fractional FROM recall"""))
def k10_recall_at_k(spark, sf_dir):
    return recall(spark, sf_dir).select(
        "sid", "k", "n_history", "pool_size", r6("pool_frac_of_history"), big("cap_binds"), big("k_feasible"),
        "n_gold", "n_found", big("strict"), r6("fractional"))


@query("k11_recall_by_cohort", recall_sql("""
  , co AS (SELECT 'all' AS cohort, * FROM recall
    UNION ALL SELECT 'excl_new_root', * FROM recall WHERE family <> 'family_3'
    UNION ALL SELECT 'long_families', * FROM recall WHERE family IN ('family_7', 'family_8', 'family_10')
    UNION ALL SELECT 'cap_binds_only', * FROM recall WHERE cap_binds = 1
    UNION ALL SELECT 'feasible_k_ge_closure', * FROM recall WHERE k_feasible = 1)
  SELECT cohort, coalesce(CAST(k AS VARCHAR), 'uncapped') AS k, count(*) AS n, round(avg(strict), 6) AS strict_recall,
         round(avg(fractional), 6) AS fractional_recall, round(avg(pool_size), 6) AS mean_pool_size,
         round(avg(pool_size::DOUBLE / n_history), 6) AS mean_pool_frac_of_history,
         CAST(sum(cap_binds) AS BIGINT) AS n_cap_binds
  FROM co GROUP BY 1, 2"""))
def k11_recall_by_cohort(spark, sf_dir):
    rows = candidates.with_cohorts(recall(spark, sf_dir), NO_GOLD, LONG).withColumn("k", candidates.k_label(F.col("k")))
    return candidates.recall_by(rows, ["cohort", "k"]).select(
        "cohort", "k", "n", r6("strict_recall"), r6("fractional_recall"), r6("mean_pool_size"),
        r6("mean_pool_frac_of_history"), big("n_cap_binds"))


@query("k12_recall_by_family", recall_sql("""
  SELECT family, round(avg(strict) FILTER (WHERE k = 3), 6) AS k3, round(avg(strict) FILTER (WHERE k = 5), 6) AS k5,
         round(avg(strict) FILTER (WHERE k = 10), 6) AS k10, round(avg(strict) FILTER (WHERE k = 15), 6) AS k15,
         round(avg(strict) FILTER (WHERE k = 20), 6) AS k20, round(avg(strict) FILTER (WHERE k IS NULL), 6) AS uncapped
  FROM recall GROUP BY family"""))
def k12_recall_by_family(spark, sf_dir):
    labels = ["3", "5", "10", "15", "20", "uncapped"]
    r = recall(spark, sf_dir).withColumn("kl", candidates.k_label(F.col("k")))
    wide = r.groupBy("family").pivot("kl", labels).agg(F.avg("strict"))
    return wide.select("family", *[r6(F.col(f"`{k}`"), k if k == "uncapped" else f"k{k}") for k in labels])


@query("k12_recall_by_variant", recall_sql("""
  SELECT CASE WHEN sid % 2 = 0 THEN 'first_request' ELSE 'second_request' END AS variant,
         coalesce(CAST(k AS VARCHAR), 'uncapped') AS k, count(*) AS n, round(avg(strict), 6) AS strict_recall,
         round(avg(fractional), 6) AS fractional_recall
  FROM recall WHERE family = 'family_12' GROUP BY 1, 2"""))
def k12_recall_by_variant(spark, sf_dir):
    r = recall(spark, sf_dir).where("family = 'family_12'").withColumn(
        "variant", F.when(F.col("sid") % 2 == 0, "first_request").otherwise("second_request"))
    r = r.withColumn("k", candidates.k_label(F.col("k")))
    return candidates.recall_by(r, ["variant", "k"]).select(
        "variant", "k", "n", r6("strict_recall"), r6("fractional_recall"))


@query("k13_source_ablation", recall_sql("""
  , src AS (SELECT DISTINCT source AS dropped FROM hits),
  p2 AS (SELECT s.dropped, p.sid, p.idx, p.cosine,
                p.n_sources - CASE WHEN list_contains(string_split(p.sources, '+'), s.dropped) THEN 1 ELSE 0 END AS n2
         FROM pool p CROSS JOIN src s),
  r2 AS (SELECT *, row_number() OVER (PARTITION BY dropped, sid ORDER BY n2 DESC, cosine DESC, idx DESC) AS rank
         FROM p2 WHERE n2 > 0),
  one AS (SELECT s.dropped, b.sid, ks.k, b.n_gold, count(c.idx) AS n_found
          FROM src s CROSS JOIN base b CROSS JOIN ks
          LEFT JOIN r2 r ON r.dropped = s.dropped AND r.sid = b.sid AND (ks.k IS NULL OR r.rank <= ks.k)
          LEFT JOIN clo c ON c.sid = r.sid AND c.idx = r.idx GROUP BY 1, 2, 3, 4),
  full_pool AS (SELECT k, avg(strict) AS f FROM recall GROUP BY k)
  SELECT o.dropped, coalesce(CAST(o.k AS VARCHAR), 'uncapped') AS k,
         round(avg(CASE WHEN n_found = n_gold THEN 1 ELSE 0 END), 6) AS strict_recall,
         round(avg(CASE WHEN n_found = n_gold THEN 1 ELSE 0 END) - any_value(f.f), 6) AS delta_vs_full,
         round(avg(CASE WHEN n_gold = 0 THEN 1.0 ELSE n_found::DOUBLE / n_gold END), 6) AS fractional_recall
  FROM one o JOIN full_pool f ON f.k IS NOT DISTINCT FROM o.k GROUP BY 1, 2"""))
def k13_source_ablation(spark, sf_dir):
    p = build(spark, sf_dir)
    a = candidates.source_ablation(p.turns, p.pool, p.closed, KS)
    return a.select("dropped", candidates.k_label(F.col("k")).alias("k"), r6("strict_recall"), r6("delta_vs_full"),
                    r6("fractional_recall"))


@query("k14_source_attribution", pool_sql("""
  SELECT u.source, count(*) AS gold_turns_found, count(*) FILTER (WHERE p.n_sources = 1) AS found_only_by_this,
         round(count(*)::DOUBLE / (SELECT count(*) FROM clo), 6) AS share_of_gold_turns
  FROM clo c JOIN pool p ON p.sid = c.sid AND p.idx = c.idx JOIN hits u ON u.sid = p.sid AND u.idx = p.idx
  GROUP BY u.source
  UNION ALL
  SELECT '(missed)', (SELECT count(*) FROM clo) - (SELECT count(*) FROM clo c JOIN pool p ON p.sid = c.sid AND p.idx = c.idx),
         0, NULL"""))
def k14_source_attribution(spark, sf_dir):
    p = build(spark, sf_dir)
    per, totals = candidates.source_attribution(p.pool, p.closed)
    missed = totals.select(F.lit("(missed)").alias("source"), F.col("n_missed").alias("gold_turns_found"),
                           F.lit(0).cast("bigint").alias("found_only_by_this"),
                           F.lit(None).cast("double").alias("share_of_gold_turns"))
    return per.unionByName(missed).select("source", "gold_turns_found", "found_only_by_this", r6("share_of_gold_turns"))


@query("k15_misses", pool_sql("""
  , kk AS (SELECT * FROM (VALUES (3), (5), (10), (15), (20), (NULL)) v(k))
  SELECT c.sid, coalesce(CAST(kk.k AS VARCHAR), 'uncapped') AS k, c.idx
  FROM clo c CROSS JOIN kk LEFT JOIN ranked r ON r.sid = c.sid AND r.idx = c.idx
  WHERE r.rank IS NULL OR r.rank > kk.k"""))
def k15_misses(spark, sf_dir):
    p = build(spark, sf_dir)
    ranked = candidates.rank_pool(p.pool)
    return candidates.misses(p.closed, ranked, KS).select("sid", candidates.k_label(F.col("k")).alias("k"), "idx")


@query("k16_recall_summary", recall_sql("""
  SELECT CAST(15 AS BIGINT) AS primary_k, round(avg(strict) FILTER (WHERE k = 15), 6) AS strict_at_k,
         round(avg(fractional) FILTER (WHERE k = 15), 6) AS fractional_at_k,
         round(avg(strict) FILTER (WHERE k = 15 AND family <> 'family_3'), 6) AS strict_excl_new_root,
         round(avg(strict) FILTER (WHERE k = 15 AND family IN ('family_7', 'family_8', 'family_10')), 6) AS strict_long,
         round(avg(strict) FILTER (WHERE k = 5), 6) AS strict_at_5,
         round(avg(strict) FILTER (WHERE k = 5 AND k_feasible = 1), 6) AS strict_at_5_feasible,
         count(*) FILTER (WHERE k = 5 AND k_feasible = 1) AS n_feasible_at_5,
         round(avg(strict) FILTER (WHERE k IS NULL), 6) AS strict_uncapped,
         count(*) FILTER (WHERE k = 15 AND cap_binds = 1) AS n_cap_binds,
         CAST(sum(n_gold) FILTER (WHERE k IS NULL) AS BIGINT) AS gold_turns_total,
         CAST(sum(n_gold - n_found) FILTER (WHERE k IS NULL) AS BIGINT) AS gold_turns_missed,
         round(avg(strict) FILTER (WHERE k = 15), 4) >= 0.85 AS passes_recall_gate
  FROM recall"""))
def k16_recall_summary(spark, sf_dir):
    from convgraph.operators.tables import recall_summary

    s = recall_summary(recall(spark, sf_dir), 15, NO_GOLD, LONG, 0.85)
    return s.select(*[r6(c) if t == "double" else big(c) if t == "int" else F.col(c) for c, t in s.dtypes])


@query("c7_candidate_oracle", pool_sql("""
  , kk AS (SELECT * FROM (VALUES (5), (10), (15)) v(k)),
  flag AS (SELECT q.sid, kk.k, count(c.idx) FILTER (WHERE r.rank IS NULL OR r.rank > kk.k) AS n_missing
           FROM turns q CROSS JOIN kk LEFT JOIN clo c ON c.sid = q.sid
           LEFT JOIN ranked r ON r.sid = c.sid AND r.idx = c.idx WHERE q.rev = 0 GROUP BY 1, 2),
  sel AS (SELECT f.sid, f.k, f.n_missing, t.idx, t.cost FROM flag f JOIN turns t ON t.sid = f.sid AND t.rev > 0
          LEFT JOIN clo c ON c.sid = t.sid AND c.idx = t.idx WHERE f.n_missing > 0 OR c.idx IS NOT NULL)
  SELECT f.sid, CAST(f.k AS BIGINT) AS k, CAST(CASE WHEN f.n_missing > 0 THEN 1 ELSE 0 END AS BIGINT) AS recall_fallback,
         f.n_missing, count(s.idx) AS n_selected, CAST(coalesce(sum(s.cost), 0) AS BIGINT) AS tokens
  FROM flag f LEFT JOIN sel s ON s.sid = f.sid AND s.k = f.k GROUP BY f.sid, f.k, f.n_missing"""))
def c7_candidate_oracle(spark, sf_dir):
    p = build(spark, sf_dir)
    ranked = candidates.rank_pool(p.pool, 15)
    sel, flags = select.candidate_oracle(p.turns, p.closed, ranked, (5, 10, 15))
    per = sel.groupBy("sid", F.col("budget").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("tok"))
    return flags.join(per, ["sid", "k"], "left").select(
        "sid", "k", "recall_fallback", "n_missing", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_selected"),
        F.coalesce("tok", F.lit(0)).cast("bigint").alias("tokens"))


@query("p26_cohort_flags", recall_sql("""
  SELECT coalesce(CAST(k AS VARCHAR), 'uncapped') AS k, CAST(sum(cap_binds) AS BIGINT) AS n_cap_binds,
         CAST(sum(k_feasible) AS BIGINT) AS n_feasible, CAST(sum(strict) AS BIGINT) AS n_holds FROM recall GROUP BY 1"""))
def p26_cohort_flags(spark, sf_dir):
    r = recall(spark, sf_dir).withColumn("k", candidates.k_label(F.col("k")))
    return r.groupBy("k").agg(F.sum("cap_binds").alias("n_cap_binds"), F.sum("k_feasible").alias("n_feasible"),
                              F.sum("strict").alias("n_holds"))
