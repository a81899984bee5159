"""Queries on graphs, context selection and selection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage
from convgraph.operators import graph, metrics, select
from convgraph.operators.select import Method
from convgraph.plans import inputs
from convgraph.plans.inputs import BUDGETS, conversation_graph, with_views
from convgraph.plans.registry import big, query, r6

METHODS = [Method("full_history"), Method("sliding_window", 1024), Method("sliding_window", 2048),
           Method("semantic_retrieval", 1024), Method("semantic_retrieval", 2048),
           Method("oracle_tree"), Method("oracle_dag")]

SELECTION_SQL = """
  sel AS (
    SELECT sid, 'full_history' AS method, CAST(NULL AS BIGINT) AS budget, idx, cost FROM turns WHERE rev > 0
    UNION ALL SELECT sid, 'sliding_window', budget, idx, cost FROM win
    UNION ALL SELECT sid, 'semantic_retrieval', budget, idx, cost FROM retr
    UNION ALL SELECT t.sid, 'oracle_tree', NULL, t.idx, t.cost FROM turns t JOIN tree c ON c.sid = t.sid AND c.idx = t.idx
    UNION ALL SELECT t.sid, 'oracle_dag', NULL, t.idx, t.cost FROM turns t JOIN clo c ON c.sid = t.sid AND c.idx = t.idx),
  arms AS (SELECT * FROM (VALUES ('full_history', NULL), ('sliding_window', 1024), ('sliding_window', 2048),
           ('semantic_retrieval', 1024), ('semantic_retrieval', 2048), ('oracle_tree', NULL), ('oracle_dag', NULL)) v(method, budget)),
  metric AS (
    SELECT sid, method, budget, n_selected, n_evidence, n_hit, n_dis, tok, irr, family,
      CASE WHEN n_selected = 0 THEN CASE WHEN n_evidence = 0 THEN 1.0 ELSE 0.0 END ELSE n_hit::DOUBLE / n_selected END AS p,
      CASE WHEN n_evidence = 0 THEN 1.0 ELSE n_hit::DOUBLE / n_evidence END AS r,
      CASE WHEN n_hit = n_evidence THEN 1 ELSE 0 END AS suff,
      CASE WHEN tok = 0 THEN 0.0 ELSE irr::DOUBLE / tok END AS irr_ratio
    FROM (
      SELECT i.sid, i.family, i.method, i.budget, count(s.idx) AS n_selected,
             count(s.idx) FILTER (WHERE f.is_evidence) AS n_hit,
             count(s.idx) FILTER (WHERE f.is_distractor) AS n_dis,
             coalesce(sum(s.cost), 0) AS tok,
             coalesce(sum(s.cost) FILTER (WHERE NOT f.is_evidence), 0) AS irr,
             any_value(i.n_evidence) AS n_evidence
      FROM (SELECT q.sid, q.family, a.method, CAST(a.budget AS BIGINT) AS budget, n.n_evidence
            FROM turns q CROSS JOIN arms a
            JOIN (SELECT sid, count(*) FILTER (WHERE is_evidence) AS n_evidence FROM flagged GROUP BY sid) n ON n.sid = q.sid
            WHERE q.rev = 0) i
      LEFT JOIN sel s ON s.sid = i.sid AND s.method = i.method AND s.budget IS NOT DISTINCT FROM i.budget
      LEFT JOIN flagged f ON f.sid = s.sid AND f.idx = s.idx
      GROUP BY i.sid, i.family, i.method, i.budget))
"""


def with_selection(body: str) -> str:
    head = with_views("flagged win retr tree clo", "")
    return f"{head.rstrip()},\n{SELECTION_SQL}\n{body}"


def selections_and_metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, e, closed = conversation_graph(spark, sf_dir)
    cos = select.similarity(t, inputs.vectors(spark, sf_dir), carry=("cost",))
    sel = select.select_context(t, e, METHODS, cosine=cos)
    flagged = metrics.flag_evidence(t, inputs.evidence(closed))
    plan = metrics.instances(t, [(m.name, m.budget) for m in METHODS])
    return t, sel, metrics.selection_metrics(flagged, sel, plan)


def _per_sid(sel: DataFrame) -> DataFrame:
    return sel.groupBy("sid", "budget").agg(
        F.count(F.lit(1)).alias("n_selected"), F.sum("cost").cast("bigint").alias("tokens"),
        F.sum("idx").cast("bigint").alias("sum_idx"), F.min("idx").alias("first_idx"))


_PER_SID_SQL = """SELECT sid, {b} AS budget, count(*) AS n_selected, CAST(sum(cost) AS BIGINT) AS tokens,
  CAST(sum(idx) AS BIGINT) AS sum_idx, min(idx) AS first_idx FROM {t} GROUP BY 1, 2"""


def _closure_sql(view: str) -> str:
    return with_views(view, f"""SELECT sid, count(*) AS n_closure, CAST(sum(idx) AS BIGINT) AS sum_idx,
      min(idx) AS first_idx, max(idx) AS last_idx FROM {view} GROUP BY sid""")


def _closure_view(closed: DataFrame) -> DataFrame:
    return closed.groupBy("sid").agg(
        F.count(F.lit(1)).alias("n_closure"), F.sum("idx").alias("sum_idx"),
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("p1_turns", with_views("turns", """
  SELECT sid, count(*) AS n_turns, max(idx) AS query_idx,
         max(CASE WHEN rev = 0 THEN event_id END) AS query_event, count(*) FILTER (WHERE rev > 0) AS n_history
  FROM turns GROUP BY sid"""))
def p1_turns(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return t.groupBy("sid").agg(
        F.count(F.lit(1)).alias("n_turns"), F.max("idx").alias("query_idx"),
        F.max(F.when(F.col("rev") == 0, F.col("event_id"))).alias("query_event"),
        F.count_if(F.col("rev") > 0).alias("n_history"))


@query("g1_ancestor_closure", _closure_sql("clo"))
def g1_ancestor_closure(spark, sf_dir):
    return _closure_view(conversation_graph(spark, sf_dir).closed)


@query("g1_primary_closure", _closure_sql("tree"))
def g1_primary_closure(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return _closure_view(graph.closure(t, inputs.edges(t), primary_only=True))


@query("g2_primary_parent", with_views("edges", """
  SELECT sid, count(*) AS n_linked, CAST(sum(child - parent) AS BIGINT) AS sum_gap
  FROM edges WHERE pos = 0 GROUP BY sid"""))
def g2_primary_parent(spark, sf_dir):
    pp = graph.primary_parent(inputs.edges(inputs.turns(spark, sf_dir)))
    return pp.groupBy("sid").agg(F.count(F.lit(1)).alias("n_linked"), F.sum(F.col("child") - F.col("parent")).alias("sum_gap"))


@query("g3_active_branch", with_views("turns edges", """,
  hop0 AS (SELECT sid, idx FROM turns WHERE rev = 1),
  hop1 AS (SELECT e.sid, e.parent AS idx FROM hop0 h JOIN edges e ON e.sid = h.sid AND e.child = h.idx AND e.pos = 0),
  hop2 AS (SELECT e.sid, e.parent AS idx FROM hop1 h JOIN edges e ON e.sid = h.sid AND e.child = h.idx AND e.pos = 0)
  SELECT sid, idx, CAST(0 AS BIGINT) AS hop FROM hop0 UNION ALL SELECT sid, idx, 1 FROM hop1
  UNION ALL SELECT sid, idx, 2 FROM hop2"""))
def g3_active_branch(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return graph.active_branch(t, inputs.edges(t), 3).select("sid", "idx", big("hop"))


HEADS_SQL = """
  SELECT t.sid, t.idx, t.rev FROM turns t WHERE t.rev > 0 AND NOT EXISTS (
    SELECT 1 FROM edges e JOIN turns c ON c.sid = e.sid AND c.idx = e.child AND c.rev > 0
    WHERE e.sid = t.sid AND e.parent = t.idx AND e.pos = 0)"""


@query("g4_branch_heads", with_views("turns edges", f"""
  SELECT sid, count(*) AS n_heads, CAST(sum(idx) AS BIGINT) AS sum_idx FROM ({HEADS_SQL}) h GROUP BY sid"""))
def g4_branch_heads(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return graph.branch_heads(t, inputs.edges(t)).groupBy("sid").agg(
        F.count(F.lit(1)).alias("n_heads"), F.sum("idx").alias("sum_idx"))


@query("g5_closure_in_order", with_views("clo", """
  SELECT sid, count(*) AS n, CAST(sum(ord * idx) AS BIGINT) AS checksum FROM (
    SELECT sid, idx, row_number() OVER (PARTITION BY sid ORDER BY idx) AS ord FROM clo) o GROUP BY sid"""))
def g5_closure_in_order(spark, sf_dir):
    ordered = graph.in_order(conversation_graph(spark, sf_dir).closed)
    return ordered.groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ord") * F.col("idx")).alias("checksum"))


BRANCH_SQL = """
  mem AS (SELECT t.sid, t.idx FROM turns t LEFT JOIN clo c ON c.sid = t.sid AND c.idx = t.idx
          WHERE t.rev > 0 AND c.idx IS NULL),
  link AS (SELECT m.sid, m.idx, u.idx AS up FROM mem m
           LEFT JOIN edges e ON e.sid = m.sid AND e.child = m.idx AND e.pos = 0
           LEFT JOIN mem u ON u.sid = m.sid AND u.idx = e.parent),
  branch AS (SELECT sid, idx, idx AS root FROM link WHERE up IS NULL
             UNION ALL SELECT l.sid, l.idx, b.root FROM branch b JOIN link l ON l.sid = b.sid AND l.up = b.idx),
  bnum AS (SELECT sid, root, row_number() OVER (PARTITION BY sid ORDER BY root) - 1 AS branch, count(*) AS n_turns
           FROM branch GROUP BY sid, root)"""


@query("g6_donor_branches", with_views("turns edges clo", f""",{BRANCH_SQL}
  SELECT sid, root, branch, n_turns FROM bnum"""))
def g6_donor_branches(spark, sf_dir):
    t, e, closed = conversation_graph(spark, sf_dir)
    return graph.branch_numbers(graph.donor_branches(t, e, closed))


ONE_SQL = """
WITH RECURSIVE turns AS (
  SELECT 0::BIGINT AS sid, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, count(*) OVER () - row_number() OVER (ORDER BY ts, event_id) AS rev, user_id AS u FROM events),
edges AS (SELECT * FROM (
  SELECT sid, idx AS child, 0 AS pos, idx - 1 - u % 3 AS parent FROM turns UNION ALL SELECT sid, idx, 1, idx // 2 FROM turns WHERE u % 40 = 0) x WHERE parent >= 0),
clo_all AS (SELECT sid, idx FROM turns WHERE rev = 0 UNION SELECT e.sid, e.parent FROM clo_all c JOIN edges e ON e.child = c.idx),
clo AS (SELECT c.sid, c.idx FROM clo_all c JOIN turns t ON t.idx = c.idx WHERE t.rev > 0)"""


@query("g1_long", ONE_SQL + " SELECT sid, idx FROM clo")
def g1_long(spark, sf_dir):
    return graph.closure(*inputs.one_conversation(spark, sf_dir))


@query("g6_long", f"""{ONE_SQL},{BRANCH_SQL}
  SELECT sid, root, branch, n_turns FROM bnum""")
def g6_long(spark, sf_dir):
    t, e = inputs.one_conversation(spark, sf_dir)
    return graph.branch_numbers(graph.donor_branches(t, e, cut_lineage(graph.closure(t, e))))


@query("g7_subsequence", with_views("turns", """,
  seqs AS (SELECT sid, string_agg(event_type, ',' ORDER BY idx) AS s,
                  count(*) FILTER (WHERE event_type = 'click') AS clicks FROM turns GROUP BY sid)
  SELECT sid, regexp_matches(s, 'click.*view.*purchase') AS has_path, clicks >= 3 AS three_clicks FROM seqs"""))
def g7_subsequence(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    path = graph.follows_pattern(t, "event_type", ["click", "view", "purchase"], "has_path")
    thrice = graph.follows_pattern(t, "event_type", ["click"] * 3, "three_clicks")
    return path.join(thrice, "sid")


@query("g8_closure_ratio", with_views("turns clo", """
  SELECT t.sid, count(c.idx) AS n_closure, count(*) FILTER (WHERE t.rev > 0) AS n_history,
         round(count(c.idx)::DOUBLE / count(*) FILTER (WHERE t.rev > 0), 6) AS closure_ratio
  FROM turns t LEFT JOIN clo c ON c.sid = t.sid AND c.idx = t.idx GROUP BY t.sid"""))
def g8_closure_ratio(spark, sf_dir):
    t, _, closed = conversation_graph(spark, sf_dir)
    return graph.closure_ratio(t, closed).select("sid", "n_closure", big("n_history"), r6("closure_ratio"))


@query("g9_edge_faults", with_views("turns edges", """,
  bent AS (SELECT sid, child, CASE WHEN (sid + child) % 11 = 3 THEN child + 1 WHEN (sid + child) % 11 = 5 THEN -1
                              ELSE parent END AS parent FROM edges)
  SELECT fault, count(*) AS n, count(DISTINCT sid) AS n_sids FROM (
    SELECT b.sid, CASE WHEN t.idx IS NULL THEN 'missing' WHEN b.parent >= b.child THEN 'forward' END AS fault
    FROM bent b LEFT JOIN turns t ON t.sid = b.sid AND t.idx = b.parent) f
  WHERE fault IS NOT NULL GROUP BY fault"""))
def g9_edge_faults(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    r = (F.col("sid") + F.col("child")) % 11
    bent = inputs.edges(t).withColumn(
        "parent", F.when(r == 3, F.col("child") + 1).when(r == 5, -1).otherwise(F.col("parent")))
    return graph.edge_faults(t, bent).groupBy("fault").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("n_sids"))


@query("c1_full_history", with_views("turns", _PER_SID_SQL.format(
    b="CAST(NULL AS BIGINT)", t="(SELECT * FROM turns WHERE rev > 0) h")))
def c1_full_history(spark, sf_dir):
    return _per_sid(select.full_history(inputs.turns(spark, sf_dir)))


@query("c2_sliding_window", with_views("win", _PER_SID_SQL.format(b="CAST(budget AS BIGINT)", t="win")))
def c2_sliding_window(spark, sf_dir):
    return _per_sid(select.sliding_window(inputs.turns(spark, sf_dir), BUDGETS))


@query("c3_rolling_summary", with_views("turns win budgets", """
  SELECT q.sid, CAST(b.budget AS BIGINT) AS budget, count(w.idx) AS n_inside,
         any_value(n.n_history) - count(w.idx) AS n_outside,
         CASE WHEN any_value(n.n_history) > count(w.idx) AND any_value(d.text) IS NOT NULL THEN
           CAST(length(any_value(d.text)) + 51 AS BIGINT) END AS prefix_chars
  FROM turns q CROSS JOIN budgets b
  JOIN (SELECT sid, count(*) FILTER (WHERE rev > 0) AS n_history FROM turns GROUP BY sid) n ON n.sid = q.sid
  LEFT JOIN win w ON w.sid = q.sid AND w.budget = b.budget
  LEFT JOIN documents d ON d.doc_id = q.sid * 2 + CASE WHEN b.budget = 2048 THEN 1 ELSE 0 END
  WHERE q.rev = 0 GROUP BY q.sid, b.budget"""))
def c3_rolling_summary(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 2).alias("sid"),
        F.when(F.col("doc_id") % 2 == 1, 2048).otherwise(1024).cast("bigint").alias("budget"),
        F.col("text").alias("summary"))
    _, prefix = select.rolling_summary(inputs.turns(spark, sf_dir), BUDGETS, docs)
    return prefix.select("sid", "budget", big("n_inside"), big("n_outside"),
                         F.length("prefix").cast("bigint").alias("prefix_chars"))


@query("c4_semantic_retrieval", with_views("retr", _PER_SID_SQL.format(b="CAST(budget AS BIGINT)", t="retr")))
def c4_semantic_retrieval(spark, sf_dir):
    t = cut_lineage(inputs.turns(spark, sf_dir))
    cos = select.similarity(t, inputs.vectors(spark, sf_dir), carry=("cost",))
    return _per_sid(select.semantic_retrieval(t, cos, BUDGETS))


@query("c5_oracle_tree", with_views("turns tree", _PER_SID_SQL.format(
    b="CAST(NULL AS BIGINT)", t="(SELECT t.* FROM turns t JOIN tree c ON c.sid = t.sid AND c.idx = t.idx) h")))
def c5_oracle_tree(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return _per_sid(select.oracle_tree(t, inputs.edges(t)))


@query("c6_oracle_dag", with_views("turns clo", _PER_SID_SQL.format(
    b="CAST(NULL AS BIGINT)", t="(SELECT t.* FROM turns t JOIN clo c ON c.sid = t.sid AND c.idx = t.idx) h")))
def c6_oracle_dag(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return _per_sid(select.oracle_dag(t, inputs.edges(t)))


@query("c8_matched_retrieval", with_views("mretr", _PER_SID_SQL.format(b="budget", t="mretr")))
def c8_matched_retrieval(spark, sf_dir):
    t, _, closed = conversation_graph(spark, sf_dir)
    cos = select.similarity(t, inputs.vectors(spark, sf_dir), carry=("cost",))
    return _per_sid(select.matched_retrieval(t, cos, closed))


@query("c9_select_context", with_selection("""
  SELECT method, budget, count(*) AS n_rows, CAST(sum(cost) AS BIGINT) AS tokens, count(DISTINCT sid) AS n_sids
  FROM sel GROUP BY method, budget"""))
def c9_select_context(spark, sf_dir):
    _, sel, _ = selections_and_metrics(spark, sf_dir)
    return sel.groupBy("method", "budget").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("cost").alias("tokens"), F.count_distinct("sid").alias("n_sids"))


@query("c10_similarity", with_views("cosine", """
  SELECT sid, count(*) AS n, round(avg(cosine), 6) AS mean_cosine, round(max(cosine), 6) AS max_cosine,
         round(min(cosine), 6) AS min_cosine FROM cosine GROUP BY sid"""))
def c10_similarity(spark, sf_dir):
    c = select.similarity(cut_lineage(inputs.turns(spark, sf_dir)), inputs.vectors(spark, sf_dir))
    return c.groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("cosine"), "mean_cosine"), r6(F.max("cosine"), "max_cosine"),
        r6(F.min("cosine"), "min_cosine"))


@query("a1_selection_metrics", with_selection("""
  SELECT sid, method, budget, round(p, 6) AS context_precision, round(r, 6) AS context_recall,
         round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS context_f1,
         CAST(suff AS BIGINT) AS context_sufficiency, round(irr_ratio, 6) AS irrelevant_context_ratio,
         n_selected, n_evidence, n_dis AS n_distractors_selected, CAST(tok AS BIGINT) AS selected_turn_tokens
  FROM metric"""))
def a1_selection_metrics(spark, sf_dir):
    m = selections_and_metrics(spark, sf_dir)[2]
    return m.select(
        "sid", "method", "budget", r6("context_precision"), r6("context_recall"), r6("context_f1"),
        "context_sufficiency", r6("irrelevant_context_ratio"), "n_selected", "n_evidence",
        "n_distractors_selected", "selected_turn_tokens")


@query("a2_invariants", with_selection("""
  SELECT method, CASE WHEN method = 'full_history' THEN 'full_history recall below 1' ELSE 'oracle_dag not sufficient' END
         AS violation, count(*) AS n FROM metric
  WHERE (method = 'full_history' AND r <> 1) OR (method = 'oracle_dag' AND suff <> 1) GROUP BY 1, 2
  UNION ALL
  SELECT s.method, 'stale without superseder', count(*) FROM sel s
  WHERE s.idx % 9 = 4 AND NOT EXISTS (SELECT 1 FROM sel x WHERE x.sid = s.sid AND x.method = s.method
    AND x.budget IS NOT DISTINCT FROM s.budget AND x.idx = s.idx + 2) GROUP BY 1, 2"""))
def a2_invariants(spark, sf_dir):
    t, sel, m = selections_and_metrics(spark, sf_dir)
    stale = t.where("idx % 9 = 4").select("sid", "idx", (F.col("idx") + 2).alias("by_idx"))
    missing = metrics.stale_superseder_missing(sel, stale).withColumn("violation", F.lit("stale without superseder"))
    rows = metrics.invariant_violations(m).select("method", "violation").unionByName(missing.select("method", "violation"))
    return rows.groupBy("method", "violation").agg(F.count(F.lit(1)).alias("n"))


@query("p13_stale_superseder", with_selection("""
  SELECT s.sid, s.method, s.budget, count(*) AS n_missing FROM sel s
  WHERE s.idx % 9 = 4 AND NOT EXISTS (SELECT 1 FROM sel x WHERE x.sid = s.sid AND x.method = s.method
    AND x.budget IS NOT DISTINCT FROM s.budget AND x.idx = s.idx + 2) GROUP BY 1, 2, 3"""))
def p13_stale_superseder(spark, sf_dir):
    t, sel, _ = selections_and_metrics(spark, sf_dir)
    stale = t.where("idx % 9 = 4").select("sid", "idx", (F.col("idx") + 2).alias("by_idx"))
    return metrics.stale_superseder_missing(sel, stale).groupBy("sid", "method", "budget").agg(
        F.count(F.lit(1)).alias("n_missing"))


@query("a3_mean_metrics", with_selection("""
  SELECT method, budget, count(*) AS n, round(avg(p), 6) AS context_precision, round(avg(r), 6) AS context_recall,
         round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 6) AS context_f1,
         round(avg(suff), 6) AS context_sufficiency, round(avg(irr_ratio), 6) AS irrelevant_context_ratio,
         round(avg(tok), 6) AS context_tokens
  FROM metric GROUP BY method, budget"""))
def a3_mean_metrics(spark, sf_dir):
    m = selections_and_metrics(spark, sf_dir)[2]
    out = metrics.mean_metrics(m, ["method", "budget"], ("selected_turn_tokens",))
    return out.select("method", "budget", "n", *[r6(c) for c in metrics.METRICS],
                      r6("selected_turn_tokens", "context_tokens"))


@query("a26_history_tokens", with_views("turns", """
  SELECT family, count(*) AS n, CAST(sum(tok) AS BIGINT) AS tokens, round(avg(tok), 6) AS mean_tokens
  FROM (SELECT sid, any_value(family) AS family, sum(cost) AS tok FROM turns WHERE rev > 0 GROUP BY sid) h
  GROUP BY family"""))
def a26_history_tokens(spark, sf_dir):
    t = inputs.turns(spark, sf_dir).where("rev > 0")
    per = t.groupBy("sid").agg(F.first("family").alias("family"), F.sum("cost").alias("tok"))
    return per.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tok").alias("tokens"), r6(F.avg("tok"), "mean_tokens"))
