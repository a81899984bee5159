"""Queries on corpus augmentation by splicing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convgraph.functions.digest import digest_sql
from convgraph.functions.lineage import cut_lineage
from convgraph.functions.text import render_turn
from convgraph.functions.vectors import unit
from convgraph.operators import splice
from convgraph.plans import inputs
from convgraph.plans.catalog_context import BRANCH_SQL
from convgraph.plans.inputs import conversation_graph, with_views
from convgraph.plans.registry import big, query, r6

LENGTHS = (70, 95)
PER_FAMILY = 2
SEED = 20

SPLICE_SQL = f""",
  {BRANCH_SQL},
  tg AS (SELECT sid, family, base_n FROM (SELECT sid, family, idx AS base_n, row_number() OVER (PARTITION BY family ORDER BY sid) AS rn
         FROM turns WHERE rev = 0) x WHERE rn <= {PER_FAMILY}),
  kit AS (SELECT sid, idx, item FROM items WHERE starts_with(item, 'k')),
  mine AS MATERIALIZED (SELECT DISTINCT g.sid AS target, k.item FROM (SELECT sid, idx FROM clo UNION ALL SELECT sid, base_n FROM tg) g
           JOIN tg ON tg.sid = g.sid JOIN kit k ON k.sid = g.sid AND k.idx = g.idx),
  rej AS MATERIALIZED (SELECT DISTINCT m.target, b.sid, b.root FROM branch b JOIN kit k ON k.sid = b.sid AND k.idx = b.idx JOIN mine m ON m.item = k.item AND m.target <> b.sid),
  rank0 AS MATERIALIZED (SELECT tg.sid AS target, tg.base_n, d.sid, d.root, d.branch, d.n_turns, list_inner_product(dv.u, qv.u) AS cosine
            FROM bnum d JOIN turns dt ON dt.sid = d.sid AND dt.idx = d.root JOIN unitv dv ON dv.vec_id = dt.vec_id
            JOIN tg ON tg.sid <> d.sid JOIN turns qt ON qt.sid = tg.sid AND qt.rev = 0 JOIN unitv qv ON qv.vec_id = qt.vec_id)
"""
PICK_SQL = SPLICE_SQL.rstrip() + """,
  adm AS MATERIALIZED (SELECT r.*, row_number() OVER (PARTITION BY r.target ORDER BY cosine DESC, r.sid, r.root) AS rk FROM rank0 r
          LEFT JOIN rej x ON x.target = r.target AND x.sid = r.sid AND x.root = r.root WHERE x.sid IS NULL),
  p1 AS (SELECT sid AS target, base_n, CAST(0 AS BIGINT) AS rk, CAST(0 AS BIGINT) AS total, false AS taken FROM tg
         UNION ALL SELECT a.target, a.base_n, a.rk, CASE WHEN p.base_n + p.total < 70 AND p.base_n + p.total + a.n_turns <= 76 THEN p.total + a.n_turns ELSE p.total END,
           p.base_n + p.total < 70 AND p.base_n + p.total + a.n_turns <= 76 FROM p1 p JOIN adm a ON a.target = p.target AND a.rk = p.rk + 1),
  t1 AS MATERIALIZED (SELECT target, rk FROM p1 WHERE taken), e1 AS (SELECT target, max(total) AS total FROM p1 GROUP BY 1),
  p2 AS (SELECT tg.sid AS target, base_n, CAST(0 AS BIGINT) AS rk, e1.total, false AS taken FROM tg JOIN e1 ON e1.target = tg.sid
         UNION ALL SELECT a.target, a.base_n, a.rk, CASE WHEN o.rk IS NULL AND p.base_n + p.total < 95 AND p.base_n + p.total + a.n_turns <= 101 THEN p.total + a.n_turns ELSE p.total END,
           o.rk IS NULL AND p.base_n + p.total < 95 AND p.base_n + p.total + a.n_turns <= 101
         FROM p2 p JOIN adm a ON a.target = p.target AND a.rk = p.rk + 1 LEFT JOIN t1 o ON o.target = a.target AND o.rk = a.rk),
  pick AS MATERIALIZED (SELECT a.target, row_number() OVER (PARTITION BY a.target ORDER BY x.length, a.rk) - 1 AS pick, x.length, a.sid, a.root, a.branch, a.n_turns, a.cosine
           FROM (SELECT target, rk, 70 AS length FROM t1 UNION ALL SELECT target, rk, 95 FROM p2 WHERE taken) x JOIN adm a ON a.target = x.target AND a.rk = x.rk),
  want AS (SELECT sid AS target, base_n, unnest(CASE WHEN base_n < 70 THEN [70, 95] ELSE [95] END) AS length FROM tg),
  slot0 AS (SELECT DISTINCT sid, slot FROM (SELECT c.sid, c.idx + 1 AS slot FROM clo c JOIN tg ON tg.sid = c.sid UNION ALL SELECT sid, 0 FROM tg
            UNION ALL SELECT sid, base_n FROM tg WHERE sid NOT IN (SELECT sid FROM clo)) s),
  slot AS (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY md5(concat_ws('|', '20', sid, slot)), slot) - 1 AS k, count(*) OVER (PARTITION BY sid) AS n FROM slot0),
  placed AS MATERIALIZED (SELECT p.*, s.slot FROM pick p JOIN slot s ON s.sid = p.target AND s.k = p.pick % s.n),
  sp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY target, length ORDER BY place, is_base, pick, idx) - 1 AS new_idx,
           count(*) OVER (PARTITION BY target, length) AS n_all FROM (
    SELECT w.target, w.length, t.idx AS place, 1 AS is_base, NULL AS pick, t.sid, t.idx, t.cost FROM want w JOIN turns t ON t.sid = w.target
    UNION ALL SELECT w.target, w.length, p.slot, 0, p.pick, b.sid, b.idx, t.cost FROM want w JOIN placed p ON p.target = w.target AND p.length <= w.length
      JOIN branch b ON b.sid = p.sid AND b.root = p.root JOIN turns t ON t.sid = b.sid AND t.idx = b.idx) x)
"""
_V = "turns edges clo ev items unitv"


def splice_sql(body: str, full: bool = True) -> str:
    return with_views(_V, (PICK_SQL if full else SPLICE_SQL).rstrip() + "\n" + body)


class Splice(NamedTuple):
    turns: DataFrame
    edges: DataFrame
    closed: DataFrame
    items: DataFrame
    members: DataFrame
    donors: DataFrame
    targets: DataFrame
    best: DataFrame
    reports: DataFrame


def prepare(spark, sf_dir) -> Splice:
    t, e, closed = conversation_graph(spark, sf_dir)
    members, donors = splice.donor_pool(t, e, closed)
    tg = splice.targets(t, None, PER_FAMILY)
    v = inputs.vectors(spark, sf_dir).select("vec_id", unit(F.col("embedding")).alias("u"))
    roots = donors.select("sid", "root").join(t.select("sid", F.col("idx").alias("root"), "vec_id"), ["sid", "root"])
    dv = roots.join(v, "vec_id").select("sid", "root", "u")
    qv = t.where("rev = 0").join(tg.select("sid"), "sid").join(v, "vec_id").select("sid", "u")
    it = inputs.items(t).where(F.col("item").startswith("k"))
    best, reports = splice.score_donors(tg, qv, donors, dv, closed, members, it, LENGTHS)
    return Splice(t, e, closed, it, members, donors, tg, best, reports)


def placed(s: Splice) -> DataFrame:
    picks = splice.choose_donors(s.best, LENGTHS)
    return cut_lineage(splice.assign_slots(s.targets, s.closed, picks, SEED, max(LENGTHS) + splice.SLACK))


def build(s: Splice) -> tuple[DataFrame, DataFrame]:
    p = placed(s)
    want = splice.target_lengths(s.targets, LENGTHS)
    return p, cut_lineage(splice.interleave(s.turns, s.members, want, p))


@query("x1_donor_pool", splice_sql("SELECT count(*) AS n_donors, CAST(sum(n_turns) AS BIGINT) AS n_turns, count(DISTINCT sid) AS n_sids, max(n_turns) AS longest FROM bnum", False))
def x1_donor_pool(spark, sf_dir):
    t, e, closed = conversation_graph(spark, sf_dir)
    _, donors = splice.donor_pool(t, e, closed)
    return donors.agg(F.count(F.lit(1)).alias("n_donors"), F.sum("n_turns").alias("n_turns"), F.count_distinct("sid").alias("n_sids"),
                      F.max("n_turns").alias("longest"))


@query("x2_targets", splice_sql("SELECT target AS sid, base_n, CAST(length AS BIGINT) AS length FROM want"))
def x2_targets(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return splice.target_lengths(splice.targets(t, None, PER_FAMILY), LENGTHS).select("sid", "base_n", big("length"))


@query("x3_rank_donors", splice_sql("""
  SELECT target, count(*) AS n_donors, round(avg(cosine), 6) AS mean_cosine, round(max(cosine), 6) AS best_cosine FROM rank0 GROUP BY 1""", False))
def x3_rank_donors(spark, sf_dir):
    return prepare(spark, sf_dir).reports.select("target", "n_donors", r6("mean_cosine"), r6("best_cosine"))


@query("x4_rejected_donors", splice_sql("SELECT target, count(*) AS n_rejected FROM rej GROUP BY 1", False))
def x4_rejected_donors(spark, sf_dir):
    return prepare(spark, sf_dir).reports.where("n_rejected > 0").select("target", "n_rejected")


@query("j8_theta_join", splice_sql("""
  SELECT r.target, count(*) AS n_admissible, CAST(sum(n_turns) AS BIGINT) AS n_turns FROM rank0 r
  WHERE NOT EXISTS (SELECT 1 FROM rej x WHERE x.target = r.target AND x.sid = r.sid AND x.root = r.root) GROUP BY 1""", False))
def j8_theta_join(spark, sf_dir):
    r = prepare(spark, sf_dir).reports.where("n_admissible > 0")
    return r.select("target", "n_admissible", F.col("turns_admissible").alias("n_turns"))


@query("x5_choose_donors", splice_sql("""
  SELECT target, pick, CAST(length AS BIGINT) AS length, sid, root, branch, n_turns, round(cosine, 6) AS cosine FROM pick"""))
def x5_choose_donors(spark, sf_dir):
    s = prepare(spark, sf_dir)
    p = splice.choose_donors(s.best, LENGTHS)
    return p.select("target", big("pick"), big("length"), "sid", "root", "branch", "n_turns", r6("cosine"))


@query("x6_slots", splice_sql("SELECT target, pick, slot FROM placed"))
def x6_slots(spark, sf_dir):
    return placed(prepare(spark, sf_dir)).select("target", big("pick"), "slot")


@query("x7_interleave", splice_sql("""
  SELECT target, CAST(length AS BIGINT) AS length, count(*) AS n_turns, CAST(sum(new_idx * (idx + 1)) AS BIGINT) AS checksum,
         CAST(sum(new_idx * sid) AS BIGINT) AS sid_checksum, count(*) FILTER (WHERE is_base = 0) AS n_donor FROM sp GROUP BY 1, 2"""))
def x7_interleave(spark, sf_dir):
    _, sp = build(prepare(spark, sf_dir))
    return sp.groupBy("target", big("length")).agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.col("new_idx") * (F.col("idx") + 1)).alias("checksum"),
        F.sum(F.col("new_idx") * F.col("sid")).alias("sid_checksum"), F.count_if(F.col("origin") == "donor").alias("n_donor"))


@query("x7_remapped_edges", splice_sql("""
  , ed AS (SELECT c.target, c.length, c.new_idx AS child, p.new_idx AS parent, e.pos FROM edges e JOIN sp c ON c.sid = e.sid AND c.idx = e.child AND c.is_base = 1
      JOIN sp p ON p.target = c.target AND p.length = c.length AND p.sid = e.sid AND p.idx = e.parent AND p.is_base = 1
    UNION ALL SELECT target, length, new_idx, prev, 0 FROM (SELECT *, lag(new_idx) OVER (PARTITION BY target, length, pick ORDER BY new_idx) AS prev FROM sp WHERE is_base = 0) x WHERE prev IS NOT NULL)
  SELECT target, CAST(length AS BIGINT) AS length, count(*) AS n_edges, CAST(sum(child * 1000 + parent) AS BIGINT) AS checksum FROM ed GROUP BY 1, 2"""))
def x7_remapped_edges(spark, sf_dir):
    s = prepare(spark, sf_dir)
    _, sp = build(s)
    e = splice.remap_edges(sp, s.edges)
    return e.groupBy("target", big("length")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("child") * 1000 + F.col("parent")).alias("checksum"))


@query("x8_sidecar", splice_sql("""
  SELECT g.sid, g.family, g.base_n, coalesce(p.n, 0) AS n_donors, coalesce(p.t, 0) AS donor_turns, round(p.c, 6) AS mean_cosine, coalesce(r.n, 0) AS n_rejected,
         g.base_n + coalesce(p.t, 0) >= 95 AS sufficient
  FROM tg g LEFT JOIN (SELECT target, count(*) AS n, CAST(sum(n_turns) AS BIGINT) AS t, avg(round(cosine, 4)) AS c FROM pick GROUP BY 1) p ON p.target = g.sid
  LEFT JOIN (SELECT target, count(*) AS n FROM rej GROUP BY 1) r ON r.target = g.sid"""))
def x8_sidecar(spark, sf_dir):
    s = prepare(spark, sf_dir)
    p, sp = build(s)
    c = splice.sidecar(s.targets, p, s.reports, splice.target_lengths(s.targets, LENGTHS), sp, max(LENGTHS))
    return c.select("sid", "family", "base_n", "n_donors", "donor_turns", r6("mean_cosine"), "n_rejected", "sufficient")


@query("x9_preflight", splice_sql("""
  SELECT target, CAST(length AS BIGINT) AS length, count(*) FILTER (WHERE new_idx < n_all - 1) AS n_history,
         CAST(sum(cost) FILTER (WHERE new_idx < n_all - 1) AS BIGINT) AS full_tokens, true AS closure_same, true AS base_inside, true AS shorter_inside, true AS disjoint
  FROM sp GROUP BY 1, 2"""))
def x9_preflight(spark, sf_dir):
    s = prepare(spark, sf_dir)
    _, sp = build(s)
    c = splice.preflight(s.turns, s.closed, s.members, s.items, s.targets, sp, splice.remap_edges(sp, s.edges), LENGTHS)
    return c.withColumn("length", F.col("length").cast("bigint"))


@query("x10_preflight_summary", splice_sql("""
  SELECT count(*) AS n_targets, count(*) FILTER (WHERE base_n + coalesce(t, 0) < 95) AS n_insufficient, (SELECT count(*) FROM rej) AS total_rejected,
         true AS all_closure_same, true AS all_base_inside, true AS all_shorter_inside, true AS all_disjoint
  FROM tg LEFT JOIN (SELECT target, sum(n_turns) AS t FROM pick GROUP BY 1) p ON p.target = tg.sid"""))
def x10_preflight_summary(spark, sf_dir):
    s = prepare(spark, sf_dir)
    p, sp = build(s)
    cars = splice.sidecar(s.targets, p, s.reports, splice.target_lengths(s.targets, LENGTHS), sp, max(LENGTHS))
    checks = splice.preflight(s.turns, s.closed, s.members, s.items, s.targets, sp, splice.remap_edges(sp, s.edges), LENGTHS)
    return splice.preflight_summary(checks, cars)


# marks and texts of the event conversations: a superseded turn, a rendered turn, three checklist items
STALE_SQL = "SELECT t.sid, t.idx, t.idx + 2 AS by FROM turns t JOIN turns s ON s.sid = t.sid AND s.idx = t.idx + 2 AND s.rev > 0 WHERE t.idx % 11 = 4"
BODY_SQL = "'User: ' || props || chr(10) || 'Assistant: ' || event_type || chr(10)"
EDGES_SQL = """
  ed AS (SELECT c.target, c.length, c.new_idx AS child, p.new_idx AS parent FROM edges e JOIN sp c ON c.sid = e.sid AND c.idx = e.child AND c.is_base = 1
      JOIN sp p ON p.target = c.target AND p.length = c.length AND p.sid = e.sid AND p.idx = e.parent AND p.is_base = 1
    UNION ALL SELECT target, length, new_idx, prev FROM (SELECT *, lag(new_idx) OVER (PARTITION BY target, length, pick ORDER BY new_idx) AS prev FROM sp WHERE is_base = 0) x WHERE prev IS NOT NULL),
  nclo0 AS (SELECT target, length, new_idx FROM sp WHERE new_idx = n_all - 1
    UNION SELECT ed.target, ed.length, ed.parent FROM nclo0 n JOIN ed ON ed.target = n.target AND ed.length = n.length AND ed.child = n.new_idx),
  nclo AS (SELECT n.* FROM nclo0 n JOIN sp USING (target, length, new_idx) WHERE new_idx < n_all - 1)"""


def superseders(turns: DataFrame) -> DataFrame:
    later = turns.where("rev > 0").select("sid", (F.col("idx") - 2).alias("idx"), F.col("idx").alias("by"))
    return turns.where("idx % 11 = 4").select("sid", "idx").join(later, ["sid", "idx"])


def bodies(turns: DataFrame) -> DataFrame:
    return turns.select("sid", "idx", "rev", render_turn(F.col("props"), F.col("event_type")).alias("body"))


def checklist(turns: DataFrame) -> DataFrame:
    items = F.array(*[F.struct(F.lit(k).alias("item_id"), F.concat(F.lit(f"item {k} of "), F.col("family")).alias("text")) for k in range(3)])
    return turns.where("rev = 0").select("sid", F.inline(items))


@query("x7_remapped_marks", splice_sql(f"""
  , st AS ({STALE_SQL}),
  m AS (SELECT a.target, a.length, 'superseded' AS kind, a.new_idx, b.new_idx AS value FROM sp a JOIN st ON st.sid = a.sid AND st.idx = a.idx AND a.is_base = 1 AND a.sid = a.target
          JOIN sp b ON b.target = a.target AND b.length = a.length AND b.sid = a.sid AND b.idx = st.by AND b.is_base = 1
    UNION ALL SELECT a.target, a.length, 'evidence', a.new_idx, NULL FROM sp a JOIN ev ON ev.sid = a.sid AND ev.idx = a.idx AND a.is_base = 1
    UNION ALL SELECT a.target, a.length, 'distractor', a.new_idx, NULL FROM sp a LEFT JOIN clo c ON c.sid = a.sid AND c.idx = a.idx AND a.is_base = 1
          WHERE c.idx IS NULL AND a.new_idx < a.n_all - 1)
  SELECT target, CAST(length AS BIGINT) AS length, kind, count(*) AS n, CAST(sum(new_idx) AS BIGINT) AS places, CAST(sum(value) AS BIGINT) AS values FROM m GROUP BY 1, 2, 3"""))
def x7_remapped_marks(spark, sf_dir):
    s = prepare(spark, sf_dir)
    _, sp = build(s)
    m = splice.remap_marks(sp, superseders(s.turns), inputs.evidence(s.closed), s.closed)
    return m.groupBy("target", big("length"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("new_idx").alias("places"), F.sum("value").alias("values"))


@query("x8_donor_lists", splice_sql("""
  SELECT w.target, CAST(w.length AS BIGINT) AS length, coalesce(u.used, '') AS used, coalesce(u.n, 0) AS n_used, r.n AS actual_length
  FROM want w JOIN (SELECT target, length, count(*) AS n FROM sp WHERE new_idx < n_all - 1 GROUP BY 1, 2) r USING (target, length)
  LEFT JOIN (SELECT w.target, w.length, string_agg(p.sid || '#' || p.branch, ' ' ORDER BY p.pick) AS used, count(*) AS n FROM want w JOIN pick p ON p.target = w.target AND p.length <= w.length GROUP BY 1, 2) u
    USING (target, length)"""))
def x8_donor_lists(spark, sf_dir):
    s = prepare(spark, sf_dir)
    p, sp = build(s)
    return splice.donor_lists(p, splice.target_lengths(s.targets, LENGTHS), sp).withColumn("length", F.col("length").cast("bigint"))


def text_tables(s: Splice, sp: DataFrame) -> dict[str, DataFrame]:
    """Inputs of the text checks: old and new turns, closures and checklists."""
    body = bodies(s.turns)
    new_turns = sp.select("target", "length", "new_idx", "rev", "sid", "idx").join(body.select("sid", "idx", "body"), ["sid", "idx"])
    old = checklist(s.turns)
    versions = sp.select("target", "length").distinct()
    return {"turns": body, "closed": s.closed, "new_closed": cut_lineage(splice.new_closure(sp, splice.remap_edges(sp, s.edges))), "checklist": old,
            "new_checklist": versions.join(old.withColumnRenamed("sid", "target"), "target"), "new_turns": new_turns.select("target", "length", "new_idx", "rev", "body")}


@query("x9_text_checks", splice_sql(f"""
  ,{EDGES_SQL},
  body AS (SELECT sid, idx, rev, {BODY_SQL} AS body FROM turns),
  oldc AS ({digest_sql("(SELECT c.sid, c.idx, b.body FROM clo c JOIN body b ON b.sid = c.sid AND b.idx = c.idx) q", "sid", "idx", "body")}),
  newc AS ({digest_sql("(SELECT n.target, n.length, n.new_idx, b.body FROM nclo n JOIN sp USING (target, length, new_idx) JOIN body b ON b.sid = sp.sid AND b.idx = sp.idx) q", "target, length", "new_idx", "body")}),
  oldl AS ({digest_sql("(SELECT sid, k, 'item ' || k || ' of ' || family AS text FROM turns CROSS JOIN (SELECT unnest(range(3)) AS k) x WHERE rev = 0) q", "sid", "k", "text")}),
  newl AS ({digest_sql("(SELECT w.target, w.length, k, 'item ' || k || ' of ' || family AS text FROM want w JOIN turns t ON t.sid = w.target AND t.rev = 0 CROSS JOIN (SELECT unnest(range(3)) AS k) x) q", "target, length", "k", "text")})
  SELECT w.target, CAST(w.length AS BIGINT) AS length, newc.digest IS NOT DISTINCT FROM oldc.digest AS context_same, sha256(nb.body) = sha256(ob.body) AS query_same,
         newl.digest IS NOT DISTINCT FROM oldl.digest AS checklist_same, coalesce(newc.digest, '') AS context_digest
  FROM want w LEFT JOIN newc USING (target, length) LEFT JOIN oldc ON oldc.sid = w.target LEFT JOIN newl USING (target, length) LEFT JOIN oldl ON oldl.sid = w.target
  JOIN sp q ON q.target = w.target AND q.length = w.length AND q.new_idx = q.n_all - 1 JOIN body nb ON nb.sid = q.sid AND nb.idx = q.idx JOIN body ob ON ob.sid = w.target AND ob.rev = 0"""))
def x9_text_checks(spark, sf_dir):
    s = prepare(spark, sf_dir)
    _, sp = build(s)
    t = text_tables(s, sp)
    digest = splice.ordered_digest(t["new_closed"].join(t["new_turns"], ["target", "length", "new_idx"]), ["target", "length"], "new_idx", "body", "context_digest").drop("n")
    d = splice.text_checks(**t).join(digest, ["target", "length"], "left")
    return d.withColumn("length", F.col("length").cast("bigint")).withColumn("context_digest", F.coalesce("context_digest", F.lit("")))
