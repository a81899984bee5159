"""Queries on corpus rules, over conversations with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage
from convgraph.operators import longrules, quality
from convgraph.operators.quality import FAMILIES, Corpus
from convgraph.plans import inputs
from convgraph.plans.inputs import NEEDS, VIEWS, conversation_graph, with_views
from convgraph.plans.registry import big, query, r6

_FAM_SQL = "[" + ", ".join(f"'{f}'" for f in FAMILIES) + "]"
SHORT = "the answer must not guess"
LONG = "the answer names the agreed plan and date"


def corpus(spark, sf_dir) -> Corpus:
    """Conversations as scenarios; the residue of sid by 26 decides which defect is planted."""
    t, e, closed = conversation_graph(spark, sf_dir)
    r, i = F.col("sid") % 26, F.col("idx")
    tid = lambda c: F.concat(F.lit("t"), c.cast("string"))
    is_q = F.col("rev") == 0
    stale_at = (i % 9 == 4) & (F.col("rev") > 3)
    sup = (F.when(stale_at & (r == 8), F.lit("t9999")).when(stale_at & (r == 9), F.lit(None)).when(stale_at & (r == 19), tid(i - 1))
           .when(stale_at, tid(i + 2)))
    turns = t.select(
        "sid", i.alias("pos"), F.when((r == 2) & (i == 3), "t2").otherwise(tid(i)).alias("turn_id"),
        F.when((r == 3) & (i == 4), i + 1).otherwise(i).alias("turn_index"),
        F.when((r == 10) & (i == 5), "  ").when((r == 11) & (i == 6), "Meanwhile, back to our plan")
        .otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).alias("user_message"),
        F.when(is_q & (r != 14), F.lit(None)).when((r == 15) & (i == 7), "").otherwise(F.concat(F.lit("answer "), F.col("event_id").cast("string"))).alias("assistant_message"),
        (stale_at & (r != 20)).alias("stale"), sup.alias("superseded_by"), is_q.alias("is_query"))
    turns = cut_lineage(turns)
    c10 = F.col("child") % 10 == 6
    par = e.select("sid", tid(F.col("child")).alias("turn_id"),
                   F.when((r == 5) & c10, "t9999").when((r == 6) & c10, tid(F.col("child"))).otherwise(tid(F.col("parent"))).alias("parent_id"),
                   "pos", F.explode(F.when((r == 7) & c10, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_x")).drop("_x")
    ev = inputs.evidence(closed).select("sid", "idx", F.lit(True).alias("_e"))
    hist = t.where("rev > 0").select("sid", "idx").join(ev, ["sid", "idx"], "left")
    evid = F.col("_e").isNotNull()
    kinds = F.array(
        F.when(evid, "evidence"), F.when((~evid & ~((r == 18) & (i == 1))) | (evid & (r == 17)), "distractor"),
        F.when(evid & (F.col("sid") % 3 == 0), "span"), F.when(~evid & (r == 13) & (i % 7 == 2), "span"))
    marks = hist.select("sid", tid(i).alias("turn_id"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))
    last = t.where("rev = 0").select("sid", "idx", r.alias("r"))
    extra = last.where("r = 16").select("sid", tid(F.col("idx")).alias("turn_id"), F.lit("distractor").alias("kind")).unionByName(
        last.where("r = 12").select("sid", F.lit("t9998").alias("turn_id"), F.lit("evidence").alias("kind")))
    fam = F.when(r == 1, "unknown").otherwise(F.get(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("sid") % 13).cast("int")))
    scen = last.select("sid", fam.alias("family"), (F.col("sid") % 20 == 0).alias("has_note"))
    n_items = F.when(r == 21, 1).when(r == 25, 5).otherwise(3)
    check = last.select("sid", "r", F.explode(F.sequence(F.lit(1), n_items)).alias("k")).select(
        "sid", F.when((F.col("r") == 22) & (F.col("k") == 3), "c2").otherwise(F.concat(F.lit("c"), F.col("k").cast("string"))).alias("item_id"),
        F.when((F.col("k") == 2) & (F.col("r") != 24), SHORT).otherwise(LONG).alias("criterion"), (F.col("r") != 23).alias("required"))
    return Corpus(scen, turns, par, marks.unionByName(extra), check)


VIEWS["qt"] = f"""
  SELECT sid, idx AS pos, CASE WHEN sid % 26 = 2 AND idx = 3 THEN 't2' ELSE concat('t', idx) END AS turn_id,
    CASE WHEN sid % 26 = 3 AND idx = 4 THEN idx + 1 ELSE idx END AS turn_index,
    CASE WHEN sid % 26 = 10 AND idx = 5 THEN '  ' WHEN sid % 26 = 11 AND idx = 6 THEN 'Meanwhile, back to our plan' ELSE concat(event_type, ' ', event_id) END AS user_message,
    CASE WHEN rev = 0 AND sid % 26 <> 14 THEN NULL WHEN sid % 26 = 15 AND idx = 7 THEN '' ELSE concat('answer ', event_id) END AS assistant_message,
    idx % 9 = 4 AND rev > 3 AND sid % 26 <> 20 AS stale,
    CASE WHEN idx % 9 = 4 AND rev > 3 THEN CASE sid % 26 WHEN 8 THEN 't9999' WHEN 9 THEN NULL WHEN 19 THEN concat('t', idx - 1) ELSE concat('t', idx + 2) END END AS superseded_by,
    rev = 0 AS is_query FROM turns"""
VIEWS["qp"] = """
  SELECT sid, concat('t', child) AS turn_id, CASE WHEN sid % 26 = 5 AND child % 10 = 6 THEN 't9999' WHEN sid % 26 = 6 AND child % 10 = 6 THEN concat('t', child)
         ELSE concat('t', parent) END AS parent_id, pos FROM edges
  UNION ALL SELECT sid, concat('t', child), concat('t', parent), pos FROM edges WHERE sid % 26 = 7 AND child % 10 = 6"""
VIEWS["qm"] = """
  SELECT sid, concat('t', idx) AS turn_id, 'evidence' AS kind FROM flagged WHERE is_evidence
  UNION ALL SELECT sid, concat('t', idx), 'distractor' FROM flagged WHERE rev > 0 AND ((NOT is_evidence AND NOT (sid % 26 = 18 AND idx = 1)) OR (is_evidence AND sid % 26 = 17))
  UNION ALL SELECT sid, concat('t', idx), 'span' FROM flagged WHERE (is_evidence AND sid % 3 = 0) OR (rev > 0 AND NOT is_evidence AND sid % 26 = 13 AND idx % 7 = 2)
  UNION ALL SELECT sid, concat('t', idx), 'distractor' FROM turns WHERE rev = 0 AND sid % 26 = 16
  UNION ALL SELECT sid, 't9998', 'evidence' FROM turns WHERE rev = 0 AND sid % 26 = 12"""
VIEWS["qs"] = f"""
  SELECT sid, CASE WHEN sid % 26 = 1 THEN 'unknown' ELSE {_FAM_SQL}[sid % 13 + 1] END AS family, sid % 20 = 0 AS has_note FROM turns WHERE rev = 0"""
VIEWS["qc"] = f"""
  SELECT sid, CASE WHEN sid % 26 = 22 AND k = 3 THEN 'c2' ELSE concat('c', k) END AS item_id,
         CASE WHEN k = 2 AND sid % 26 <> 24 THEN '{SHORT}' ELSE '{LONG}' END AS criterion, sid % 26 <> 23 AS required
  FROM (SELECT sid, unnest(range(1, CASE sid % 26 WHEN 21 THEN 2 WHEN 25 THEN 6 ELSE 4 END)) AS k FROM turns WHERE rev = 0) x"""
VIEWS["qfirst"] = """
  SELECT sid, 'V1 unknown family' AS rule, 'error' AS severity FROM qs WHERE family = 'unknown'
  UNION ALL SELECT sid, 'V2 duplicate turn id', 'error' FROM (SELECT sid, turn_id FROM qt GROUP BY 1, 2 HAVING count(*) > 1) x
  UNION ALL SELECT sid, 'V3 turn_index out of order', 'error' FROM qt WHERE turn_index <> pos
  UNION ALL SELECT sid, 'V4 turn count', 'warn' FROM (SELECT sid, count(*) AS n FROM qt GROUP BY 1) x WHERE n NOT BETWEEN 6 AND 45
  UNION ALL SELECT p.sid, CASE WHEN o.turn_id IS NULL THEN 'V5 parent missing' ELSE 'V6 parent not earlier' END, 'error'
    FROM qp p JOIN qid c ON c.sid = p.sid AND c.turn_id = p.turn_id LEFT JOIN qid o ON o.sid = p.sid AND o.turn_id = p.parent_id
    WHERE o.turn_id IS NULL OR o.at >= c.at
  UNION ALL SELECT sid, 'V7 duplicate parents', 'error' FROM (SELECT DISTINCT sid, turn_id FROM (SELECT sid, turn_id, parent_id FROM qp GROUP BY 1, 2, 3 HAVING count(*) > 1) y) x
  UNION ALL SELECT t.sid, CASE WHEN o.turn_id IS NULL THEN 'V8a superseder missing' ELSE 'V8b superseder not later' END, 'error'
    FROM qt t LEFT JOIN qid o ON o.sid = t.sid AND o.turn_id = t.superseded_by WHERE t.superseded_by IS NOT NULL AND (o.turn_id IS NULL OR o.at <= t.turn_index)
  UNION ALL SELECT sid, 'V8c superseder on a turn that is not stale', 'error' FROM qt WHERE superseded_by IS NOT NULL AND NOT stale
  UNION ALL SELECT sid, 'V9 stale without superseder', 'error' FROM qt WHERE stale AND superseded_by IS NULL
  UNION ALL SELECT sid, 'V10 blank user message', 'error' FROM qt WHERE trim(user_message) = ''
  UNION ALL SELECT sid, 'V11 signposting', 'error' FROM qt WHERE regexp_matches(user_message, '(?i)\\bmeanwhile\\b|\\bback to (the|our|my)\\b')
  UNION ALL SELECT m.sid, 'V12 mark on a missing turn', 'error' FROM qm m LEFT JOIN qid i ON i.sid = m.sid AND i.turn_id = m.turn_id WHERE i.sid IS NULL AND kind <> 'span'
  UNION ALL SELECT sid, 'V13 span outside evidence', 'error' FROM (SELECT sid, turn_id FROM qm GROUP BY 1, 2 HAVING bool_or(kind = 'span') AND NOT bool_or(kind = 'evidence')) x
  UNION ALL SELECT sid, 'V14 query has an answer', 'error' FROM qt WHERE is_query AND assistant_message IS NOT NULL
  UNION ALL SELECT sid, 'V15 blank answer in history', 'error' FROM qt WHERE NOT is_query AND trim(coalesce(assistant_message, '')) = ''
  UNION ALL SELECT DISTINCT m.sid, 'V16 query is marked', 'error' FROM qm m JOIN qt t ON t.sid = m.sid AND t.turn_id = m.turn_id AND t.is_query WHERE kind <> 'span'
  UNION ALL SELECT sid, 'V17 evidence and distractor overlap', 'error' FROM (SELECT sid, turn_id FROM qm GROUP BY 1, 2 HAVING bool_or(kind = 'evidence') AND bool_or(kind = 'distractor')) x
  UNION ALL SELECT t.sid, 'V18 history turn not covered', 'warn' FROM (SELECT DISTINCT sid, turn_id FROM qt WHERE NOT is_query) t
    WHERE NOT EXISTS (SELECT 1 FROM qm m WHERE m.sid = t.sid AND m.turn_id = t.turn_id AND kind <> 'span')""".replace("\\\\", "\\")
VIEWS["qid"] = "SELECT sid, turn_id, max_by(turn_index, pos) AS at FROM qt GROUP BY 1, 2"
VIEWS["qclean"] = "SELECT sid FROM qs WHERE sid NOT IN (SELECT sid FROM qfirst WHERE severity = 'error')"
VIEWS["qall"] = f"""
  SELECT * FROM qfirst
  UNION ALL SELECT s.sid, CASE WHEN s.has_note THEN 'V19 closure differs, reviewed' ELSE 'V19 closure differs, flagged' END, 'warn'
    FROM qs s JOIN qclean USING (sid) WHERE EXISTS (SELECT 1 FROM clo c WHERE c.sid = s.sid AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.sid = c.sid AND ev.idx = c.idx))
  UNION ALL SELECT t.sid, 'V20 superseder outside the closure', 'error' FROM qt t JOIN qclean USING (sid) JOIN clo c ON c.sid = t.sid AND c.idx = t.pos
    WHERE t.stale AND NOT EXISTS (SELECT 1 FROM clo d WHERE d.sid = t.sid AND concat('t', d.idx) = t.superseded_by)
  UNION ALL SELECT sid, 'V21 checklist size', 'warn' FROM qc GROUP BY sid HAVING count(*) NOT BETWEEN 2 AND 4
  UNION ALL SELECT sid, 'V22 duplicate checklist id', 'error' FROM qc GROUP BY sid HAVING count(DISTINCT item_id) < count(*)
  UNION ALL SELECT sid, 'V23 nothing required', 'error' FROM qc GROUP BY sid HAVING NOT bool_or(required)
  UNION ALL SELECT sid, 'V24 no negative item', 'error' FROM qc JOIN qs USING (sid) WHERE family NOT IN ('continuation', 'new_root', 'unknown')
    GROUP BY sid HAVING NOT bool_or(contains(criterion, 'must not'))
  UNION ALL SELECT sid, 'V25 short criterion', 'warn' FROM qc WHERE len(string_split(criterion, ' ')) < 6"""
NEEDS.update({"qt": ("turns",), "qp": ("edges",), "qm": ("flagged",), "qs": ("turns",), "qc": ("turns",), "qid": ("qt",),
              "qfirst": ("qt", "qid", "qp", "qm", "qs"), "qclean": ("qs", "qfirst"), "qall": ("qfirst", "qclean", "clo", "ev", "qc")})


@query("v1_v25_violations", with_views("qall", "SELECT sid, rule, severity, count(*) AS n FROM qall GROUP BY 1, 2, 3"))
def v1_v25_violations(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return quality.violations(c)


@query("v26_corpus_report", with_views("qall", """
  , m AS (SELECT sid, count(*) FILTER (WHERE kind = 'evidence') AS e, count(*) FILTER (WHERE kind = 'distractor') AS d FROM qm GROUP BY 1),
  v AS (SELECT sid, count(*) FILTER (WHERE severity = 'error') AS ne, count(*) FILTER (WHERE severity = 'warn') AS nw FROM qall GROUP BY 1)
  SELECT t.sid, CASE WHEN coalesce(any_value(ne), 0) > 0 THEN 'ERR' ELSE 'OK' END AS status, count(*) AS n_turns, coalesce(any_value(e), 0) AS n_evidence,
         coalesce(any_value(d), 0) AS n_distractors, coalesce(any_value(ne), 0) AS n_errors, coalesce(any_value(nw), 0) AS n_warnings
  FROM qt t LEFT JOIN m ON m.sid = t.sid LEFT JOIN v ON v.sid = t.sid GROUP BY t.sid"""))
def v26_corpus_report(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return quality.report(c, quality.violations(c))


@query("v26_admitted", with_views("qall", """
  SELECT family, count(*) AS n FROM qs WHERE sid NOT IN (SELECT sid FROM qall WHERE severity = 'error') GROUP BY 1"""))
def v26_admitted(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return quality.admitted(c, quality.violations(c)).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


TARGETS = {f: 12 for f in FAMILIES} | {"absent": 3}


@query("v27_family_counts", with_views("qs", """
  , t AS (SELECT unnest(""" + _FAM_SQL + """) AS family, 12 AS target UNION ALL SELECT 'absent', 3),
  n AS (SELECT family, count(*) AS n FROM qs GROUP BY 1)
  SELECT family, coalesce(n.n, 0) AS n, CAST(coalesce(t.target, 0) AS BIGINT) AS target FROM n FULL JOIN t USING (family)
  WHERE coalesce(n.n, 0) <> coalesce(t.target, 0)"""))
def v27_family_counts(spark, sf_dir):
    t = inputs.turns(spark, sf_dir).where("rev = 0").select("sid")
    fam = F.when(F.col("sid") % 26 == 1, "unknown").otherwise(F.get(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("sid") % 13).cast("int")))
    return quality.family_counts(t.select("sid", fam.alias("family")), TARGETS)


# ---- long-conversation rules

VIEWS["lt"] = """
  SELECT t.sid, t.idx, t.rev, t.family, concat('t', t.idx) AS turn_id, concat(event_type, ' asks ', event_id % 50) AS user_message,
         CASE WHEN rev > 0 THEN concat(repeat(concat('word', event_id % 10, ' '), 3 + event_id % 9), 'K', json_extract_string(props, '$.k')) END AS assistant_message,
         t.cost, t.is_evidence, t.is_distractor FROM flagged t"""
VIEWS["lreg"] = """
  SELECT sid, name FROM (SELECT sid, unnest(['click', 'View', concat('k', sid % 100), concat('Word', sid % 10), 'Purchase']) AS name FROM turns WHERE rev = 0) x
  UNION SELECT sid, 'error' FROM turns WHERE rev = 0 AND sid % 2 = 0"""
VIEWS["leff"] = """
  SELECT DISTINCT r.sid, r.name FROM lreg r JOIN lt t ON t.sid = r.sid AND t.rev > 0
   AND CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.sid = r.sid) THEN t.is_evidence ELSE t.idx < 2 END
   AND contains(lower(concat(t.user_message, chr(10), t.assistant_message)), lower(r.name))"""
NEEDS.update({"lt": ("flagged",), "lreg": ("turns",), "leff": ("lreg", "lt", "ev")})


def long_corpus(spark, sf_dir):
    from convgraph.operators.metrics import flag_evidence

    t, e, closed = conversation_graph(spark, sf_dir)
    f = flag_evidence(t, inputs.evidence(closed))
    eid = F.col("event_id")
    word = F.concat(F.lit("word"), (eid % 10).cast("string"), F.lit(" "))
    turns = f.select(
        "sid", "idx", "rev", "family", F.concat(F.lit("t"), F.col("idx").cast("string")).alias("turn_id"),
        F.concat("event_type", F.lit(" asks "), (eid % 50).cast("string")).alias("user_message"),
        F.when(F.col("rev") > 0, F.concat(F.repeat(word, (3 + eid % 9).cast("int")), F.lit("K"), F.get_json_object("props", "$.k"))).alias("assistant_message"),
        "cost", "vec_id", "is_evidence", "is_distractor")
    s = F.col("sid")
    names = F.array(F.lit("click"), F.lit("View"), F.concat(F.lit("k"), (s % 100).cast("string")),
                    F.concat(F.lit("Word"), (s % 10).cast("string")), F.lit("Purchase"), F.when(s % 2 == 0, F.lit("error")))
    reg = t.where("rev = 0").select("sid", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("name"))
    return cut_lineage(turns), reg, e, closed


@query("q1_thin_turns", with_views("lt", """
  SELECT sid, count(*) AS n FROM lt WHERE rev > 0 AND (length(user_message) < 15 OR length(coalesce(assistant_message, '')) < 40) GROUP BY sid"""))
def q1_thin_turns(spark, sf_dir):
    return longrules.thin_turns(long_corpus(spark, sf_dir)[0]).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@query("q2_short_history", with_views("lt", """
  , s AS (SELECT sid, sum(cost) AS tok FROM lt WHERE rev > 0 GROUP BY 1 HAVING sum(cost) < 7000)
  SELECT sid, turn_id, n_chars, tok AS full_tokens FROM (
    SELECT l.sid, turn_id, length(coalesce(assistant_message, '')) AS n_chars, CAST(s.tok AS BIGINT) AS tok,
           row_number() OVER (PARTITION BY l.sid ORDER BY length(coalesce(assistant_message, '')), idx) AS rn
    FROM lt l JOIN s ON s.sid = l.sid WHERE rev > 0) x WHERE rn <= 8"""))
def q2_short_history(spark, sf_dir):
    q = longrules.short_history(long_corpus(spark, sf_dir)[0], 7000)
    return q.select("sid", "turn_id", big("n_chars"), "full_tokens")


@query("q3_effective_registry", with_views("lreg leff", """
  SELECT r.sid, count(*) AS n_registry, count(e.name) AS n_effective, count(*) < 6 AS too_small, count(e.name) < 2 AS too_few_used
  FROM lreg r LEFT JOIN leff e ON e.sid = r.sid AND e.name = r.name GROUP BY r.sid"""))
def q3_effective_registry(spark, sf_dir):
    t, reg, *_ = long_corpus(spark, sf_dir)
    return longrules.registry_check(reg, longrules.effective_registry(t, reg), 6, 2)


def _branch_sql() -> str:
    from convgraph.plans.catalog_context import BRANCH_SQL

    return BRANCH_SQL


@query("q4_branch_entities", with_views("turns edges clo leff lt", f"""
  , {_branch_sql()}
  SELECT b.sid, b.root, count(DISTINCT e.name) AS n_hits, count(DISTINCT e.name) < 2 AS fails
  FROM branch b LEFT JOIN lt t ON t.sid = b.sid AND t.idx = b.idx
  LEFT JOIN leff e ON e.sid = b.sid AND contains(lower(concat(t.user_message, chr(10), t.assistant_message)), lower(e.name)) GROUP BY 1, 2"""))
def q4_branch_entities(spark, sf_dir):
    from convgraph.operators.graph import donor_branches

    t, reg, e, closed = long_corpus(spark, sf_dir)
    b = donor_branches(t, e, closed)
    return longrules.branch_entities(t, b, longrules.effective_registry(t, reg), 2)


@query("q5_near_miss", with_views("lt", """
  SELECT q.sid, concat('t', q.sid % 50) AS near_miss FROM lt q WHERE q.rev = 0
  AND NOT EXISTS (SELECT 1 FROM lt d WHERE d.sid = q.sid AND d.is_distractor AND d.idx = q.sid % 50)"""))
def q5_near_miss(spark, sf_dir):
    t = long_corpus(spark, sf_dir)[0]
    near = t.where("rev = 0").select("sid", F.concat(F.lit("t"), (F.col("sid") % 50).cast("string")).alias("near_miss"))
    return longrules.near_miss_faults(t, near)


CITE_SQL = """
  cite AS (SELECT q.sid, q.family, CAST(k AS BIGINT) AS item, CASE WHEN k = 3 THEN 'The answer must not guess' ELSE 'names it' END AS criterion,
             CASE WHEN k = 1 AND q.sid % 4 = 0 THEN [] WHEN k = 1 THEN [CAST(q.idx - 1 AS VARCHAR), concat('t', q.idx - 2)] ELSE [concat(' t', q.idx - 3)] END AS refs
           FROM lt q CROSS JOIN (VALUES (1), (2), (3)) v(k) WHERE q.rev = 0),
  ref AS (SELECT sid, item, criterion, CASE WHEN regexp_matches(trim(r), '^[0-9]+$') THEN concat('t', trim(r)) ELSE trim(r) END AS turn_id
          FROM (SELECT sid, item, criterion, unnest(refs) AS r FROM cite) x)"""


def citations(t):
    i = F.col("idx")
    s = lambda c: c.cast("string")
    base = t.where("rev = 0").select("sid", "family", i, F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 2, 3)])).alias("item"))
    refs = (F.when((F.col("item") == 1) & (F.col("sid") % 4 == 0), F.array().cast("array<string>"))
            .when(F.col("item") == 1, F.array(s(i - 1), F.concat(F.lit("t"), s(i - 2))))
            .otherwise(F.array(F.concat(F.lit(" t"), s(i - 3)))))
    return base.select("sid", "family", "item", F.when(F.col("item") == 3, "The answer must not guess").otherwise("names it").alias("criterion"),
                       refs.alias("refs"))


@query("q6_cited_evidence", with_views("lt ev", f""", {CITE_SQL}
  SELECT sid, item, 'cites nothing' AS fault, CAST(1 AS BIGINT) AS n FROM cite WHERE len(refs) = 0 AND family <> 'family_3' AND NOT starts_with(lower(criterion), 'the answer must not')
  UNION ALL SELECT sid, item, 'cites turns outside the closure', count(*) FROM ref r
  WHERE NOT starts_with(lower(criterion), 'the answer must not') AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.sid = r.sid AND concat('t', ev.idx) = r.turn_id) GROUP BY 1, 2"""))
def q6_cited_evidence(spark, sf_dir):
    t = long_corpus(spark, sf_dir)[0]
    return longrules.citation_faults(t, citations(t), ["family_3"])


@query("q7_join_branches", with_views("lt ev", f""", {CITE_SQL}
  SELECT q.sid, count(DISTINCT e.idx % 7) AS n_branches FROM lt q LEFT JOIN ref r ON r.sid = q.sid
  LEFT JOIN ev e ON e.sid = r.sid AND concat('t', e.idx) = r.turn_id WHERE q.rev = 0 AND q.family IN ('family_4', 'family_5')
  GROUP BY q.sid HAVING count(DISTINCT e.idx % 7) < 2"""))
def q7_join_branches(spark, sf_dir):
    t = long_corpus(spark, sf_dir)[0]
    branch = t.where("is_evidence").select("sid", "turn_id", (F.col("idx") % 7).alias("branch"))
    return longrules.join_faults(t, citations(t), branch, ["family_4", "family_5"])


GATE_SQL = """
  gm AS (SELECT c.sid, quantile_cont(c.cosine, 0.5) FILTER (WHERE f.is_evidence) AS gold, quantile_cont(c.cosine, 0.5) FILTER (WHERE f.is_distractor) AS dis
         FROM cosine c JOIN flagged f ON f.sid = c.sid AND f.idx = c.idx GROUP BY 1)"""


@query("q8_cosine_gate", with_views("cosine flagged", f""", {GATE_SQL}
  SELECT sid, round(gold, 6) AS gold_median, round(dis, 6) AS distractor_median, round(CASE WHEN gold <> 0 THEN dis / gold END, 6) AS ratio,
         gold IS NULL OR coalesce(gold <> 0 AND dis / gold >= 0.6, false) AS pass FROM gm"""))
def q8_cosine_gate(spark, sf_dir):
    from convgraph.operators.select import similarity

    t = long_corpus(spark, sf_dir)[0]
    g = longrules.cosine_gate(t, similarity(t, inputs.vectors(spark, sf_dir)), 0.6)
    return g.select("sid", r6("gold_median"), r6("distractor_median"), r6("ratio"), "pass")


@query("q9_sidecar", with_views("cosine flagged clo lreg", f""", {GATE_SQL}
  SELECT t.sid, any_value(t.family) AS family, count(*) FILTER (WHERE t.rev > 0) AS n_history, CAST(sum(t.cost) FILTER (WHERE t.rev > 0) AS BIGINT) AS full_history_tokens,
         round(count(c.idx)::DOUBLE / count(*) FILTER (WHERE t.rev > 0), 6) AS closure_ratio, any_value(r.n) AS n_registry, round(any_value(g.gold), 6) AS gold_median
  FROM flagged t LEFT JOIN clo c ON c.sid = t.sid AND c.idx = t.idx LEFT JOIN (SELECT sid, count(*) AS n FROM lreg GROUP BY 1) r ON r.sid = t.sid
  LEFT JOIN gm g ON g.sid = t.sid GROUP BY t.sid"""))
def q9_sidecar(spark, sf_dir):
    from convgraph.operators.select import similarity

    t, reg, _, closed = long_corpus(spark, sf_dir)
    gate = longrules.cosine_gate(t, similarity(t, inputs.vectors(spark, sf_dir)), 0.6)
    return longrules.sidecar(t, closed, reg, gate).select(
        "sid", "family", big("n_history"), "full_history_tokens", r6("closure_ratio"), "n_registry", r6("gold_median"))


@query("q10_error_triage", """
  , e AS (SELECT user_id AS sid, CASE WHEN event_id % 3 = 0 THEN concat('t', event_id % 40, ' is too thin') WHEN event_id % 3 = 1
      THEN concat('t', event_id % 40, '.user_message contains topic-switch signposting') ELSE CASE WHEN user_id % 4 = 0 THEN 'entity_registry has 2 entries' ELSE concat('t', event_id % 40, ' is too thin') END END AS error FROM events)
  SELECT sid, count(DISTINCT regexp_extract(error, '^(t[0-9]+)\\b', 1)) FILTER (WHERE regexp_matches(error, '^t[0-9]+\\b')) AS n_turns,
         bool_and(contains(error, 'topic-switch signposting') OR contains(error, 'is too thin')) AS repairable FROM e GROUP BY sid""".replace("  , e AS", "WITH e AS", 1).replace("\\\\", "\\"))
def q10_error_triage(spark, sf_dir):
    ev = inputs.table(spark, sf_dir, "events")
    k, tid = F.col("event_id") % 3, F.concat(F.lit("t"), (F.col("event_id") % 40).cast("string"))
    thin = F.concat(tid, F.lit(" is too thin"))
    err = (F.when(k == 0, thin).when(k == 1, F.concat(tid, F.lit(".user_message contains topic-switch signposting")))
           .otherwise(F.when(F.col("user_id") % 4 == 0, F.lit("entity_registry has 2 entries")).otherwise(thin)))
    return longrules.triage(ev.select(F.col("user_id").alias("sid"), err.alias("error")))
