"""Queries for result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.functions.text import is_retraction
from convgraph.operators import facts, select, tables
from convgraph.plans import inputs
from convgraph.plans.catalog_facts import COUNT, item_scores
from convgraph.plans.fact_inputs import ARMS, MODELS, answers, facts_table, verdicts
from convgraph.plans.inputs import conversation_graph, table, with_views
from convgraph.plans.registry import query, r6

LABELS = list(ARMS.values())


@query("a4_summary", with_views("facts", """
  SELECT model_key, method_label, count(*) AS n, count(checklist_score) AS n_scored,
         round(avg(context_tokens), 6) AS context_tokens, round(avg(context_precision), 6) AS context_precision,
         round(avg(checklist_score), 6) AS checklist_score, round(avg(distractor_leakage), 6) AS distractor_leakage,
         round(quantile_cont(context_tokens, 0.5), 6) AS context_tokens_median FROM facts GROUP BY 1, 2"""))
def a4_summary(spark, sf_dir):
    f = facts_table(spark, sf_dir)
    by = ["model_key", "method_label"]
    m = ["context_tokens", "context_precision", "checklist_score", "distractor_leakage"]
    out = tables.with_median(tables.summary(f, by, m), f, by, "context_tokens", "context_tokens_median")
    return out.select(*by, "n", "n_scored", *[r6(c) for c in m], r6("context_tokens_median"))


@query("a5_token_reduction", with_views("facts", """
  , s AS (SELECT model_key, method_label, avg(context_tokens) AS t FROM facts GROUP BY 1, 2)
  SELECT s.model_key, s.method_label, round(100 * (1 - s.t / f.t), 6) AS token_reduction_pct
  FROM s JOIN s f ON f.model_key = s.model_key AND f.method_label = 'full_history'"""))
def a5_token_reduction(spark, sf_dir):
    s = tables.summary(facts_table(spark, sf_dir), ["model_key", "method_label"], ["context_tokens"])
    return tables.token_reduction(s).select("model_key", "method_label", r6("token_reduction_pct"))


@query("a6_by_family_pivot", with_views("facts", "SELECT family, " + ", ".join(
    f"""round(avg(checklist_score) FILTER (WHERE model_key = '{m}' AND method_label = '{lab}'), 6) AS "{m}|{lab}" """
    for m in MODELS for lab in LABELS) + " FROM facts GROUP BY family"))
def a6_by_family_pivot(spark, sf_dir):
    cols = [f"{m}|{lab}" for m in MODELS for lab in LABELS]
    p = tables.pivot_mean(facts_table(spark, sf_dir), "family", F.concat_ws("|", "model_key", "method_label"), cols,
                          "checklist_score")
    return p.select("family", *[r6(F.col(f"`{c}`"), c) for c in cols])


@query("a7_fallback_by_family", with_views("facts", "SELECT family, " + ", ".join(
    f"""round(avg(recall_fallback) FILTER (WHERE method_label = '{lab}'), 6) AS "{lab}" """ for lab in LABELS)
    + " FROM facts GROUP BY family"))
def a7_fallback_by_family(spark, sf_dir):
    p = tables.pivot_mean(facts_table(spark, sf_dir), "family", F.col("method_label"), LABELS, "recall_fallback")
    return p.select("family", *[r6(F.col(f"`{c}`"), c) for c in LABELS])


@query("a8_variant_pivot", with_views("facts", "SELECT c_mktsegment AS variant, " + ", ".join(
    f"""round(avg(checklist_score) FILTER (WHERE method_label = '{lab}'), 6) AS "{lab}" """ for lab in LABELS)
    + " FROM facts JOIN customer ON c_custkey = scenario_id WHERE family = 'family_12' GROUP BY 1"))
def a8_variant_pivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scenario_id"), F.col("c_mktsegment").alias("variant"))
    f = facts_table(spark, sf_dir).where("family = 'family_12'").join(c, "scenario_id")
    p = tables.pivot_mean(f, "variant", F.col("method_label"), LABELS, "checklist_score")
    return p.select("variant", *[r6(F.col(f"`{c}`"), c) for c in LABELS])


@query("a9_context_identity", with_views("facts", """
  SELECT c.model_key, c.method_label, count(*) AS n, round(avg(CASE WHEN c.selected = d.selected THEN 1 ELSE 0 END), 6) AS same_context,
         round(avg(c.recall_fallback), 6) AS fallback_rate
  FROM facts c JOIN facts d ON d.model_key = c.model_key AND d.scenario_id = c.scenario_id AND d.method_label = 'oracle_dag'
  WHERE c.method_label IN ('candidate_oracle@15', 'oracle_tree') GROUP BY 1, 2"""))
def a9_context_identity(spark, sf_dir):
    t = tables.context_identity(facts_table(spark, sf_dir), ["candidate_oracle@15", "oracle_tree"])
    return t.select("model_key", "method_label", "n", r6("same_context"), r6("fallback_rate"))


@query("a10_judge_shift", with_views("facts", """
  SELECT model_key, method_label, count(*) AS n, round(avg(checklist_score), 6) AS old_mean,
         round(avg(checklist_score_alt), 6) AS new_mean, round(avg(checklist_score_alt) - avg(checklist_score), 6) AS delta
  FROM facts WHERE checklist_score IS NOT NULL AND checklist_score_alt IS NOT NULL GROUP BY 1, 2"""))
def a10_judge_shift(spark, sf_dir):
    t = tables.judge_shift(facts_table(spark, sf_dir), "checklist_score", "checklist_score_alt")
    return t.select("model_key", "method_label", "n", r6("old_mean"), r6("new_mean"), r6("delta"))


FAIL_SQL = """
  , fail AS (
    SELECT 'insufficient' AS type, scenario_id, model_key, CAST(NULL AS DOUBLE) AS full_score, CAST(NULL AS DOUBLE) AS dag
    FROM facts WHERE method_label = 'oracle_dag' AND context_sufficiency = 0
    UNION ALL
    SELECT 'full_history_not_worse', d.scenario_id, d.model_key, f.checklist_score, d.checklist_score
    FROM facts d JOIN facts f ON f.scenario_id = d.scenario_id AND f.model_key = d.model_key
    WHERE d.method_label = 'oracle_dag' AND f.method_label = 'full_history'
      AND f.checklist_score >= d.checklist_score AND f.checklist_score > 0 AND d.checklist_score < 1)"""


@query("a11_failure_cases", with_views("facts", FAIL_SQL + """
  SELECT type, scenario_id, model_key, round(full_score, 6) AS "full", round(dag, 6) AS dag FROM fail"""))
def a11_failure_cases(spark, sf_dir):
    f = tables.failure_cases(facts_table(spark, sf_dir))
    return f.select("type", "scenario_id", "model_key", r6("full"), r6("dag"))


@query("a11_failure_counts", with_views("facts", FAIL_SQL + """
  SELECT type, model_key, count(*) AS n, count(*) FILTER (WHERE full_score = dag) AS n_tied,
         count(*) FILTER (WHERE full_score > dag) AS n_strict FROM fail GROUP BY 1, 2"""))
def a11_failure_counts(spark, sf_dir):
    return tables.failure_counts(tables.failure_cases(facts_table(spark, sf_dir)))


@query("a14_length_cells", with_views("facts", """
  SELECT model_key, method_label, length, count(*) AS n, count(checklist_score) AS n_scored,
         round(avg(checklist_score), 6) AS checklist, round(avg(distractor_leakage), 6) AS leakage,
         round(avg(context_tokens), 6) AS context_tokens, round(avg(context_precision), 6) AS context_precision
  FROM facts GROUP BY 1, 2, 3"""))
def a14_length_cells(spark, sf_dir):
    t = tables.summary(facts_table(spark, sf_dir), ["model_key", "method_label", "length"],
                       ["checklist_score", "distractor_leakage", "context_tokens", "context_precision"])
    return t.select("model_key", "method_label", "length", "n", "n_scored", r6(F.col("checklist_score"), "checklist"),
                    r6(F.col("distractor_leakage"), "leakage"), r6("context_tokens"), r6("context_precision"))


@query("a15_leakage_by_length", with_views("facts", """
  , x AS (SELECT model_key AS model, length, distractor_leakage AS l FROM facts WHERE method_label = 'full_history'
          UNION ALL SELECT 'pooled', length, distractor_leakage FROM facts WHERE method_label = 'full_history')
  SELECT model, round(avg(l) FILTER (WHERE length = 'base'), 6) AS leak_base, round(avg(l) FILTER (WHERE length = '30'), 6) AS leak_30,
         round(avg(l) FILTER (WHERE length = '60'), 6) AS leak_60,
         coalesce(avg(l) FILTER (WHERE length = '60') > avg(l) FILTER (WHERE length = 'base'), false) AS rises FROM x GROUP BY 1"""))
def a15_leakage_by_length(spark, sf_dir):
    t = tables.leakage_by_length(facts_table(spark, sf_dir), ["base", "30", "60"])
    return t.select("model", r6("leak_base"), r6("leak_30"), r6("leak_60"), "rises")


@query("a16_retractions", with_views("facts", """
  , x AS (SELECT *, CASE WHEN regexp_matches(substring(response, 1, 600), '(?i)made up|cannot verify') THEN 1 ELSE 0 END AS rt FROM facts)
  SELECT model_key, method_label, count(*) AS n, CAST(sum(rt) AS BIGINT) AS retractions, round(avg(rt), 6) AS retraction_rate,
         round(avg(checklist_score) FILTER (WHERE rt = 1), 6) AS score_retracted,
         round(avg(checklist_score) FILTER (WHERE rt = 0), 6) AS score_other FROM x GROUP BY 1, 2"""))
def a16_retractions(spark, sf_dir):
    f = facts_table(spark, sf_dir).withColumn("retraction", is_retraction(F.col("response")).cast("int"))
    return tables.retraction_table(f).select("model_key", "method_label", "n", "retractions", r6("retraction_rate"),
                                             r6("score_retracted"), r6("score_other"))


META_SQL = """
  , meta AS (
    SELECT t.sid, any_value(t.family) AS family, count(*) FILTER (WHERE t.rev > 0) AS n_history,
           CAST(sum(t.cost) FILTER (WHERE t.rev > 0) AS BIGINT) AS tokens,
           count(c.idx)::DOUBLE / count(*) FILTER (WHERE t.rev > 0) AS closure_ratio
    FROM turns t LEFT JOIN clo c ON c.sid = t.sid AND c.idx = t.idx GROUP BY t.sid),
  att AS (SELECT user_id AS sid, event_id AS attempt, value AS ratio, value >= 50 AS pass,
                 CASE WHEN event_type <> 'error' THEN value END AS gold_median FROM events),
  first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY attempt) AS rn FROM att) x WHERE rn = 1)"""


def attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("scenario_id"), F.col("event_id").alias("attempt"), F.col("value").alias("ratio"),
                    (F.col("value") >= 50).alias("pass"),
                    F.when(F.col("event_type") != "error", F.col("value")).alias("gold_median"))


@query("a17_validation_by_family", with_views("turns clo", META_SQL + """
  SELECT family, count(*) AS n, round(avg(n_history), 6) AS history, round(avg(tokens), 6) AS tokens,
         round(quantile_cont(closure_ratio, 0.5), 6) AS closure_ratio_median, round(avg(CAST(pass AS INT)), 6) AS gate_pass_first
  FROM meta LEFT JOIN first ON first.sid = meta.sid GROUP BY family"""))
def a17_validation_by_family(spark, sf_dir):
    from convgraph.operators.graph import closure_ratio

    t, _, closed = conversation_graph(spark, sf_dir)
    per = t.where("rev > 0").groupBy("sid").agg(F.first("family").alias("family"), F.sum("cost").alias("tokens"))
    first = facts.first_by_key(attempts(spark, sf_dir), ["scenario_id"], ["attempt"]).select(
        F.col("scenario_id").alias("sid"), "pass")
    m = per.join(closure_ratio(t, closed), "sid").join(first, "sid", "left")
    out = m.groupBy("family").agg(
        COUNT(), r6(F.avg("n_history"), "history"), r6(F.avg("tokens"), "tokens"),
        r6(F.avg(F.col("pass").cast("int")), "gate_pass_first"))
    med = tables.split_percentile(m, ["family"], "closure_ratio", {"closure_ratio_median": 0.5},
                                  F.floor(F.col("closure_ratio") * 64))
    return out.join(med.select("family", r6("closure_ratio_median")), "family")


@query("a18_first_attempt_rate", with_views("turns clo", META_SQL + """
  SELECT count(*) AS n, round(avg(CAST(pass AS INT)), 6) AS first_attempt_rate, avg(CAST(pass AS INT)) < 0.8 AS stop
  FROM first WHERE gold_median IS NOT NULL AND sid IN (SELECT sid FROM clo)"""))
def a18_first_attempt_rate(spark, sf_dir):
    closed = conversation_graph(spark, sf_dir).closed
    accepted = closed.select(F.col("sid").alias("scenario_id")).distinct()
    return tables.first_attempt_rate(attempts(spark, sf_dir), accepted, 0.8).select("n", r6("first_attempt_rate"), "stop")


@query("a21_instance_counts", with_views("facts ver", """
  SELECT f.model_key, f.family, count(*) AS n, count(DISTINCT f.scenario_id) AS n_scenarios, count(f.checklist_score) AS n_scored,
         round(avg(CASE WHEN v.judge_prompt_variant = 'fallback' THEN 1 ELSE 0 END), 6) AS fallback_share
  FROM facts f LEFT JOIN ver v ON v.key = f.key AND v.judge_model = 'ref' GROUP BY 1, 2"""))
def a21_instance_counts(spark, sf_dir):
    v = verdicts(spark, sf_dir).where("judge_model = 'ref'").select("key", "judge_prompt_variant")
    f = facts_table(spark, sf_dir).join(v, "key", "left")
    return f.groupBy("model_key", "family").agg(
        COUNT(), F.count_distinct("scenario_id").alias("n_scenarios"), F.count("checklist_score").alias("n_scored"),
        r6(F.avg(F.when(F.col("judge_prompt_variant") == "fallback", 1.0).otherwise(0.0)), "fallback_share"))


@query("a22_billed_usd", with_views("ans", """
  SELECT model_key, count(*) AS n, round(avg(usd), 6) AS usd_per_answer FROM ans WHERE usd > 0 GROUP BY 1"""))
def a22_billed_usd(spark, sf_dir):
    return answers(spark, sf_dir).where("usd > 0").groupBy("model_key").agg(COUNT(), r6(F.avg("usd"), "usd_per_answer"))


@query("a23_exact_agreement", with_views("iscore", """
  SELECT judge, count(*) AS n, round(avg(CASE WHEN abs(cand_score - ref_score) < 1e-9 THEN 1 ELSE 0 END), 6) AS exact_share
  FROM iscore GROUP BY judge"""))
def a23_exact_agreement(spark, sf_dir):
    same = F.when(F.abs(F.col("cand_score") - F.col("ref_score")) < 1e-9, 1.0).otherwise(0.0)
    return item_scores(spark, sf_dir).groupBy("judge").agg(COUNT(), r6(F.avg(same), "exact_share"))


@query("a25_variant_pivot", with_views("facts", """
  SELECT scenario_id, round(avg(checklist_score) FILTER (WHERE length = 'base'), 6) AS base,
         round(avg(checklist_score) FILTER (WHERE length = '30'), 6) AS l30, round(avg(checklist_score) FILTER (WHERE length = '60'), 6) AS l60
  FROM facts WHERE method_label = 'candidate_oracle@15' GROUP BY 1"""))
def a25_variant_pivot(spark, sf_dir):
    f = facts_table(spark, sf_dir).where("method_label = 'candidate_oracle@15'")
    p = tables.pivot_mean(f, "scenario_id", F.col("length"), ["base", "30", "60"], "checklist_score")
    return p.select("scenario_id", r6("base"), r6(F.col("`30`"), "l30"), r6(F.col("`60`"), "l60"))


@query("a27_changed_verdicts", with_views("ver", """
  SELECT count(*) AS n, count(*) FILTER (WHERE n.checklist_score <> o.checklist_score) AS n_changed,
         round(avg(abs(n.checklist_score - o.checklist_score)), 6) AS mean_abs_change
  FROM ver o JOIN ver n ON n.key = o.key AND n.judge_model = 'alt' WHERE o.judge_model = 'ref'
    AND o.checklist_score IS NOT NULL AND n.checklist_score IS NOT NULL"""))
def a27_changed_verdicts(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    o = v.where("judge_model = 'ref'").select("key", F.col("checklist_score").alias("o"))
    n = v.where("judge_model = 'alt'").select("key", F.col("checklist_score").alias("n"))
    d = F.col("n") - F.col("o")
    return o.join(n, "key").where(d.isNotNull()).agg(
        COUNT("n"), F.count_if(d != 0).alias("n_changed"), r6(F.avg(F.abs(d)), "mean_abs_change"))


@query("a28_judge_costs", with_views("ver", """
  SELECT judge_model, round(sum(usd), 6) AS usd_total, round(avg(usd), 6) AS usd_per_call,
         count(*) FILTER (WHERE judge_prompt_variant = 'fallback') AS fallback_prompt_uses,
         string_agg(DISTINCT coalesce(judge_route, ''), ';' ORDER BY coalesce(judge_route, '')) AS routes FROM ver GROUP BY 1"""))
def a28_judge_costs(spark, sf_dir):
    return tables.judge_costs(verdicts(spark, sf_dir)).select(
        "judge_model", r6("usd_total"), r6("usd_per_call"), "fallback_prompt_uses", "routes")


@query("a30_instance_deltas", with_views("iscore", """
  SELECT judge, key, method_label, round(ref_score, 6) AS ref_score, round(cand_score, 6) AS cand_score,
         round(cand_score - ref_score, 6) AS delta FROM iscore"""))
def a30_instance_deltas(spark, sf_dir):
    return item_scores(spark, sf_dir).select(
        "judge", "key", "method_label", r6("ref_score"), r6("cand_score"),
        r6(F.col("cand_score") - F.col("ref_score"), "delta"))


@query("p26_recall_holds", with_views("facts", """
  SELECT method_label, count(*) AS n, round(avg(checklist_score), 6) AS checklist_score FROM (
    SELECT method_label, checklist_score FROM facts
    UNION ALL SELECT concat(method_label, '[recall-holds]'), checklist_score FROM facts
    WHERE starts_with(method_label, 'candidate_oracle') AND recall_fallback = 0) x GROUP BY 1"""))
def p26_recall_holds(spark, sf_dir):
    return tables.summary(tables.recall_holds(facts_table(spark, sf_dir)), ["method_label"], ["checklist_score"]).select(
        "method_label", "n", r6("checklist_score"))


@query("p28_display_table", with_views("facts", """
  SELECT CASE model_key WHEN 'F' THEN 'Model F' WHEN 'O' THEN 'Model O' ELSE 'Model P' END AS model, method_label,
         printf('%.1f%%', 100 * round(avg(checklist_score), 4)) AS score FROM facts GROUP BY 1, 2"""))
def p28_display_table(spark, sf_dir):
    from convgraph.functions.text import display_name, one_decimal

    s = tables.summary(facts_table(spark, sf_dir), ["model_key", "method_label"], ["checklist_score"])
    return s.select(display_name(F.col("model_key"), {"F": "Model F", "O": "Model O", "P": "Model P"}).alias("model"),
                    "method_label", F.concat(one_decimal(100 * F.round("checklist_score", 4)), F.lit("%")).alias("score"))


PRICES = {"F": (3.0, 15.0), "O": (1.0, 5.0), "P": (0.6, 2.4)}
OUTPUT_TOKENS = 350  # assumed of an answer (fixed value)


@query("c11_dry_run", with_views("turns win retr clo ev", """
  , sel AS (SELECT sid, 'full_history' AS method, CAST(NULL AS BIGINT) AS budget, cost FROM turns WHERE rev > 0
    UNION ALL SELECT sid, 'rolling_summary', budget, cost FROM win UNION ALL SELECT sid, 'semantic_retrieval', budget, cost FROM retr
    UNION ALL SELECT t.sid, 'oracle_dag', NULL, t.cost FROM turns t JOIN clo c ON c.sid = t.sid AND c.idx = t.idx),
  arms AS (SELECT * FROM (VALUES ('full_history', NULL), ('rolling_summary', 1024), ('rolling_summary', 2048),
           ('semantic_retrieval', 1024), ('semantic_retrieval', 2048), ('oracle_dag', NULL)) v(method, budget)),
  tok AS (SELECT q.sid, a.method, a.budget, coalesce(sum(s.cost), 0) + CASE WHEN a.method = 'rolling_summary' THEN 200 ELSE 0 END AS t
          FROM turns q CROSS JOIN arms a LEFT JOIN sel s ON s.sid = q.sid AND s.method = a.method AND s.budget IS NOT DISTINCT FROM a.budget
          WHERE q.rev = 0 GROUP BY 1, 2, 3),
  sel2 AS (SELECT sid, 'full_history' AS method, CAST(NULL AS BIGINT) AS budget, idx FROM turns WHERE rev > 0
    UNION ALL SELECT sid, 'rolling_summary', budget, idx FROM win UNION ALL SELECT sid, 'semantic_retrieval', budget, idx FROM retr UNION ALL SELECT sid, 'oracle_dag', NULL, idx FROM clo),
  hit AS (SELECT s.sid, s.method, s.budget, count(*) AS h FROM sel2 s JOIN ev ON ev.sid = s.sid AND ev.idx = s.idx GROUP BY 1, 2, 3),
  nev AS (SELECT sid, count(*) AS n FROM ev GROUP BY 1),
  ql AS (SELECT k.method, k.budget, avg(CASE WHEN e.n IS NULL THEN 1.0 ELSE coalesce(h.h, 0) / e.n END) AS rec, avg(CASE WHEN coalesce(h.h, 0) = coalesce(e.n, 0) THEN 1.0 ELSE 0.0 END) AS suf
         FROM tok k LEFT JOIN nev e ON e.sid = k.sid LEFT JOIN hit h ON h.sid = k.sid AND h.method = k.method AND h.budget IS NOT DISTINCT FROM k.budget GROUP BY 1, 2)
  SELECT p.model_key, tok.method, CAST(tok.budget AS BIGINT) AS budget, count(*) AS n, CAST(sum(t) AS BIGINT) AS input_tokens, round(avg(t), 6) AS mean_tokens,
         round(sum(t) * p.rate / 1e6, 6) AS usd, round(any_value(ql.rec), 6) AS context_recall, round(any_value(ql.suf), 6) AS context_sufficiency,
         round(count(*) * 350 * p.out / 1e6, 6) AS output_usd, round(sum(t) * p.rate / 1e6 + count(*) * 350 * p.out / 1e6, 6) AS total_usd
  FROM tok JOIN ql ON ql.method = tok.method AND ql.budget IS NOT DISTINCT FROM tok.budget
  CROSS JOIN (VALUES ('F', 3.0::DOUBLE, 15.0::DOUBLE), ('O', 1.0, 5.0), ('P', 0.6, 2.4)) p(model_key, rate, out) GROUP BY p.model_key, p.rate, p.out, tok.method, tok.budget"""))
def c11_dry_run(spark, sf_dir):
    from convgraph.operators.metrics import flag_evidence, instances, selection_metrics
    from convgraph.operators.select import Method
    from convgraph.operators.spend import dry_run

    t, e, closed = conversation_graph(spark, sf_dir)
    cos = select.similarity(t, inputs.vectors(spark, sf_dir), carry=("cost",))
    methods = [Method("full_history"), *[Method(m, b) for m in ("rolling_summary", "semantic_retrieval") for b in inputs.BUDGETS],
               Method("oracle_dag")]
    sel = select.select_context(t, e, methods, cosine=cos)
    plan = instances(t, [(m.name, m.budget) for m in methods])
    quality = selection_metrics(flag_evidence(t, inputs.evidence(closed)), sel, plan)
    out = dry_run(plan, sel, PRICES, OUTPUT_TOKENS, quality)
    return out.select("model_key", "method", "budget", "n", "input_tokens", *[r6(c) for c in (
        "mean_tokens", "usd", "context_recall", "context_sufficiency", "output_usd", "total_usd")])
