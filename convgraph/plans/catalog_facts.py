"""Queries on work plans, keys and fact joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage
from convgraph.operators import facts, select
from convgraph.operators.select import Method
from convgraph.plans import inputs
from convgraph.plans.fact_inputs import (MODELS, answers, answers_log, candidate_items, facts_table, item_log,
                                         judged_instances, verdict_log, verdicts)
from convgraph.plans.inputs import conversation_graph, table, with_views
from convgraph.plans.registry import CRC_TABLE, big, crc32_sql, query, r6

COUNT = lambda a="n": F.count(F.lit(1)).alias(a)
COMPARISONS = [("oracle_dag", "full_history"), ("oracle_dag", "oracle_tree"),
               ("oracle_dag", "semantic_retrieval@1024"), ("candidate_oracle@15", "full_history"),
               ("semantic_retrieval@1024", "full_history")]
COMPARISON_SQL = "cmp AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in COMPARISONS) + ") v(a, b))"


@query("p2_instance_key", """
  SELECT concat_ws('|', c_custkey, m.method, coalesce(CAST(m.budget AS VARCHAR), '-'), c_mktsegment) AS key,
         length(c_name) AS name_chars
  FROM customer CROSS JOIN (VALUES ('full_history', NULL), ('sliding_window', 1024)) m(method, budget)""")
def p2_instance_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "seg")
    p = facts.plan_instances(c, ["m"], ["full_history", "sliding_window"], [1024])
    return p.select(facts.instance_key(F.col("c_custkey"), F.col("method"), F.col("budget"), F.col("seg")).alias("key"),
                    F.length("c_name").cast("bigint").alias("name_chars"))


@query("p3_method_label", """
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE concat(o_orderpriority, '@', (o_orderkey % 3) * 512) END
         AS method_label, count(*) AS n FROM orders GROUP BY 1""")
def p3_method_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    budget = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise((F.col("o_orderkey") % 3 * 512).cast("double"))
    return o.groupBy(facts.method_label(F.col("o_orderpriority"), budget).alias("method_label")).agg(COUNT())


@query("p4_parse_methods", """
  SELECT o_orderpriority AS method, CAST(o_orderkey % 3 AS BIGINT) AS budget, count(*) AS n FROM orders GROUP BY 1, 2
  UNION ALL SELECT 'oracle_dag', NULL, count(*) FROM orders""")
def p4_parse_methods(spark, sf_dir):
    spec = F.concat(F.col("o_orderpriority"), F.lit("@"), (F.col("o_orderkey") % 3).cast("string"), F.lit(", oracle_dag"))
    m = table(spark, sf_dir, "orders").select(F.inline(facts.parse_methods(spec)))
    return m.groupBy("method", "budget").agg(COUNT())


PLAN_METHODS = ["full_history", "sliding_window", "semantic_retrieval", "oracle_tree", "oracle_dag"]


@query("p5_plan_instances", """
  SELECT model_key, method, budget, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS sum_id
  FROM customer CROSS JOIN (VALUES ('F'), ('O'), ('P')) m(model_key)
  CROSS JOIN (VALUES ('full_history', CAST(NULL AS BIGINT)), ('sliding_window', 1024), ('sliding_window', 2048),
    ('semantic_retrieval', 1024), ('semantic_retrieval', 2048), ('oracle_tree', NULL), ('oracle_dag', NULL)) a(method, budget)
  GROUP BY 1, 2, 3""")
def p5_plan_instances(spark, sf_dir):
    p = facts.plan_instances(table(spark, sf_dir, "customer").select("c_custkey"), MODELS, PLAN_METHODS, [1024, 2048])
    return p.groupBy("model_key", "method", "budget").agg(COUNT(), F.sum("c_custkey").alias("sum_id"))


@query("p6_plan_candidates", """
  SELECT model_key, method, CAST(budget AS BIGINT) AS budget, CAST(stage AS BIGINT) AS stage, count(*) AS n
  FROM customer CROSS JOIN (VALUES ('F', 'candidate_oracle', 15, 1), ('O', 'candidate_oracle', 15, 1),
    ('P', 'candidate_oracle', 15, 1), ('F', 'candidate_oracle', 5, 2), ('F', 'candidate_oracle', 10, 2),
    ('O', 'candidate_oracle', 5, 2), ('O', 'candidate_oracle', 10, 2), ('P', 'full_history', NULL, 1),
    ('P', 'oracle_dag', NULL, 1)) p(model_key, method, budget, stage) GROUP BY 1, 2, 3, 4""")
def p6_plan_candidates(spark, sf_dir):
    p = facts.plan_candidates(table(spark, sf_dir, "customer"), {"F": [5, 10], "O": [5, 10], "P": []}, 15,
                              {"P": [Method("full_history"), Method("oracle_dag")]})
    return p.groupBy("model_key", "method", "budget", big("stage")).agg(COUNT())


@query("p7_matched_arms", with_views("turns clo", """
  , m AS (SELECT q.sid, CAST(sum(t.cost) AS BIGINT) AS matched FROM turns q LEFT JOIN clo c ON c.sid = q.sid
          LEFT JOIN turns t ON t.sid = c.sid AND t.idx = c.idx WHERE q.rev = 0 GROUP BY q.sid)
  SELECT sid, label, CAST(CASE WHEN label = 'semantic_retrieval@matched' THEN coalesce(matched, 0)
                               WHEN label = 'semantic_retrieval@1024' THEN 1024 END AS BIGINT) AS budget
  FROM m CROSS JOIN (VALUES ('full_history'), ('oracle_dag'), ('semantic_retrieval@matched'), ('semantic_retrieval@1024')) a(label)"""))
def p7_matched_arms(spark, sf_dir):
    t, _, closed = conversation_graph(spark, sf_dir)
    cost = select.from_closure(t, closed, "oracle_dag").groupBy("sid").agg(F.sum("cost").alias("c"))
    m = t.where("rev = 0").select("sid").join(cost, "sid", "left").select("sid", F.coalesce("c", F.lit(0)).alias("matched_budget"))
    return facts.matched_arms(m, 1024)


@query("p8_prefix_filter", """
  SELECT c_nationkey, count(*) AS n FROM customer
  WHERE starts_with(c_name, 'Customer#0000001') OR starts_with(c_name, 'Customer#0000007') GROUP BY 1""")
def p8_prefix_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(facts.has_prefix(F.col("c_name"), ["Customer#0000001", "Customer#0000007"]))
    return c.groupBy("c_nationkey").agg(COUNT())


@query("p9_first_per_family", """
  SELECT c_nationkey, c_custkey FROM (
    SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) x
  WHERE rn <= 8""")
def p9_first_per_family(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return facts.first_per_group(c, "c_nationkey", "c_custkey", 8)


@query("p29_drop_wide", with_views("facts", """
  SELECT key, scenario_id, family, method_label, model_key, context_tokens, checklist_score FROM facts"""))
def p29_drop_wide(spark, sf_dir):
    f = facts.drop_wide(facts_table(spark, sf_dir))
    assert "prompt" not in f.columns and "response" not in f.columns
    return f.select("key", "scenario_id", "family", "method_label", "model_key", "context_tokens", "checklist_score")


@query("p30_second_judge_work", with_views("ans ver", """
  SELECT model_key, method_label, count(*) AS n FROM ans a
  WHERE (method_label IN ('oracle_dag', 'full_history') OR model_key = 'P' OR method_label = 'candidate_oracle@15')
    AND NOT EXISTS (SELECT 1 FROM ver v WHERE v.key = a.key AND v.judge_model = 'alt') GROUP BY 1, 2"""))
def p30_second_judge_work(spark, sf_dir):
    a = answers(spark, sf_dir)
    want = a.where(F.col("method_label").isin("oracle_dag", "full_history") | (F.col("model_key") == "P")
                   | (F.col("method_label") == "candidate_oracle@15"))
    done = verdict_log(spark, sf_dir).where("judge_model = 'alt'")
    return facts.pending(want, done, ["key"]).groupBy("model_key", "method_label").agg(COUNT())


@query("s6_pending_work", with_views("ans", """
  , plan AS (SELECT c_custkey, m.model_key, a.method_label,
                    concat_ws('|', c_custkey, a.method_label, '-', m.model_key) AS key
             FROM customer CROSS JOIN (VALUES ('F'), ('O'), ('P')) m(model_key)
             CROSS JOIN (VALUES ('full_history'), ('oracle_tree'), ('oracle_dag')) a(method_label))
  SELECT model_key, method_label, count(*) AS n FROM plan p
  WHERE NOT EXISTS (SELECT 1 FROM ans d WHERE d.key = p.key) GROUP BY 1, 2"""))
def s6_pending_work(spark, sf_dir):
    p = facts.plan_instances(table(spark, sf_dir, "customer").select("c_custkey"), MODELS,
                             ["full_history", "oracle_tree", "oracle_dag"], [])
    p = p.withColumn("key", facts.instance_key(F.col("c_custkey"), F.col("method"), F.col("budget"), F.col("model_key")))
    left = facts.pending(p, answers_log(spark, sf_dir), ["key"])
    return left.groupBy("model_key", F.col("method").alias("method_label")).agg(COUNT())


@query("s7_hash_shard", with_views("alog", f""",
  {CRC_TABLE}, k AS (SELECT DISTINCT key FROM alog)
  SELECT {crc32_sql("key")} % 4 AS shard, count(*) AS n FROM k, crc_table GROUP BY 1"""))
def s7_hash_shard(spark, sf_dir):
    a = answers_log(spark, sf_dir).select("key").distinct()
    parts = [facts.shard(a, "key", k, 4).agg(F.lit(k).cast("bigint").alias("shard"), COUNT()) for k in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("s8_limited_work", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50")
def s8_limited_work(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(50)


def _folder(spark, name: str) -> str:
    """A new folder in the shared one, for a round trip."""
    import uuid

    from convgraph.functions.lineage import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _scenarios(spark, sf_dir):
    """The conversations as scenario documents: pairs of messages are turns, each the child of the one before."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.floor(F.col("turn") / 2).cast("int"))
    said = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    t = c.groupBy("conv_id", "k").agg(said("user").alias("u"), said("assistant").alias("a"))
    turn = F.struct("k", F.concat(F.lit("t"), F.col("k") + 1).alias("turn_id"), F.col("k").alias("turn_index"), F.col("u").alias("user_message"), F.col("a").alias("assistant_message"),
                    F.when(F.col("k") > 0, F.array(F.concat(F.lit("t"), "k"))).alias("gold_parents"))
    d = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = F.transform("turns", lambda x: x.dropFields("k"))
    return d.select(F.concat(F.lit("s"), "conv_id").alias("scenario_id"), F.concat(F.lit("family_"), F.col("conv_id") % 13).alias("family"), turns.alias("turns"))


TURNS_SQL = """
  SELECT 's' || conv_id AS scenario_id, 'family_' || conv_id % 13 AS family, turn // 2 AS k, max(text) FILTER (WHERE role = 'user') AS u,
         max(text) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id, turn // 2"""


@query("s1_scenario_documents", f"""
  SELECT scenario_id, family, '1.0' AS benchmark_version, count(*) AS n_turns, CAST(sum(coalesce(length(u), 0) + coalesce(length(a), 0)) AS BIGINT) AS n_chars,
         CAST(count(*) - 1 AS BIGINT) AS n_edges, md5(string_agg(coalesce(u, '') || coalesce(a, ''), '' ORDER BY k)) AS digest FROM ({TURNS_SQL}) x GROUP BY 1, 2""")
def s1_scenario_documents(spark, sf_dir):
    """Scenario documents written (S2), read with defaults and flattened (S1)."""
    from convgraph.sources import documents

    path = _folder(spark, "scenarios")
    documents.write_scenarios(_scenarios(spark, sf_dir).withColumn("benchmark_version", F.lit("1.0")), path)
    s = documents.read_scenarios(spark, path, lines=True)
    texts = F.transform("turns", lambda t: F.concat(F.coalesce(t["user_message"], F.lit("")), F.coalesce(t["assistant_message"], F.lit(""))))
    edges = F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + F.size(t["gold_parents"]))
    return s.select("scenario_id", "family", "benchmark_version", F.size("turns").cast("bigint").alias("n_turns"), F.length(F.array_join(texts, "")).cast("bigint").alias("n_chars"),
                    edges.alias("n_edges"), F.md5(F.array_join(texts, "")).alias("digest"))


def _event_log(spark, sf_dir, path: str, broken: str) -> None:
    """The events as JSON lines; ``broken``: a cut line at the end of a file, or before another line."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    lines = e.select("event_id", F.to_json(F.struct(*e.columns)).alias("j"))
    lines.where("event_id % 100 <> 0").select("j").write.mode("append").text(path)
    rest = lines.where("event_id % 100 = 0")
    cut, nl = F.substring("j", 1, 15), F.lit("\n")
    rest.select(F.concat("j", nl, cut) if broken == "tail" else F.concat(cut, nl, "j")).coalesce(1).limit(1).write.mode("append").text(path)
    rest.coalesce(1).offset(1).select("j").write.mode("append").text(path)


EVENT_LOG = "event_id bigint, user_id bigint, event_type string, value double"


@query("s3_log_scan", """
  SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(1 AS BIGINT) AS n_cut_tails FROM events GROUP BY 1""")
def s3_log_scan(spark, sf_dir):
    """A JSON-lines log read past the half-written line at the end of a file."""
    from convgraph.sources import logs

    path = _folder(spark, "log")
    _event_log(spark, sf_dir, path, "tail")
    tails = logs.broken_lines(spark, path, EVENT_LOG).agg(F.sum("n_tail").alias("n_cut_tails"))
    d = logs.read_log(spark, path, EVENT_LOG, "tail").groupBy("event_type").agg(COUNT(), F.sum("event_id").alias("ids"), F.count_distinct("user_id").alias("users"))
    return d.join(F.broadcast(tails))  # one row


@query("s4_strict_scan", "SELECT CAST(count(*) AS BIGINT) AS n_lines, true AS tail_raises, true AS middle_raises FROM events")
def s4_strict_scan(spark, sf_dir):
    """A strict scan raises on any broken line, the tolerant one on a line that is not the last."""
    from convgraph.sources import logs

    tail, middle = _folder(spark, "log"), _folder(spark, "log")
    _event_log(spark, sf_dir, tail, "tail")
    _event_log(spark, sf_dir, middle, "middle")

    def raises(path: str, on_bad: str) -> bool:
        try:
            logs.read_log(spark, path, EVENT_LOG, on_bad).agg(F.sum("event_id")).collect()
        except Exception as e:  # noqa: BLE001
            return "whole records" in str(e) or "MALFORMED" in str(e)
        return False

    n = logs.broken_lines(spark, tail, EVENT_LOG).agg(F.sum(F.col("n_lines") - F.col("n_broken")).alias("n_lines"))
    return n.select("n_lines", F.lit(raises(tail, "fail")).alias("tail_raises"), F.lit(raises(middle, "tail")).alias("middle_raises"))


@query("s5_appended_records", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def s5_appended_records(spark, sf_dir):
    """Records appended to a JSON-lines log in two runs, read back."""
    from convgraph.sources import logs, sinks

    path, o = _folder(spark, "append"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sinks.append_records(o.where("o_orderkey % 2 = 0"), path)
    sinks.append_records(o.where("o_orderkey % 2 <> 0"), path)
    return logs.read_log(spark, path, "o_orderkey bigint, o_orderstatus string", "fail").groupBy("o_orderstatus").agg(COUNT(), F.sum("o_orderkey").alias("keys"))


@query("s11_sidecars", """
  SELECT n_name, r_name, count(c_custkey) AS n_customers, CAST(coalesce(sum(c_custkey), 0) AS BIGINT) AS keys FROM nation JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def s11_sidecars(spark, sf_dir):
    """One sidecar document per nation, in a folder of its own, read back flattened with the name."""
    from convgraph.sources import documents

    path = _folder(spark, "sidecars")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))
    d = n.join(c, "n_nationkey", "left").select("n_name", F.struct(F.col("r_name").alias("name")).alias("region"), F.struct("n", "keys").alias("customers"))
    d.repartition("n_name").write.partitionBy("n_name").option("pretty", "true").json(path)
    got = documents.read_sidecars(spark, path, "n_name string, region struct<name:string>, customers struct<n:bigint,keys:bigint>")
    z = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return got.select("n_name", F.col("region.name").alias("r_name"), z(F.col("customers.n")).alias("n_customers"), z(F.col("customers.keys")).alias("keys"))


@query("s12_csv_table", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1, 2")
def s12_csv_table(spark, sf_dir):
    """A result table written as CSV and read back."""
    from convgraph.sources import logs, sinks

    path = _folder(spark, "csv")
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(COUNT(), F.round(F.sum("o_totalprice"), 2).alias("price"))
    sinks.write_csv(o, path, single_file=True)
    return logs.read_table(spark, path, "o_orderpriority string, o_orderstatus string, n bigint, price double")


@query("s13_pivot_table", """
  SELECT CAST(l_shipdate_year AS VARCHAR) AS year, l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT year(l_shipdate) AS l_shipdate_year, * FROM lineitem) x GROUP BY 1, 2, 3""")
def s13_pivot_table(spark, sf_dir):
    """A pivot with two header rows, written and read back in long form."""
    from convgraph.sources import logs, sinks

    path = _folder(spark, "pivot")
    heads = ("l_returnflag", "l_linestatus")
    long = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), *heads).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sinks.write_pivot(long, "year", heads, "n", path)
    return logs.read_pivot(spark, path, "year", heads, "n")


@query("s10_selection_cache", with_views("win", """
  SELECT CAST(t.sid AS VARCHAR) AS scenario_id, t.budget, count(w.idx) AS n, CAST(coalesce(sum(w.idx), 0) AS BIGINT) AS sum_idx, CAST(0 AS BIGINT) AS computed_again
  FROM (SELECT DISTINCT sid, CAST(budget AS BIGINT) AS budget FROM turns CROSS JOIN budgets) t LEFT JOIN win w ON w.sid = t.sid AND w.budget = t.budget GROUP BY 1, 2"""))
def s10_selection_cache(spark, sf_dir):
    """Selections of all conversations and budgets, written in two runs and read back; a third run finds nothing to do."""
    import uuid

    from convgraph.functions.lineage import shared_dir
    from convgraph.sources import caches

    t = cut_lineage(inputs.turns(spark, sf_dir))
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    caches.update_selection_cache(t.where("sid % 3 = 0"), inputs.BUDGETS[:1], select.sliding_window, path)
    caches.update_selection_cache(t, inputs.BUDGETS, select.sliding_window, path)
    again = caches.update_selection_cache(t, inputs.BUDGETS, select.sliding_window, path)
    rows = caches.read_cache_folder(spark, path)
    ids = F.transform("selected", lambda x: x.cast("bigint"))
    return rows.select("scenario_id", "budget", F.size("selected").cast("bigint").alias("n"), F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_idx"),
                       F.lit(again).cast("bigint").alias("computed_again"))


@query("s9_selection_cache", with_views("win", """
  SELECT sid, CAST(budget AS BIGINT) AS budget, count(*) AS n, CAST(sum(idx) AS BIGINT) AS sum_idx FROM win GROUP BY 1, 2"""))
def s9_selection_cache(spark, sf_dir):
    from convgraph.sources.caches import parse_selection_cache

    w = select.sliding_window(inputs.turns(spark, sf_dir), inputs.BUDGETS)
    entry = w.groupBy("sid", "budget").agg(F.sort_array(F.collect_list("idx")).alias("ids"))
    text = F.to_json(F.create_map(F.concat_ws("|", F.col("sid").cast("string"), F.col("budget").cast("string")),
                                  F.transform("ids", lambda x: x.cast("string"))))
    rows = parse_selection_cache(entry.select(text.alias("value"), F.lit(0).alias("priority")))
    turns = rows.where("selected is not null").select("scenario_id", "budget", F.explode("selected").alias("t"))
    return turns.groupBy(F.col("scenario_id").cast("bigint").alias("sid"), "budget").agg(
        COUNT(), F.sum(F.col("t").cast("bigint")).alias("sum_idx"))


@query("s14_json_summary", """
  SELECT concat('{"n_orders":', count(*), ',"n_customers":', count(DISTINCT o_custkey), '}') AS value FROM orders""")
def s14_json_summary(spark, sf_dir):
    from convgraph.sources.sinks import as_json

    o = table(spark, sf_dir, "orders").agg(COUNT("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))
    return as_json(o)


@query("s15_log_line_count", """
  SELECT lang, CAST(sum(len(regexp_extract_all(text, '(?m)^.*(que|the|der).*$'))) AS BIGINT) AS n_lines,
         count(*) AS n_docs FROM documents GROUP BY lang""")
def s15_log_line_count(spark, sf_dir):
    from convgraph.sources.sinks import matching_lines

    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.sum(matching_lines(F.col("text"), "(que|the|der)")).cast("bigint").alias("n_lines"),
                                 COUNT("n_docs"))


@query("s16_sample_keys", with_views("ans", """
  SELECT model_key, count(*) AS n FROM ans
  WHERE key IN (SELECT concat_ws('|', c_custkey, 'oracle_dag', '-', 'F') FROM customer WHERE c_acctbal > 5000) GROUP BY 1"""))
def s16_sample_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(
        F.concat_ws("|", F.col("c_custkey").cast("string"), F.lit("oracle_dag"), F.lit("-"), F.lit("F")).alias("key"))
    return answers(spark, sf_dir).join(keys, "key", "left_semi").groupBy("model_key").agg(COUNT())


@query("j1_answers_with_verdicts", with_views("facts", """
  SELECT model_key, method_label, count(*) AS n, count(checklist_score) AS n_scored,
         round(avg(checklist_score), 6) AS checklist_score FROM facts GROUP BY 1, 2"""))
def j1_answers_with_verdicts(spark, sf_dir):
    v = verdicts(spark, sf_dir).where("judge_model = 'ref'")
    f = facts.with_verdicts(answers(spark, sf_dir), v, ["checklist_score"])
    return f.groupBy("model_key", "method_label").agg(
        COUNT(), F.count("checklist_score").alias("n_scored"), r6(F.avg("checklist_score"), "checklist_score"))


@query("j2_paired_arms", with_views("facts", f""", {COMPARISON_SQL}
  SELECT c.a, c.b, x.model_key, count(*) AS n, round(avg(x.checklist_score - y.checklist_score), 6) AS mean_diff
  FROM cmp c JOIN facts x ON x.method_label = c.a
  JOIN facts y ON y.method_label = c.b AND y.scenario_id = x.scenario_id AND y.model_key = x.model_key
  WHERE x.checklist_score IS NOT NULL AND y.checklist_score IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5"""))
def j2_paired_arms(spark, sf_dir):
    p = facts.pair_arms(facts_table(spark, sf_dir), COMPARISONS, ["scenario_id", "model_key"], ["checklist_score"])
    p = p.where("checklist_score_a is not null and checklist_score_b is not null")
    return p.groupBy("a", "b", "model_key").agg(
        COUNT(), r6(F.avg(F.col("checklist_score_a") - F.col("checklist_score_b")), "mean_diff")).where("n >= 5")


@query("j3_merged_sources", with_views("alog vlog", """
  , a1 AS (SELECT *, CASE WHEN tie % 2 = 0 THEN 0 ELSE 1 END AS src FROM alog),
  a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src DESC, ts DESC, tie DESC) AS rn FROM a1) x WHERE rn = 1),
  v1 AS (SELECT *, CASE WHEN tie % 2 = 0 THEN 0 ELSE 1 END AS src FROM vlog WHERE judge_model = 'ref'),
  v2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, ts, tie) AS rn FROM v1) x WHERE rn = 1)
  SELECT a2.key, a2.tie AS answer_tie, v2.tie AS verdict_tie, round(v2.checklist_score, 6) AS checklist_score
  FROM a2 LEFT JOIN v2 ON v2.key = a2.key"""))
def j3_merged_sources(spark, sf_dir):
    a, v = answers_log(spark, sf_dir), verdict_log(spark, sf_dir).where("judge_model = 'ref'")
    even = F.col("tie") % 2 == 0
    am = facts.merge_sources([a.where(even), a.where(~even)], ["key"], ["ts", "tie"], later_wins=True)
    vm = facts.merge_sources([v.where(even), v.where(~even)], ["key"], ["ts", "tie"], later_wins=False)
    return am.select("key", F.col("tie").alias("answer_tie")).join(
        vm.select("key", F.col("tie").alias("verdict_tie"), r6("checklist_score")), "key", "left")


@query("j4_identical_prompts", with_views("ans", """
  SELECT a.scenario_id, a.model_key, a.key AS key_a, b.key AS key_b FROM ans a
  JOIN ans b ON b.scenario_id = a.scenario_id AND b.model_key = a.model_key AND b.prompt = a.prompt
  WHERE a.method_label = 'candidate_oracle@15' AND b.method_label = 'oracle_dag' AND a.copied_from IS NULL"""))
def j4_identical_prompts(spark, sf_dir):
    return facts.identical_prompt_pairs(answers(spark, sf_dir), "candidate_oracle@15", "oracle_dag")


@query("j5_reuse_answers", with_views("ans", """
  SELECT model_key, count(*) AS n, count(reused) AS n_reused FROM (
    SELECT p.model_key, CASE WHEN f.selected = p.selected THEN f.key END AS reused
    FROM ans p LEFT JOIN ans f ON f.scenario_id = p.scenario_id AND f.model_key = p.model_key AND f.method_label = 'full_history'
    WHERE p.method_label = 'candidate_oracle@15') x GROUP BY 1"""))
def j5_reuse_answers(spark, sf_dir):
    a = answers(spark, sf_dir)
    plan = a.where("method_label = 'candidate_oracle@15'").select("scenario_id", "model_key", "selected")
    full = a.where("method_label = 'full_history'")
    return facts.reuse(plan, full, ["scenario_id", "model_key"]).groupBy("model_key").agg(
        COUNT(), F.count("copied_from").alias("n_reused"))


@query("j6_inherit_verdicts", with_views("ans ver", """
  , c AS (SELECT a.key, a.copied_from FROM ans a WHERE a.copied_from IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM ver v WHERE v.key = a.key AND v.judge_model = 'alt'))
  SELECT c.key, round(s.checklist_score, 6) AS inherited_score, s.key IS NULL AS todo
  FROM c LEFT JOIN ver s ON s.key = c.copied_from AND s.judge_model = 'alt'"""))
def j6_inherit_verdicts(spark, sf_dir):
    copied = answers(spark, sf_dir).where("copied_from is not null").select("key", "copied_from")
    return facts.inherit(copied, verdicts(spark, sf_dir), "alt").select("key", r6("inherited_score"), "todo")


@query("j7_override_verdicts", with_views("ver", """
  SELECT o.key, round(o.checklist_score, 6) AS old_score, n.key IS NOT NULL AND n.checklist_score IS NOT NULL AS overridden,
         round(coalesce(n.checklist_score, o.checklist_score), 6) AS checklist_score
  FROM ver o LEFT JOIN ver n ON n.key = o.key AND n.judge_model = 'alt' AND n.judge_route = 'east'
  WHERE o.judge_model = 'ref'"""))
def j7_override_verdicts(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    o = facts.override(v.where("judge_model = 'ref'"), v.where("judge_model = 'alt' and judge_route = 'east'"))
    return o.select("key", r6("old_score"), "overridden", r6("checklist_score"))


@query("j9_before_after", with_views("ver ans", """
  , m AS (SELECT v.judge_model, a.method_label, avg(v.checklist_score) AS s FROM ver v JOIN ans a ON a.key = v.key GROUP BY 1, 2)
  SELECT x.method_label, round(x.s, 6) AS before, round(y.s, 6) AS after, round(y.s - x.s, 6) AS difference
  FROM m x JOIN m y ON y.method_label = x.method_label WHERE x.judge_model = 'ref' AND y.judge_model = 'alt'"""))
def j9_before_after(spark, sf_dir):
    a = answers(spark, sf_dir).select("key", "method_label")
    m = verdicts(spark, sf_dir).join(a, "key").groupBy("judge_model", "method_label").agg(F.avg("checklist_score").alias("s"))
    d = facts.before_after(m.where("judge_model = 'ref'"), m.where("judge_model = 'alt'"), ["method_label"], "s")
    return d.select("method_label", r6("before"), r6("after"), r6("difference"))


@query("j10_scenario_attributes", with_views("ans", """
  SELECT c.c_mktsegment AS variant, a.method_label, count(*) AS n, round(avg(a.context_precision), 6) AS context_precision
  FROM ans a JOIN customer c ON c.c_custkey = a.scenario_id WHERE a.family = 'family_12' GROUP BY 1, 2"""))
def j10_scenario_attributes(spark, sf_dir):
    a = answers(spark, sf_dir).where("family = 'family_12'")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scenario_id"), F.col("c_mktsegment").alias("variant"))
    return a.join(c, "scenario_id").groupBy("variant", "method_label").agg(
        COUNT(), r6(F.avg("context_precision"), "context_precision"))


@query("j11_exclude_flagged", with_views("facts", """
  , bad AS (SELECT DISTINCT scenario_id, model_key FROM facts WHERE method_label IN ('oracle_dag', 'full_history')
            AND regexp_matches(substring(response, 1, 600), '(?i)made up|cannot verify'))
  SELECT f.model_key, f.method_label, count(*) AS n, round(avg(f.checklist_score), 6) AS checklist_score
  FROM facts f LEFT JOIN bad b ON b.scenario_id = f.scenario_id AND b.model_key = f.model_key
  WHERE b.scenario_id IS NULL GROUP BY 1, 2"""))
def j11_exclude_flagged(spark, sf_dir):
    from convgraph.functions.text import is_retraction

    f = facts.exclude_flagged(facts_table(spark, sf_dir), is_retraction(F.col("response")),
                              ["oracle_dag", "full_history"], ["scenario_id", "model_key"])
    return f.groupBy("model_key", "method_label").agg(COUNT(), r6(F.avg("checklist_score"), "checklist_score"))


@query("j12_eligible_instances", with_views("ans ver", """
  SELECT method_label, count(*) AS n FROM ans a WHERE method_label IN ('oracle_dag', 'oracle_tree', 'full_history')
  AND EXISTS (SELECT 1 FROM ver v WHERE v.key = a.key AND v.judge_model = 'ref' AND v.checklist_score IS NOT NULL) GROUP BY 1"""))
def j12_eligible_instances(spark, sf_dir):
    v = verdicts(spark, sf_dir).where("judge_model = 'ref'")
    return facts.eligible(answers(spark, sf_dir), v, ["oracle_dag", "oracle_tree", "full_history"]).groupBy(
        "method_label").agg(COUNT())


@query("j13_off_route", with_views("ver", """
  SELECT judge_model, judge_route, count(*) AS n FROM ver
  WHERE judge_route IS NOT NULL AND judge_route <> 'west' AND copied_from IS NULL GROUP BY 1, 2"""))
def j13_off_route(spark, sf_dir):
    return facts.off_route(verdicts(spark, sf_dir), "west").groupBy("judge_model", "judge_route").agg(COUNT())


@query("j14_verdict_attributes", with_views("ver ans", """
  SELECT a.method_label, a.length, v.judge_model, count(*) AS n FROM ver v JOIN ans a ON a.key = v.key GROUP BY 1, 2, 3"""))
def j14_verdict_attributes(spark, sf_dir):
    a = answers(spark, sf_dir).select("key", "method_label", "length")
    return verdicts(spark, sf_dir).join(a, "key").groupBy("method_label", "length", "judge_model").agg(COUNT())


@query("j15_aligned_items", with_views("aligned", """
  SELECT judge, key, count(*) AS n_items, count(*) FILTER (WHERE ref) AS n_ref, count(*) FILTER (WHERE cand) AS n_cand,
         count(*) FILTER (WHERE ref = cand) AS n_equal FROM aligned GROUP BY 1, 2"""))
def j15_aligned_items(spark, sf_dir):
    a = aligned(spark, sf_dir)
    return a.groupBy("judge", "key").agg(
        COUNT("n_items"), F.count_if("ref").alias("n_ref"), F.count_if("cand").alias("n_cand"),
        F.count_if(F.col("ref") == F.col("cand")).alias("n_equal"))


def aligned(spark, sf_dir):
    # first records are found once; five steps read them
    log = cut_lineage(item_log(spark, sf_dir).select("key", "item", "l_partkey", "l_suppkey", "satisfied", "other", "required"))
    return facts.align_items(log, candidate_items(log), log.where("required"))


def item_scores(spark, sf_dir):
    """Per (judge, instance): reference and candidate score with the answer's attributes, and the counts of its items."""
    a = aligned(spark, sf_dir).groupBy("judge", "key").agg(
        F.avg(F.col("ref").cast("int")).alias("ref_score"), F.avg(F.col("cand").cast("int")).alias("cand_score"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ref") == F.col("cand")).alias("n_equal"),
        F.count_if("ref").alias("n_ref"), F.count_if("cand").alias("n_cand"))
    return a.join(judged_instances(spark, sf_dir), "key")


@query("a19_first_verdict", with_views("ver", """
  SELECT key, judge_model, tie, round(checklist_score, 6) AS checklist_score FROM ver"""))
def a19_first_verdict(spark, sf_dir):
    return verdicts(spark, sf_dir).select("key", "judge_model", "tie", r6("checklist_score"))


@query("a20_last_answer", with_views("ans", "SELECT key, tie, context_tokens, length FROM ans"))
def a20_last_answer(spark, sf_dir):
    return answers(spark, sf_dir).select("key", "tie", "context_tokens", "length")
