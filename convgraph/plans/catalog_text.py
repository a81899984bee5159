"""Queries on turn, answer and judge text."""

from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.functions import text
from convgraph.operators import verdicts as vd
from convgraph.plans.catalog_facts import COUNT
from convgraph.plans.fact_inputs import item_log
from convgraph.plans.inputs import NEEDS, VIEWS, table, with_views
from convgraph.plans.registry import big, query, r6

VIEWS["dialog"] = """
  SELECT conv_id, turn, "text" AS user_message, answer AS assistant_message,
         max(turn) OVER (PARTITION BY conv_id) = turn AS is_query FROM (
    SELECT conv_id, turn, role, "text", lead(CASE WHEN role = 'assistant' THEN "text" END) OVER (PARTITION BY conv_id ORDER BY turn) AS answer
    FROM conversations) c WHERE role = 'user'"""
VIEWS["rendered"] = """
  SELECT *, concat(CASE WHEN turn % 4 = 2 THEN '[Note: the following was later revised — see below]' || chr(10) ELSE '' END,
                   'User: ', user_message, chr(10), 'Assistant: ', coalesce(assistant_message, ''), chr(10)) AS body FROM dialog"""
NEEDS["rendered"] = ("dialog",)


def dialog(spark, sf_dir):
    """User rows with the assistant row that follows; the last one is the query."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_message"))
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_message"))
    last = u.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    return u.join(nxt, ["conv_id", "turn"], "left").join(last, "conv_id").withColumn(
        "is_query", F.col("turn") == F.col("_last")).drop("_last")


def rendered(spark, sf_dir):
    return dialog(spark, sf_dir).withColumn(
        "body", text.render_turn(F.col("user_message"), F.col("assistant_message"), F.col("turn") % 4 == 2))


@query("p10_render_turn", with_views("rendered", "SELECT conv_id, turn, md5(body) AS digest, length(body) AS n_chars FROM rendered"))
def p10_render_turn(spark, sf_dir):
    return rendered(spark, sf_dir).select("conv_id", "turn", F.md5("body").alias("digest"), F.length("body").cast("bigint").alias("n_chars"))


@query("p11_token_cost", with_views("rendered", r"""
  SELECT conv_id, turn, CAST(len(regexp_extract_all(body, '\w+|[^\w\s]')) AS BIGINT) AS cost FROM rendered"""))
def p11_token_cost(spark, sf_dir):
    return rendered(spark, sf_dir).select("conv_id", "turn", text.token_count(F.col("body")).alias("cost"))


@query("p12_assemble_prompt", with_views("rendered", """
  SELECT conv_id, md5(prompt) AS digest, length(prompt) AS n_chars FROM (
    SELECT conv_id, concat(coalesce(string_agg(body, '' ORDER BY turn) FILTER (WHERE NOT is_query), ''), chr(10), chr(10), 'User: ',
                           max(user_message) FILTER (WHERE is_query)) AS prompt FROM rendered GROUP BY conv_id) p"""))
def p12_assemble_prompt(spark, sf_dir):
    from convgraph.operators.prompts import assemble

    d = rendered(spark, sf_dir)
    p = assemble(d.where("not is_query"), d.where("is_query").select("conv_id", F.col("user_message").alias("query")),
                 "conv_id", "turn", "body")
    return p.select("conv_id", F.md5("prompt").alias("digest"), F.length("prompt").cast("bigint").alias("n_chars"))


SIGNPOST_SQL = "(?i)(?:" + "|".join(text.SIGNPOST_PATTERNS).replace("'", "''") + ")"


@query("p14_signposting", rf"""
  SELECT doc_id % 6 AS kind, count(*) AS n_docs, CAST(sum(len(h)) AS BIGINT) AS n_hits, max(lower(h[1])) AS last_phrase FROM (
    SELECT doc_id, regexp_extract_all(concat("text", CASE doc_id % 6 WHEN 0 THEN ' Back to our plan, meanwhile.' WHEN 1 THEN ' On a totally different topic: one more thing'
      WHEN 2 THEN ' While we are at it, circling back to it' WHEN 3 THEN ' backtothe separatelyx' ELSE '' END), '{SIGNPOST_SQL}') AS h FROM documents) d GROUP BY 1""")
def p14_signposting(spark, sf_dir):
    k = F.col("doc_id") % 6
    tail = (F.when(k == 0, " Back to our plan, meanwhile.").when(k == 1, " On a totally different topic: one more thing")
            .when(k == 2, " While we are at it, circling back to it").when(k == 3, " backtothe separatelyx").otherwise(""))
    h = table(spark, sf_dir, "documents").select(k.alias("kind"), text.signposting(F.concat("text", tail)).alias("h"))
    return h.groupBy("kind").agg(COUNT("n_docs"), F.sum(F.size("h")).alias("n_hits"), F.max(F.lower(F.get("h", F.lit(0)))).alias("last_phrase"))


RETRACT_SQL = text.RETRACTION_PATTERN.replace("'", "''")


@query("p15_retraction", rf"""
  SELECT doc_id % 5 AS kind, count(*) AS n, count(*) FILTER (WHERE regexp_matches(substring(t, 1, 600), '{RETRACT_SQL}')) AS n_retracted
  FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('I do not actually have any record. ', "text") WHEN 1 THEN concat("text", ' fabricated')
        WHEN 2 THEN concat('I NEED TO BE HONEST ', "text") ELSE "text" END AS t FROM documents) d GROUP BY 1""")
def p15_retraction(spark, sf_dir):
    k = F.col("doc_id") % 5
    t = (F.when(k == 0, F.concat(F.lit("I do not actually have any record. "), "text")).when(k == 1, F.concat("text", F.lit(" fabricated")))
         .when(k == 2, F.concat(F.lit("I NEED TO BE HONEST "), "text")).otherwise(F.col("text")))
    d = table(spark, sf_dir, "documents").select(k.alias("kind"), text.is_retraction(t).alias("r"))
    return d.groupBy("kind").agg(COUNT(), F.count_if("r").alias("n_retracted"))


@query("p16_normalise_item", r"""
  SELECT p_partkey, regexp_replace(trim(lower(trim(concat('  "', p_name, '   X', p_brand, '".,  '), ' ' || chr(9) || chr(10))), '.,;:!?''"'), '\s+', ' ', 'g') AS item
  FROM part""")
def p16_normalise_item(spark, sf_dir):
    raw = F.concat(F.lit('  "'), "p_name", F.lit("   X"), "p_brand", F.lit('".,  '))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise_item(raw).alias("item"))


STOP_SQL = ", ".join(f"'{s}'" for s in text.STOP_ITEMS)


@query("p17_regex_items", rf"""
  , src AS (SELECT doc_id, concat("text", ' use `Run_Job {{doc}}` and "the first rule" or "Today" with max_len_', doc_id % 7, ' in DataFrameReader, `one`') AS t FROM documents),
  raw AS (SELECT doc_id, unnest(list_concat(list_concat(regexp_extract_all(t, '`([^`\n]{{2,80}})`', 1), regexp_extract_all(t, '["“]([^"”\n]{{3,80}})["”]', 1)),
                 list_concat(regexp_extract_all(t, '\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b'), regexp_extract_all(t, '\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b')))) AS x FROM src),
  nrm AS (SELECT DISTINCT doc_id, regexp_replace(trim(lower(trim(x, ' ' || chr(9) || chr(10) || chr(13))), '.,;:!?''"'), '\s+', ' ', 'g') AS item FROM raw)
  SELECT doc_id, count(*) AS n_items, md5(string_agg(item, '|' ORDER BY item COLLATE "C")) AS digest FROM nrm
  WHERE length(item) >= 2 AND item NOT IN ({STOP_SQL}) GROUP BY doc_id""".replace("  , src", "WITH src", 1).replace(' COLLATE "C"', ""))
def p17_regex_items(spark, sf_dir):
    t = F.concat(F.col("text"), F.lit(' use `Run_Job {doc}` and "the first rule" or "Today" with max_len_'), (F.col("doc_id") % 7).cast("string"),
                 F.lit(" in DataFrameReader, `one`"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.regex_items(t)).alias("item"))
    return d.groupBy("doc_id").agg(COUNT("n_items"), F.md5(F.array_join(F.sort_array(F.collect_list("item")), "|")).alias("digest"))


@query("p18_bare_name", """
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE concat(p_name, '-', p_brand) END AS name FROM part""")
def p18_bare_name(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = (F.when(k == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).when(k == 1, F.concat(F.lit("'"), "p_name", F.lit("' – "), "p_type"))
           .when(k == 2, F.concat("p_name", F.lit(": "), "p_type")).otherwise(F.concat("p_name", F.lit("-"), "p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", text.bare_name(raw).alias("name"))


def raw_verdicts(spark, sf_dir):
    """Judge output as free text, one per order; an answer has at most seven items."""
    log = item_log(spark, sf_dir)
    item = F.concat(F.lit('{"id": "c'), F.col("item").cast("string"), F.lit('", "satisfied": '), F.col("satisfied").cast("string"), F.lit(', "reason": "r"}'))
    per = log.where("l_suppkey % 20 <> 0").groupBy("key").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item", item.alias("j")))), lambda x: x["j"]), ", ").alias("_l"))
    k = F.col("key")
    arr = F.concat(F.lit("["), "_l", F.lit("]"))
    obj = F.concat(F.lit('{"checklist": '), arr, F.lit(', "distractor_leakage": '), F.when(k % 3 == 0, F.lit("true")).otherwise(F.lit("false")), F.lit("}"))
    txt = (F.when(k % 6 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(k % 6 == 1, F.concat(F.lit("<think>a {b}</think>\n"), obj))
           .when(k % 6 == 2, arr).when(k % 6 == 3, F.concat(F.lit("Here it is: "), obj, F.lit(" Done."))).when(k % 6 == 4, F.lit("no verdict here")).otherwise(obj))
    return per.select("key", txt.alias("text"))


@query("p19_parse_verdicts", with_views("ilog", """
  SELECT key, key % 6 <> 4 AS parsed, CASE WHEN key % 6 <> 4 THEN count(*) END AS n_items,
         CASE WHEN key % 6 <> 4 THEN count(*) FILTER (WHERE satisfied) END AS n_true,
         CASE WHEN key % 6 IN (2, 4) THEN NULL WHEN key % 3 = 0 THEN 1 ELSE 0 END AS distractor_leakage
  FROM ilog WHERE l_suppkey % 20 <> 0 GROUP BY key"""))
def p19_parse_verdicts(spark, sf_dir):
    v = vd.parse_verdicts(raw_verdicts(spark, sf_dir))
    return v.select("key", "parsed", F.size("items").cast("bigint").alias("_n"), F.size(F.filter("items", lambda x: x["satisfied"])).cast("bigint").alias("_t"),
                    "distractor_leakage").select("key", "parsed", F.when(F.col("parsed"), F.col("_n")).alias("n_items"),
                                                 F.when(F.col("parsed"), F.col("_t")).alias("n_true"), "distractor_leakage")


@query("p20_score_verdicts", with_views("ilog", """
  , k AS (SELECT DISTINCT key FROM ilog WHERE l_suppkey % 20 <> 0 AND key % 6 <> 4)
  SELECT i.key, count(*) FILTER (WHERE required) AS n_required, count(*) FILTER (WHERE required AND satisfied AND l_suppkey % 20 <> 0) AS n_satisfied,
         round(avg(CASE WHEN required THEN CASE WHEN satisfied AND l_suppkey % 20 <> 0 THEN 1 ELSE 0 END END), 6) AS checklist_score,
         coalesce(min(CASE WHEN required THEN CASE WHEN satisfied AND l_suppkey % 20 <> 0 THEN 1 ELSE 0 END END), 1) AS all_required_satisfied
  FROM ilog i JOIN k ON k.key = i.key GROUP BY i.key"""))
def p20_score_verdicts(spark, sf_dir):
    v = vd.parse_verdicts(raw_verdicts(spark, sf_dir)).where("items is not null")
    c = item_log(spark, sf_dir).select("key", F.concat(F.lit("c"), F.col("item").cast("string")).alias("item"), "required")
    s = vd.score_verdicts(v, c)
    return s.select("key", "n_required", big("n_satisfied"), r6("checklist_score"), "all_required_satisfied")


@query("p21_judge_input", with_views("ilog", """
  SELECT key, md5(t) AS digest, length(t) AS n_chars FROM (
    SELECT key, concat('The user''s question:', chr(10), 'order ', key, chr(10), chr(10), 'Checklist:', chr(10),
      '[', string_agg(concat('{"id":"c', item, '","criterion":"part ', l_partkey, '","required":', item <= 4, '}'), ',' ORDER BY item), ']',
      chr(10), chr(10), 'Distractor turns:', chr(10), CASE WHEN key % 3 = 0 THEN '(none)' ELSE concat('--- t', key % 3, ' ---', chr(10), 'body', chr(10)) END,
      chr(10), chr(10), 'Assistant''s answer:', chr(10), 'answer ', key) AS t FROM ilog GROUP BY key) x"""))
def p21_judge_input(spark, sf_dir):
    k = F.col("key")
    it = F.struct(F.col("item").alias("o"), F.struct(
        F.concat(F.lit("c"), F.col("item").cast("string")).alias("id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("criterion"),
        "required").alias("c"))
    per = item_log(spark, sf_dir).groupBy("key").agg(F.to_json(F.transform(F.sort_array(F.collect_list(it)), lambda x: x["c"])).alias("_c"))
    dis = F.when(k % 3 == 0, F.lit("")).otherwise(vd.distractor_block(F.concat(F.lit("t"), (k % 3).cast("string")), F.lit("body\n")))
    t = vd.judge_input(F.concat(F.lit("order "), k.cast("string")), F.col("_c"), dis, F.concat(F.lit("answer "), k.cast("string")))
    return per.select("key", F.md5(t).alias("digest"), F.length(t).cast("bigint").alias("n_chars"))


@query("p22_item_map", with_views("ilog", """
  SELECT key, count(*) AS n_items, count(*) FILTER (WHERE satisfied) AS n_true FROM ilog GROUP BY key"""))
def p22_item_map(spark, sf_dir):
    pair = F.concat(F.lit("{'id': 'c"), F.col("item").cast("string"), F.lit("', 'satisfied': "), F.when(F.col("satisfied"), "True").otherwise("False"), F.lit("}"))
    js = F.concat(F.lit('{"id": "c'), F.col("item").cast("string"), F.lit('", "satisfied": '), F.col("satisfied").cast("string"), F.lit("}"))
    one = F.when(F.col("key") % 2 == 0, pair).otherwise(js)
    t = item_log(spark, sf_dir).groupBy("key").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ", "), F.lit("]")).alias("t"))
    m = t.select("key", vd.item_map(vd.items_from_text(F.col("t"))).alias("m"))
    return m.select("key", F.size("m").cast("bigint").alias("n_items"), F.size(F.map_filter("m", lambda k, v: v)).cast("bigint").alias("n_true"))


@query("p23_truncate_answer", r"""
  WITH n AS (SELECT doc_id, len(regexp_extract_all("text", '\w+|[^\w\s]')) AS n FROM documents),
  t AS (SELECT d.doc_id, array_to_string(list_slice(regexp_extract_all(d."text", '\s*(?:\w+|[^\w\s])'), 1, n.n), '') AS t
        FROM documents d JOIN n ON n.doc_id = d.doc_id + 1)
  SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM t""")
def p23_truncate_answer(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), text.token_count(F.col("text")).cast("int").alias("_n"))
    t = d.join(n, "doc_id").select("doc_id", text.truncate_tokens(F.col("text"), F.col("_n")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


@query("p24_span_variant", """
  SELECT least(event_type, CASE WHEN event_id % 2 = 0 THEN 'first_request' ELSE 'second_request' END) AS variant, count(*) AS n FROM events GROUP BY 1""")
def p24_span_variant(spark, sf_dir):
    half = F.when(F.col("event_id") % 2 == 0, "first_request").otherwise("second_request")
    spans = F.create_map(F.lit("t1"), F.col("event_type"), F.lit("t2"), half)
    return table(spark, sf_dir, "events").groupBy(text.span_variant(spans).alias("variant")).agg(COUNT())


@query("p25_turn_text", with_views("dialog", """
  SELECT conv_id, turn, md5(concat(user_message, chr(10), coalesce(assistant_message, ''))) AS digest FROM dialog"""))
def p25_turn_text(spark, sf_dir):
    return dialog(spark, sf_dir).select("conv_id", "turn", F.md5(text.turn_text(F.col("user_message"), F.col("assistant_message"))).alias("digest"))
