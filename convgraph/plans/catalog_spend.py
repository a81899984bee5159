"""Queries on prices, ledgers and budgets, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.operators import spend
from convgraph.plans.catalog_facts import COUNT
from convgraph.plans.inputs import NEEDS, VIEWS, table, with_views
from convgraph.plans.registry import query, r6
from convgraph.streaming import ingest, ledger as ledger_stream

# ``us.view`` has a price under its twin id only; ``error`` has none.
PRICES = {"click": (3.0, 15.0), "global.view": (1.0, 5.0), "purchase": (0.6, 2.4), "scroll": (0.24, 0.96), "signup": (5.0, 25.0)}
WARN, LIMIT = 25.0, 60.0


def call_columns():
    e = F.col("event_id")
    return [F.col("ts"), e.alias("ref"), F.when(F.col("event_type") == "view", "us.view").otherwise(F.col("event_type")).alias("model"),
            F.when(F.col("user_id") % 5 != 4, (F.col("user_id") % 4).cast("string")).alias("purpose"),
            F.concat(F.lit("scope"), (F.col("user_id") % 2).cast("string")).alias("scope"),
            (200 + e % 4000).alias("input_tokens"), (50 + e % 700).alias("output_tokens")]


def ledger(spark, sf_dir):
    return spend.price_calls(table(spark, sf_dir, "events").select(*call_columns()), PRICES).where("usd is not null")


VIEWS["calls"] = """
  SELECT ts, event_id AS ref, CASE WHEN event_type = 'view' THEN 'us.view' ELSE event_type END AS model,
         CASE WHEN user_id % 5 <> 4 THEN CAST(user_id % 4 AS VARCHAR) END AS purpose, concat('scope', user_id % 2) AS scope,
         200 + event_id % 4000 AS input_tokens, 50 + event_id % 700 AS output_tokens FROM events"""
VIEWS["priced"] = """
  SELECT c.*, round(input_tokens / 1e6 * i + output_tokens / 1e6 * o, 6) AS usd FROM calls c
  LEFT JOIN (VALUES ('click', 3.0::DOUBLE, 15.0::DOUBLE), ('us.view', 1.0, 5.0), ('purchase', 0.6, 2.4), ('scroll', 0.24, 0.96), ('signup', 5.0, 25.0)) p(model, i, o)
    ON p.model = c.model"""
VIEWS["ledger"] = "SELECT * FROM priced WHERE usd IS NOT NULL"
NEEDS.update({"priced": ("calls",), "ledger": ("priced",)})

SUMS_SQL = "round(sum(usd), 6) AS usd, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens"


def _sums(df, *by):
    return df.select(*by, r6("usd"), "calls", "input_tokens", "output_tokens")


@query("l1_price_calls", with_views("priced", """
  SELECT model, count(*) AS n, count(usd) AS n_priced, round(sum(usd), 6) AS usd FROM priced GROUP BY 1"""))
def l1_price_calls(spark, sf_dir):
    p = spend.price_calls(table(spark, sf_dir, "events").select(*call_columns()), PRICES)
    return p.groupBy("model").agg(COUNT(), F.count("usd").alias("n_priced"), r6(F.sum("usd"), "usd"))


@query("l1_unpriced", with_views("priced", "SELECT model, count(*) AS calls FROM priced WHERE usd IS NULL GROUP BY 1"))
def l1_unpriced(spark, sf_dir):
    return spend.unpriced(spend.price_calls(table(spark, sf_dir, "events").select(*call_columns()), PRICES))


@query("l2_spend_by_model", with_views("ledger", f"SELECT model, {SUMS_SQL} FROM ledger GROUP BY 1"))
def l2_spend_by_model(spark, sf_dir):
    return _sums(spend.spend(ledger(spark, sf_dir), ["model"]), "model")


@query("l2_spend_by_purpose", with_views("ledger", f"SELECT coalesce(purpose, '?') AS purpose, {SUMS_SQL} FROM ledger GROUP BY 1"))
def l2_spend_by_purpose(spark, sf_dir):
    return _sums(spend.spend(ledger(spark, sf_dir), ["purpose"]), "purpose")


STATUS_SQL = """SELECT {k} round(sum(usd), 6) AS usd, count(*) AS calls,
    (min(struct_pack(ts := ts, ref := ref)) FILTER (WHERE spent >= 25)).ref AS warn_ref,
    (min(struct_pack(ts := ts, ref := ref)) FILTER (WHERE spent >= 60)).ref AS stop_ref,
    CASE WHEN sum(usd) >= 60 THEN 'stop' WHEN sum(usd) >= 25 THEN 'warn' ELSE 'ok' END AS status
  FROM (SELECT *, sum(usd) OVER ({p} ORDER BY ts, ref) AS spent FROM ledger) r {g}"""


@query("l3_budget_status", with_views("ledger", STATUS_SQL.format(k="", p="", g="")))
def l3_budget_status(spark, sf_dir):
    s = spend.budget_status(ledger(spark, sf_dir), F.date_trunc("minute", "ts"), WARN, LIMIT)
    return s.select(r6("usd"), "calls", "warn_ref", "stop_ref", "status")


@query("l4_scoped_budgets", with_views("ledger", STATUS_SQL.format(k="scope,", p="PARTITION BY scope", g="GROUP BY scope")))
def l4_scoped_budgets(spark, sf_dir):
    s = spend.budget_status(ledger(spark, sf_dir), F.date_trunc("minute", "ts"), WARN, LIMIT, ["scope"])
    return s.select("scope", r6("usd"), "calls", "warn_ref", "stop_ref", "status")


@query("l5_ledger_entries", with_views("ledger", """
  SELECT ref, model, purpose, input_tokens, output_tokens, usd FROM ledger"""))
def l5_ledger_entries(spark, sf_dir):
    return ledger(spark, sf_dir).select("ref", "model", "purpose", "input_tokens", "output_tokens", "usd")


@query("l6_ledger_faults", with_views("ledger", """
  SELECT 'missing purpose' AS fault, count(*) AS n FROM ledger WHERE purpose IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'negative usd', count(*) FROM ledger WHERE ref % 97 = 0 HAVING count(*) > 0"""))
def l6_ledger_faults(spark, sf_dir):
    l = ledger(spark, sf_dir).withColumn("usd", F.when(F.col("ref") % 97 == 0, -F.col("usd")).otherwise(F.col("usd")))
    return spend.ledger_faults(l, ["ts", "model", "purpose", "input_tokens", "output_tokens", "usd"])


@query("l7_spend_shares", with_views("ledger", """
  SELECT coalesce(purpose, '?') AS purpose, model, round(sum(usd), 6) AS usd, round(100 * sum(usd) / (SELECT sum(usd) FROM ledger), 6) AS pct FROM ledger GROUP BY 1, 2"""))
def l7_spend_shares(spark, sf_dir):
    return spend.shares(spend.spend(ledger(spark, sf_dir), ["purpose", "model"])).select("purpose", "model", r6("usd"), r6("pct"))


@query("t1_stream_ingest", """
  SELECT concat(user_id, '|', event_type) AS key, min(event_id) AS event_id FROM events GROUP BY 1""")
def t1_stream_ingest(spark, sf_dir):
    """First record per key of the event log, ingested as a stream into files."""
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.read_log(spark, sf_dir, schema, "parquet", "events.parquet")
    keyed = stream.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "ts")
    return ingest.first_by_key_stream(keyed, "key", ["ts", "event_id"]).select("key", "event_id")


@query("t1_stream_dedupe", """
  SELECT count(DISTINCT concat(user_id, '|', event_type)) AS n_keys FROM events""")
def t1_stream_dedupe(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.read_log(spark, sf_dir, schema, "parquet", "events.parquet")
    keyed = stream.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "ts")
    out = ingest.run_to_files(ingest.dedupe_stream(keyed, "key", "ts", "60 days"))
    return out.agg(F.count(F.lit(1)).alias("n_keys"))


@query("t1_stream_spans", """
  SELECT concat(user_id, '|', event_type) AS key, arg_min(event_id, (ts, event_id)) AS event_id, CAST(0 AS BIGINT) AS late FROM events GROUP BY 1""")
def t1_stream_spans(spark, sf_dir):
    """First record per key by event time, emitted when its span of time has closed."""
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.read_log(spark, sf_dir, schema, "parquet", "events.parquet")
    keyed = stream.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "ts")
    got = ingest.first_record_stream(keyed, "key", "ts", ["ts", "event_id"], "60 days", "1 day")
    return got.rows.select("key", "event_id", F.lit(got.late).cast("bigint").alias("late"))


@query("t2_stream_spend", with_views("ledger", f"""
  SELECT scope, model, coalesce(purpose, '?') AS purpose, {SUMS_SQL}, CASE WHEN sum(sum(usd)) OVER (PARTITION BY scope) >= 60 THEN 'stop' WHEN sum(sum(usd)) OVER (PARTITION BY scope) >= 25 THEN 'warn' ELSE 'ok' END AS status
  FROM ledger GROUP BY 1, 2, 3"""))
def t2_stream_spend(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.read_log(spark, sf_dir, schema, "parquet", "events.parquet").select(*call_columns())
    t = ledger_stream.run_spend(stream, PRICES, WARN, LIMIT)
    return t.select("scope", "model", "purpose", r6("usd"), "calls", "input_tokens", "output_tokens", "status")
