"""Prices, ledgers and budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convgraph.functions.splitwin import split_cumsum

# The two routing prefixes under which one model may be priced.
ROUTES = ("us.", "global.")


def price_table(spark: SparkSession, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(model, input, output) in usd per million tokens, from configuration."""
    return spark.createDataFrame([(m, float(i), float(o)) for m, (i, o) in prices.items()],
                                 "model string, input double, output double")


def price_columns(prices: Mapping[str, tuple[float, float]], model: Column) -> tuple[Column, Column]:
    """Input and output rate of a model, or of its twin id; NULL if it has no price.

    The price list is configuration of a few dozen models, so it is a literal map
    and no join.
    """
    def lookup(i: int) -> Column:
        m = F.create_map(*[x for k, v in prices.items() for x in (F.lit(k), F.lit(float(v[i])))])
        us, gl = ROUTES
        twin = (F.when(model.startswith(us), F.concat(F.lit(gl), F.substr(model, F.lit(len(us) + 1))))
                .when(model.startswith(gl), F.concat(F.lit(us), F.substr(model, F.lit(len(gl) + 1)))))
        return F.coalesce(F.try_element_at(m, model), F.try_element_at(m, twin))

    return lookup(0), lookup(1)


def price_calls(calls: DataFrame, prices: Mapping[str, tuple[float, float]], strict: bool = False) -> DataFrame:
    """Adds ``usd``, rounded to six places.

    A call of a model without a price gets NULL, or fails the query if ``strict``.
    """
    i, o = price_columns(prices, F.col("model"))
    usd = F.round(F.col("input_tokens") / 1e6 * i + F.col("output_tokens") / 1e6 * o, 6)
    if strict:
        usd = F.when(usd.isNull(), F.raise_error(F.concat(F.lit("no price for model "), F.col("model"))).cast("double")).otherwise(usd)
    return calls.withColumn("usd", usd)


def unpriced(calls: DataFrame) -> DataFrame:
    """Calls left without a price, per model."""
    return calls.where("usd is null").groupBy("model").agg(F.count(F.lit(1)).alias("calls"))


def spend(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """usd, calls and tokens per group; a missing purpose counts as ``?``."""
    d = ledger.withColumn("purpose", F.coalesce("purpose", F.lit("?"))) if "purpose" in ledger.columns else ledger
    return d.groupBy(*by).agg(
        F.sum("usd").alias("usd"), F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def running_spend(ledger: DataFrame, split: Column, scope: Sequence[str] = ()) -> DataFrame:
    """Running usd per scope in order of (ts, ref); ``split`` is a coarse prefix of ts."""
    d = ledger if scope else ledger.withColumn("_all_scopes", F.lit(1))
    out = split_cumsum(d, list(scope) or ["_all_scopes"], split, [F.col("ts"), F.col("ref")], F.col("usd"), "spent")
    return out if scope else out.drop("_all_scopes")


def budget_status(ledger: DataFrame, split: Column, warn: float, limit: float, scope: Sequence[str] = ()) -> DataFrame:
    """Total, status and the first entries that reach the warning and the hard limit."""
    run = running_spend(ledger, split, scope)
    when = F.struct("ts", "ref")
    first = lambda x: F.min(F.when(F.col("spent") >= x, when))
    aggs = [F.sum("usd").alias("usd"), F.count(F.lit(1)).alias("calls"), first(warn).alias("_w"), first(limit).alias("_l")]
    out = run.groupBy(*scope).agg(*aggs) if scope else run.agg(*aggs)
    return out.select(*scope, "usd", "calls", F.col("_w.ref").alias("warn_ref"), F.col("_l.ref").alias("stop_ref"),
                      F.when(F.col("usd") >= limit, "stop").when(F.col("usd") >= warn, "warn").otherwise("ok").alias("status"))


def ledger_faults(ledger: DataFrame, required: Sequence[str]) -> DataFrame:
    """Number of entries with a missing required value or a negative amount, per fault."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    checks.append(F.when(F.col("usd") < 0, F.lit("negative usd")))
    bad = ledger.select(F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("fault"))
    return bad.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def limits_in_order(estimate: float, warn: float, limit: float) -> bool:
    return estimate <= warn <= limit


def shares(table: DataFrame, value: str = "usd") -> DataFrame:
    """Adds each row's percentage of the total; ``table`` is a small result table."""
    total = table.agg(F.sum(value).alias("_t"))
    return table.join(F.broadcast(total)).withColumn("pct", F.try_divide(100 * F.col(value), F.col("_t"))).drop("_t")


def dry_run(plan: DataFrame, selections: DataFrame, rates: Mapping[str, tuple[float, float]], output_tokens: int, metrics: DataFrame | None = None,
            summary_tokens: int = 200) -> DataFrame:
    """Estimate per model and arm before anything is run: input tokens, cost of input and of ``output_tokens`` an answer,
    and, with ``metrics`` of the planned instances, mean recall and sufficiency.

    ``rates`` are US dollars a million input and output tokens; a summary counts as a flat surcharge.
    """
    tok = selections.groupBy("sid", "method", "budget").agg(F.sum("cost").alias("_t"))
    p, s = plan.alias("p"), tok.alias("s")
    on = (F.col("p.sid") == F.col("s.sid")) & (F.col("p.method") == F.col("s.method")) & F.col("p.budget").eqNullSafe(F.col("s.budget"))
    extra = F.when(F.col("method") == "rolling_summary", summary_tokens).otherwise(0)
    per = p.join(s, on, "left").select("p.*", "s._t").withColumn("_t", F.coalesce("_t", F.lit(0)) + extra)
    arms = per.groupBy("method", "budget").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_t").alias("input_tokens"), F.avg("_t").alias("mean_tokens"))
    if metrics is not None:  # one row per arm on both sides
        q = metrics.groupBy("method", "budget").agg(F.avg("context_recall").alias("context_recall"), F.avg("context_sufficiency").alias("context_sufficiency")).alias("q")
        a = arms.alias("a")
        arms = a.join(q, (F.col("a.method") == F.col("q.method")) & F.col("a.budget").eqNullSafe(F.col("q.budget")), "left").select("a.*", "q.context_recall", "q.context_sufficiency")
    rate = F.array(*[F.struct(F.lit(m).alias("model_key"), F.lit(float(i)).alias("_in"), F.lit(float(o)).alias("_out")) for m, (i, o) in rates.items()])
    priced = arms.select("*", F.inline(rate)).withColumn("usd", F.col("input_tokens") * F.col("_in") / 1e6)
    return priced.withColumn("output_usd", F.col("n") * F.lit(output_tokens) * F.col("_out") / 1e6).withColumn("total_usd", F.col("usd") + F.col("output_usd")).drop("_in", "_out")
