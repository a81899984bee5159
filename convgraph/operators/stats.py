"""Multiplicity, agreement, rank and sampling statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage
from convgraph.functions.splitwin import split_cumsum, split_row_number

def holm(df: DataFrame, by: Sequence[str], p: str, expect: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p values within each set; only sets of ``expect`` rows are adjusted.

    A set is a handful of comparisons.  Without ``expect`` any size counts.
    """
    w = Window.partitionBy(*by).orderBy(p, "a", "b") if {"a", "b"} <= set(df.columns) else Window.partitionBy(*by).orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    d = df.withColumn("_m", m).withColumn("_k", (F.col("_m") - F.row_number().over(w) + 1) * F.col(p))
    adj = F.least(F.lit(1.0), F.max("_k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ok = F.lit(True) if expect is None else F.col("_m") == expect
    return d.withColumn("p_holm", F.when(ok, adj)).withColumn("noninferior_holm", F.col("p_holm") < alpha).drop("_m", "_k")


def pooled_guard(comparisons: DataFrame, models: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Pooled rows that are not the mean of their per-model rows over the same scenarios.

    ``models(a, b, pooled_models, n_models)``.
    """
    pooled = comparisons.where("model = 'pooled'").select("a", "b", F.col("n").alias("n_pooled"), F.col("q_diff").alias("d_pooled"))
    per = comparisons.where("model <> 'pooled'").join(models, ["a", "b"]).where(
        F.array_contains(F.split("pooled_models", ","), F.col("model")))
    agg = per.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("q_diff").alias("d_models"),
                                    F.min("n").alias("n_low"), F.max("n").alias("n_high"))
    j = pooled.join(models, ["a", "b"]).join(agg, ["a", "b"], "left")
    fault = (F.when(F.coalesce(F.col("n_rows"), F.lit(0)) != F.col("n_models"), "missing per-model rows")
             .when((F.col("n_low") != F.col("n_pooled")) | (F.col("n_high") != F.col("n_pooled")), "unequal scenario counts")
             .when(F.abs(F.col("d_models") - F.col("d_pooled")) >= tolerance, "not the mean of its parts"))
    return j.withColumn("fault", fault).where("fault is not null").select("a", "b", "n_pooled", "n_low", "n_high", "fault")


def sample_size(parts: DataFrame, ks: Sequence[int] = (1, 2, 3, 5), effect: float = 0.026) -> DataFrame:
    """Scenarios needed for 80 % power at ``effect`` with k samples per cell."""
    per = parts.select("*", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])).alias("k"))
    var = F.greatest(F.col("sigma2_scenario"), F.lit(0.0)) + F.col("sigma2_decoder") / F.col("k")
    return per.withColumn("sigma_eff", F.sqrt(var)).withColumn("n_scenarios", 7.84 * var / effect**2)


def kappa(items: DataFrame, by: Sequence[str], a: str = "ref", b: str = "cand") -> DataFrame:
    """Cohen's kappa and agreement of two boolean columns per group, NULLs skipped.

    Below two items there is no kappa.  Two constant raters have kappa 1 if they
    agree and 0 if they do not.
    """
    x, y = F.col(a), F.col(b)
    g = items.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg((x == y).cast("int")).alias("agreement"),
        F.avg(x.cast("int")).alias("_pa"), F.avg(y.cast("int")).alias("_pb"))
    return _chance_corrected(g, by)


def kappa_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``kappa`` from counted items: counts(*by, n, n_equal, n_ref, n_cand), any number of rows per group."""
    share = lambda c: F.sum(c) / F.sum("n")
    return _chance_corrected(counts.groupBy(*by).agg(
        F.sum("n").alias("n_items"), share("n_equal").alias("agreement"), share("n_ref").alias("_pa"), share("n_cand").alias("_pb")), by)


def _chance_corrected(g: DataFrame, by: Sequence[str]) -> DataFrame:
    pe = F.col("_pa") * F.col("_pb") + (1 - F.col("_pa")) * (1 - F.col("_pb"))
    flat = F.col("_pa").isin(0.0, 1.0) & F.col("_pb").isin(0.0, 1.0)
    k = (F.when(F.col("n_items") < 2, F.lit(None)).when(flat, F.col("agreement"))
         .otherwise((F.col("agreement") - pe) / (1 - pe)))
    return g.select(*by, "n_items", k.cast("double").alias("kappa"), "agreement")


def score_deltas(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, 90th percentile and signed mean of candidate minus reference.

    Scores are fractions of a few checklist items, so the distinct differences
    the percentile keeps are few; it is fed from their counts.
    """
    d = scores.withColumn("_d", F.col("cand_score") - F.col("ref_score")).groupBy(*by, "_d").agg(
        F.count(F.lit(1)).alias("_n"))
    return d.groupBy(*by).agg(
        F.sum("_n").alias("n_instances"), (F.sum(F.abs("_d") * F.col("_n")) / F.sum("_n")).alias("mean_abs_delta"),
        F.percentile(F.abs("_d"), F.lit(0.9), F.col("_n")).alias("p90_abs_delta"),
        (F.sum(F.col("_d") * F.col("_n")) / F.sum("_n")).alias("mean_signed_delta"))


def method_means(scores: DataFrame) -> DataFrame:
    """(judge, method_label, n, ref_mean, cand_mean)."""
    return scores.groupBy("judge", "method_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ref_score").alias("ref_mean"), F.avg("cand_score").alias("cand_mean"))


def spearman(means: DataFrame, by: str = "judge", min_methods: int = 3) -> DataFrame:
    """Rank correlation of reference and candidate means, ties averaged; a few methods per judge."""
    def rank(c: str):
        w = Window.partitionBy(by).orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2

    r = means.withColumn("_r", rank("ref_mean")).withColumn("_c", rank("cand_mean"))
    g = r.groupBy(by).agg(F.count(F.lit(1)).alias("n_methods"), F.corr("_r", "_c").alias("_rho"))
    return g.select(by, "n_methods", F.when(F.col("n_methods") >= min_methods, F.col("_rho")).alias("spearman"))


def rank_violations(means: DataFrame, band: float, by: str = "judge") -> DataFrame:
    """Method pairs whose reference gap is at least ``band`` but whose order flips."""
    x = means.select(by, F.col("method_label").alias("better"), F.col("ref_mean").alias("r1"), F.col("cand_mean").alias("c1"))
    y = means.select(by, F.col("method_label").alias("worse"), F.col("ref_mean").alias("r2"), F.col("cand_mean").alias("c2"))
    bad = x.join(y, by).where((F.col("r1") - F.col("r2") >= band) & (F.col("c1") < F.col("c2")))
    flips = bad.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_violations"),
        F.array_join(F.sort_array(F.collect_list(F.concat("better", F.lit(">"), "worse"))), ";").alias("violations"))
    return means.select(by).distinct().join(flips, by, "left").select(
        by, F.coalesce("n_violations", F.lit(0)).cast("bigint").alias("n_violations"),
        F.coalesce("violations", F.lit("none")).alias("violations"))


def coverage(scores: DataFrame, sample_size_: int, share: float = 0.95) -> DataFrame:
    """Judges that scored at least ``share`` of the sample."""
    return scores.groupBy("judge").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * sample_size_)


def simple_sample(ids: DataFrame, col: str, n: int, seed: int) -> DataFrame:
    """Seeded simple random sample of n ids: the n smallest hashes."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(col).cast("string")))
    return ids.select(col).distinct().orderBy(h, col).limit(n)


def quotas(eligible: DataFrame, total: int, stratum: str = "family", unit: str = "scenario_id", floor: int = 2) -> DataFrame:
    """Sample sizes proportional to the units of each stratum, at least ``floor``, summing to ``total``.

    What rounding leaves goes round by largest remainders; what the floor adds is taken back from the largest quotas,
    one by one, the first stratum first among equals.  Taking back lowers the largest quotas to one level, which is found
    from running sums; so there is one small row per stratum and no loop.
    """
    n = cut_lineage(eligible.groupBy(stratum).agg(F.count_distinct(unit).alias("_n")))
    units = n.agg(F.sum("_n")).first()[0] or 1
    one = F.lit(0)
    x = F.lit(total) * F.col("_n") / F.lit(units)
    q = n.select(stratum, one.alias("_one"), F.greatest(F.lit(floor), F.floor(x)).alias("_q"), (F.floor(x) - x).alias("_rest"))
    extra = max(0, total - (q.agg(F.sum("_q")).first()[0] or 0))
    q = split_row_number(q, ["_one"], F.floor(F.col("_rest") * 4096), [F.col("_rest"), F.col(stratum)], "_rk")
    q = cut_lineage(q.select(stratum, "_one", (F.col("_q") + F.when(F.col("_rk") <= extra, 1).otherwise(0)).alias("_q")))
    excess = max(0, (q.agg(F.sum("_q")).first()[0] or 0) - total)
    # in falling order, bringing the first k quotas down to the k-th one takes what lies above it
    d = split_row_number(q, ["_one"], -F.col("_q"), [F.desc("_q"), F.col(stratum)], "_k")
    d = split_cumsum(d, ["_one"], -F.col("_q"), [F.desc("_q"), F.col(stratum)], F.col("_q"), "_sum")
    d = d.withColumn("_above", F.col("_sum") - F.col("_k") * F.col("_q"))
    top = d.where(F.col("_above") <= excess).agg(F.max("_k").alias("k"), F.max_by("_q", "_k").alias("q"), F.max_by("_above", "_k").alias("c")).first()
    if not excess or top is None or top.k is None:
        return q.select(stratum, F.col("_q").cast("bigint").alias("quota"))
    level, rest = top.q - (excess - top.c) // top.k, (excess - top.c) % top.k
    high = split_row_number(q.where(F.col("_q") >= top.q), ["_one"], F.ascii(F.col(stratum).cast("string")), [F.col(stratum).cast("string")], "_i")
    high = high.select(stratum, (F.lit(level) - F.when(F.col("_i") <= rest, 1).otherwise(0)).alias("quota"))
    return high.unionByName(q.where(F.col("_q") < top.q).select(stratum, F.col("_q").alias("quota"))).select(stratum, F.col("quota").cast("bigint").alias("quota"))


def quota_sample(
    eligible: DataFrame, total: int, seed: int, stratum: str = "family", unit: str = "scenario_id",
    cells: Sequence[str] = ("model_key", "method_label"), key: str = "key",
) -> DataFrame:
    """Stratified sample, round-robin over cells, new scenarios before used ones.

    Rows are shuffled by a hash; a row's round is its place in its cell, after one
    row per scenario has been preferred.  Only the first rows of each cell can be
    taken, so the window keeps at most ``total`` rows per cell.
    """
    q = quotas(eligible, total, stratum, unit)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    d = eligible.withColumn("_h", h)
    first = d.groupBy(stratum, unit).agg(F.min("_h").alias("_first"))
    d = d.join(first, [stratum, unit]).withColumn("_again", (F.col("_h") != F.col("_first")).cast("int"))
    cell = Window.partitionBy(stratum, *cells).orderBy("_again", "_h")
    d = d.withColumn("_round", F.row_number().over(cell)).where(F.col("_round") <= total)
    order = Window.partitionBy(stratum).orderBy("_again", "_round", F.md5(F.concat_ws("|", F.lit(str(seed)), *cells)), "_h")
    d = d.withColumn("_take", F.row_number().over(order)).where(F.col("_take") <= total)
    return d.join(q, stratum).where(F.col("_take") <= F.col("quota")).select(*eligible.columns)
