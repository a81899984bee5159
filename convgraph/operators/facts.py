"""Work plans, keys and joins of answer and verdict facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convgraph.operators.select import BUDGETED, Method

# Wide text columns left out of instance tables.
WIDE_COLUMNS = ("prompt", "system_prompt", "response", "pool_k", "gold_closure")


# ---- keys and labels

def _budget_text(budget: Column, missing: str) -> Column:
    gone = budget.isNull() | F.isnan(budget.cast("double"))
    return F.when(gone, F.lit(missing)).otherwise(budget.cast("bigint").cast("string"))


def instance_key(scenario: Column, method: Column, budget: Column, model: Column) -> Column:
    """``scenario|method|budget or -|model``."""
    return F.concat_ws("|", scenario.cast("string"), method, _budget_text(budget, "-"), model)


def method_label(method: Column, budget: Column) -> Column:
    """``method`` or ``method@budget``."""
    gone = budget.isNull() | F.isnan(budget.cast("double"))
    return F.when(gone, method).otherwise(F.concat(method, F.lit("@"), budget.cast("bigint").cast("string")))


def parse_methods(spec: Column) -> Column:
    """``"a@10, b"`` -> array of (method, budget)."""
    return F.transform(
        F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != ""),
        lambda x: F.struct(F.split_part(x, F.lit("@"), F.lit(1)).alias("method"),
                           F.nullif(F.split_part(x, F.lit("@"), F.lit(2)), F.lit("")).cast("bigint").alias("budget")))


def has_prefix(col: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.startswith(p) for p in prefixes], F.lit(False))


# ---- plans

def plan_instances(scenarios: DataFrame, models: Sequence[str], methods: Sequence[str], budgets: Sequence[int]) -> DataFrame:
    """Scenario x model x method, with each budget for methods that take one."""
    cells = [(m, b) for m in methods for b in (budgets if m in BUDGETED else [None])]
    arr = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(b).cast("bigint").alias("budget")) for m, b in cells])
    return scenarios.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_key"), F.lit(1).alias("_x")
                            ).select(*scenarios.columns, "model_key", F.inline(arr))


def plan_candidates(
    scenarios: DataFrame,
    models: Mapping[str, Sequence[int]],
    primary_k: int,
    extra: Mapping[str, Sequence[Method]] | None = None,
) -> DataFrame:
    """Primary k for every model, sensitivity k only where listed, extra arms per model.

    ``stage`` 1 is the primary work; stage 2 may reuse its results.
    """
    rows = []
    for model, ks in models.items():
        for m in (extra or {}).get(model, ()):
            rows.append((model, m.name, m.budget, 1))
        rows.append((model, "candidate_oracle", primary_k, 1))
        rows += [(model, "candidate_oracle", k, 2) for k in ks]
    arr = F.array(*[F.struct(F.lit(a).alias("model_key"), F.lit(b).alias("method"),
                             F.lit(c).cast("bigint").alias("budget"), F.lit(d).alias("stage")) for a, b, c, d in rows])
    return scenarios.select("*", F.inline(arr))


def matched_arms(matched: DataFrame, budget: int) -> DataFrame:
    """Arms of the long phase: ``matched(sid, matched_budget)`` gives the matched one."""
    arms = F.array(
        F.struct(F.lit("full_history").alias("label"), F.lit(None).cast("bigint").alias("budget")),
        F.struct(F.lit("oracle_dag").alias("label"), F.lit(None).cast("bigint").alias("budget")),
        F.struct(F.lit("semantic_retrieval@matched").alias("label"), F.col("matched_budget").cast("bigint").alias("budget")),
        F.struct(F.lit(f"semantic_retrieval@{budget}").alias("label"), F.lit(budget).cast("bigint").alias("budget")))
    return matched.select("sid", F.inline(arms))


def pending(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned work whose key is not done yet."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def shard(df: DataFrame, key: str, k: int, n: int) -> DataFrame:
    return df.where(F.crc32(F.col(key).cast("string").cast("binary")) % n == k)


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def drop_wide(df: DataFrame) -> DataFrame:
    return df.drop(*WIDE_COLUMNS)


# ---- one row per key

def _by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest record per key; a map-side combined aggregate, not a window."""
    return _by_key(df, keys, [F.col(c) for c in order], F.min_by)


def last_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _by_key(df, keys, [F.col(c) for c in order], F.max_by)


def merge_sources(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str], later_wins: bool) -> DataFrame:
    """Union of log sources, one record per key.

    With ``later_wins`` a later source overrides and its last record counts; else
    the first record of the first source counts.
    """
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    pick = last_by_key if later_wins else first_by_key
    return pick(u, keys, ["_src", *order]).drop("_src")


# ---- joins

def with_verdicts(answers: DataFrame, verdicts: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Answers left join verdicts on ``key``; NaN scores become NULL."""
    cols = [F.nanvl(F.col(c), F.lit(None)).alias(c + suffix) if verdicts.schema[c].dataType.typeName() == "double"
            else F.col(c).alias(c + suffix) for c in columns]
    return answers.join(verdicts.select("key", *cols), "key", "left")


def side_by_side(verdicts: DataFrame, judges: Mapping[str, str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First verdict of each judge per key in one row: ``column + suffix`` per judge.

    One aggregation by key, so that a join with answers kept one per key needs no
    further shuffle.
    """
    at = F.struct(*order)
    picks = [F.min_by(F.struct(*columns), F.when(F.col("judge_model") == j, at)).alias(f"_j{i}") for i, j in enumerate(judges)]
    wide = verdicts.groupBy("key").agg(*picks)
    return wide.select("key", *[F.col(f"_j{i}.{c}").alias(c + suffix) for i, suffix in enumerate(judges.values()) for c in columns])


def pair_arms(facts: DataFrame, comparisons: Sequence[tuple[str, str]], on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of arm a and arm b of each comparison side by side.

    One pass over the facts: every fact is sent to the comparisons that use its
    arm and the two sides meet in a grouped aggregate.
    """
    side = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("_arm"), F.lit(i).alias("_side"))
                     for a, b in comparisons for s, i in ((a, 0), (b, 1))])
    hits = facts.select(*on, "method_label", *values, F.explode(
        F.filter(side, lambda x: x["_arm"] == F.col("method_label"))).alias("_c"))
    flat = hits.select(*on, "_c.a", "_c.b", F.col("_c._side").alias("_side"), *values)
    row = F.struct(*values)
    wide = flat.groupBy(*on, "a", "b").agg(
        F.max(F.when(F.col("_side") == 0, row)).alias("_a"), F.max(F.when(F.col("_side") == 1, row)).alias("_b"))
    wide = wide.where("_a is not null and _b is not null")
    return wide.select(*on, "a", "b", *[F.col(f"_a.{v}").alias(f"{v}_a") for v in values],
                       *[F.col(f"_b.{v}").alias(f"{v}_b") for v in values])


def identical_prompt_pairs(answers: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """Two arms of one scenario and model that were sent the very same prompt."""
    digest = answers.withColumn("_h", F.sha2("prompt", 256))
    a = digest.where((F.col("method_label") == arm_a) & F.col("copied_from").isNull())
    b = digest.where(F.col("method_label") == arm_b)
    keys = ["scenario_id", "model_key", "_h"]
    b = b.select(*keys, F.col("key").alias("key_b"), F.col("prompt").alias("_pb"))
    return a.join(b, keys).where(F.col("prompt") == F.col("_pb")).select(
        "scenario_id", "model_key", F.col("key").alias("key_a"), "key_b")


def reuse(plan: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Planned work whose selection equals an existing answer's: adds ``copied_from``, cost 0."""
    f = facts.select(*on, F.col("key").alias("_key"), F.col("selected").alias("_sel"), F.col("usd").alias("_usd"))
    j = plan.join(f, list(on), "left")
    same = F.col("selected") == F.col("_sel")
    return j.withColumn("copied_from", F.when(same, F.col("_key"))).withColumn(
        "reused_usd", F.when(same, F.lit(0.0))).drop("_key", "_sel", "_usd")


def inherit(answers: DataFrame, verdicts: DataFrame, judge: str) -> DataFrame:
    """Copied answers take the source's verdict by the same judge: adds ``inherited_score``, ``todo``."""
    src = verdicts.where(F.col("judge_model") == judge)
    own = src.select("key", F.lit(True).alias("_own"))
    v = src.select(F.col("key").alias("copied_from"), F.col("checklist_score").alias("inherited_score"),
                   F.lit(True).alias("_src"))
    j = answers.join(own, "key", "left").where(F.col("_own").isNull()).join(v, "copied_from", "left")
    return j.select("key", "copied_from", "inherited_score", F.col("_src").isNull().alias("todo"))


def override(old: DataFrame, new: DataFrame) -> DataFrame:
    """Score per key: the new verdict if there is one, else the old."""
    n = new.select("key", F.col("checklist_score").alias("_new"))
    return old.select("key", F.col("checklist_score").alias("old_score")).join(n, "key", "left").select(
        "key", "old_score", F.coalesce("_new", "old_score").alias("checklist_score"),
        F.col("_new").isNotNull().alias("overridden"))


def before_after(before: DataFrame, after: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    b = before.select(*on, F.col(value).alias("before"))
    return b.join(after.select(*on, F.col(value).alias("after")), list(on)).withColumn(
        "difference", F.col("after") - F.col("before"))


def exclude_flagged(facts: DataFrame, flag: Column, arms: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Drops the scenarios flagged on any of the arms."""
    bad = facts.where(F.col("method_label").isin(list(arms)) & flag).select(*on).distinct()
    return facts.join(bad, list(on), "left_anti")


def eligible(answers: DataFrame, verdicts: DataFrame, labels: Sequence[str]) -> DataFrame:
    ok = verdicts.where(F.col("checklist_score").isNotNull() & ~F.isnan("checklist_score"))
    return answers.where(F.col("method_label").isin(list(labels))).join(ok.select("key"), "key", "left_semi")


def off_route(verdicts: DataFrame, primary: str) -> DataFrame:
    """Verdicts of a known route other than the primary one, not copied."""
    return verdicts.where(F.col("judge_route").isNotNull() & (F.col("judge_route") != primary)
                          & F.col("copied_from").isNull())


def align_items(reference: DataFrame, candidate: DataFrame, required: DataFrame) -> DataFrame:
    """Two judges item by item over every required item of keys both have judged.

    reference(key, item, satisfied), candidate(key, judge, item, satisfied),
    required(key, item).  A missing verdict counts as not satisfied.
    """
    judged = candidate.select("key", "judge").distinct()
    both = judged.join(reference.select("key").distinct(), "key", "left_semi")
    grid = both.join(required.select("key", "item"), "key")
    r = reference.select("key", "item", F.col("satisfied").alias("ref"))
    c = candidate.select("key", "judge", "item", F.col("satisfied").alias("cand"))
    j = grid.join(r, ["key", "item"], "left").join(c, ["key", "judge", "item"], "left")
    return j.select("key", "judge", "item", F.coalesce("ref", F.lit(False)).alias("ref"),
                    F.coalesce("cand", F.lit(False)).alias("cand"))
