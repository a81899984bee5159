"""Rules for long conversations.

``turns(sid, idx, rev, family, turn_id, user_message, assistant_message, cost,
is_evidence, is_distractor)``, one row per turn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convgraph.functions.splitwin import salted_join, split_percentile
from convgraph.functions.text import turn_text
from convgraph.operators.graph import closure_ratio

# Fixed values of the rules.
MIN_USER_CHARS, MIN_ANSWER_CHARS = 15, 40
MIN_HISTORY_TOKENS = 4000
REPORTED_TURNS = 8
MIN_REGISTRY, MIN_SHARED = 4, 2
MIN_COSINE_RATIO = 0.60
NEGATIVE_START = "the answer must not"
LOCAL_FAULTS = ("topic-switch signposting", "is too thin")


def _answer_chars():
    return F.length(F.coalesce("assistant_message", F.lit("")))


def thin_turns(turns: DataFrame) -> DataFrame:
    h = turns.where("rev > 0")
    return h.where((F.length("user_message") < MIN_USER_CHARS) | (_answer_chars() < MIN_ANSWER_CHARS)).select("sid", "idx", "turn_id")


def short_history(turns: DataFrame, min_tokens: int = MIN_HISTORY_TOKENS) -> DataFrame:
    """Of conversations below the token minimum, the turns with the shortest answers."""
    h = turns.where("rev > 0")
    low = h.groupBy("sid").agg(F.sum("cost").alias("full_tokens")).where(F.col("full_tokens") < min_tokens)
    w = Window.partitionBy("sid").orderBy("n_chars", "idx")
    ranked = h.select("sid", "idx", "turn_id", _answer_chars().alias("n_chars")).withColumn("_rn", F.row_number().over(w))
    return ranked.where(F.col("_rn") <= REPORTED_TURNS).join(low, "sid").select("sid", "turn_id", "n_chars", "full_tokens")


def _named(turns: DataFrame, names: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(sid, idx, *carry, name) of the names that occur in a turn, case ignored; salted by turn."""
    body = turns.select("sid", "idx", *carry, F.lower(turn_text(F.col("user_message"), F.col("assistant_message"))).alias("_t"))
    # names of all conversations are many: sorted, not sent to every executor
    return salted_join(body, names.select("sid", "name").hint("merge"), ["sid"], F.col("idx")).where(
        F.contains("_t", F.lower("name"))).select("sid", "idx", *carry, "name")


def effective_registry(turns: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry names the gold turns use; without gold turns, the first two turns."""
    per = turns.groupBy("sid").agg(F.max("is_evidence").alias("_has"))
    h = turns.where("rev > 0").where(F.col("is_evidence") | (F.col("idx") < 2))
    gold = h.join(per, "sid").where(F.col("is_evidence") | ~F.col("_has"))
    return _named(gold, registry).select("sid", "name").distinct()


def registry_check(registry: DataFrame, effective: DataFrame, min_registry: int = MIN_REGISTRY, min_used: int = MIN_SHARED) -> DataFrame:
    e = effective.select("sid", "name", F.lit(1).alias("_e"))
    g = registry.select("sid", "name").distinct().join(e, ["sid", "name"], "left").groupBy("sid").agg(
        F.count(F.lit(1)).alias("n_registry"), F.count("_e").alias("n_effective"))
    return g.select("*", (F.col("n_registry") < min_registry).alias("too_small"), (F.col("n_effective") < min_used).alias("too_few_used"))


def branch_entities(turns: DataFrame, branches: DataFrame, effective: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Effective names each distractor branch mentions: (sid, root, n_hits, fails)."""
    t = turns.join(branches.select("sid", "idx", "root").hint("merge"), ["sid", "idx"])
    hit = _named(t, effective, ("root",)).select("sid", "root", "name").distinct()
    n = hit.groupBy("sid", "root").agg(F.count(F.lit(1)).alias("_n"))
    return branches.select("sid", "root").distinct().join(n.hint("merge"), ["sid", "root"], "left").select(
        "sid", "root", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_hits"), (F.coalesce("_n", F.lit(0)) < min_shared).alias("fails"))


def near_miss_faults(turns: DataFrame, near: DataFrame) -> DataFrame:
    """Conversations whose near-miss turn is not a distractor; near(sid, near_miss)."""
    d = turns.where("is_distractor").select("sid", F.col("turn_id").alias("near_miss"))
    return near.join(d, ["sid", "near_miss"], "left_anti").select("sid", "near_miss")


def cited_turns(items: DataFrame) -> DataFrame:
    """(sid, item, turn_id); a bare number n means turn ``tn``."""
    ref = items.select("sid", "item", F.explode("refs").alias("_c")).withColumn("_r", F.trim("_c"))
    return ref.select("sid", "item", F.when(F.col("_r").rlike(r"^[0-9]+$"), F.concat(F.lit("t"), "_r")).otherwise(F.col("_r")).alias("turn_id"))


def citation_faults(turns: DataFrame, items: DataFrame, exempt: Sequence[str] = ("new_root",)) -> DataFrame:
    """Items that cite nothing, or turns outside the gold set: (sid, item, fault, n)."""
    pos = items.where(~F.lower("criterion").startswith(NEGATIVE_START))
    none = pos.where((F.size("refs") == 0) & ~F.col("family").isin(list(exempt))).select(
        "sid", "item", F.lit("cites nothing").alias("fault"), F.lit(1).cast("bigint").alias("n"))
    gold = turns.where("is_evidence").select("sid", "turn_id")
    out = cited_turns(pos).join(gold, ["sid", "turn_id"], "left_anti").groupBy("sid", "item").agg(F.count(F.lit(1)).alias("n"))
    return none.unionByName(out.select("sid", "item", F.lit("cites turns outside the closure").alias("fault"), "n"))


def join_faults(turns: DataFrame, items: DataFrame, gold_branch: DataFrame, families: Sequence[str]) -> DataFrame:
    """Join conversations whose citations touch fewer than two gold branches; gold_branch(sid, turn_id, branch)."""
    q = turns.where((F.col("rev") == 0) & F.col("family").isin(list(families))).select("sid")
    n = cited_turns(items).join(gold_branch, ["sid", "turn_id"]).groupBy("sid").agg(F.count_distinct("branch").alias("_n"))
    return q.join(n, "sid", "left").select("sid", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_branches")).where("n_branches < 2")


def cosine_gate(turns: DataFrame, cosine: DataFrame, min_ratio: float = MIN_COSINE_RATIO) -> DataFrame:
    """Median distractor over median gold similarity; passes without gold turns."""
    role = turns.select("sid", "idx", F.when(F.col("is_evidence"), "gold").when(F.col("is_distractor"), "distractor").alias("role"))
    c = cosine.join(role.where("role is not null"), ["sid", "idx"])
    med = split_percentile(c, ["sid", "role"], "cosine", {"m": 0.5}, F.floor(F.col("cosine") * 64))
    at = lambda r: F.max(F.when(F.col("role") == r, F.col("m")))
    g = med.groupBy("sid").agg(at("gold").alias("gold_median"), at("distractor").alias("distractor_median"))
    g = g.withColumn("ratio", F.try_divide("distractor_median", "gold_median"))
    return g.withColumn("pass", F.col("gold_median").isNull() | F.coalesce(F.col("ratio") >= min_ratio, F.lit(False)))


def sidecar(turns: DataFrame, closed: DataFrame, registry: DataFrame, gate: DataFrame) -> DataFrame:
    t = turns.where("rev > 0").groupBy("sid").agg(F.first("family").alias("family"), F.sum("cost").alias("full_history_tokens"))
    r = registry.groupBy("sid").agg(F.count(F.lit(1)).alias("n_registry"))
    return t.join(closure_ratio(turns, closed), "sid").join(r, "sid", "left").join(gate, "sid", "left")


def triage(errors: DataFrame) -> DataFrame:
    """Per conversation: turns named in errors, and whether a local repair can fix them all; errors(sid, error)."""
    tid = F.regexp_extract("error", r"^(t\d+)\b", 1)
    local = F.contains("error", F.lit(LOCAL_FAULTS[0])) | F.contains("error", F.lit(LOCAL_FAULTS[1]))
    return errors.groupBy("sid").agg(F.count_distinct(F.nullif(tid, F.lit(""))).alias("n_turns"), F.bool_and(local).alias("repairable"))
