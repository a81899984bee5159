"""Corpus rules: what must hold for a conversation to be admitted.

Inputs are long tables (see ``explode_scenarios``), so a conversation of any
length is checked in parallel.  Output: ``violations(sid, rule, severity, n)``
with ``n`` the number of places; ``ok`` means no row of severity ``error``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage, small_parts
from convgraph.functions.text import signposting
from convgraph.operators import graph

# Conversation families, those without a wrong branch to warn of,
# and the phrases that make a checklist item negative.
FAMILIES = (
    "continuation", "topic_fork", "resume", "new_root", "two_branch_join", "three_way_join", "semantic_decoy",
    "constraint_retention", "knowledge_update", "ambiguous_reference", "long_noisy_side_thread", "join_then_split",
    "compound_turn",
)
NO_NEGATIVE_NEEDED = ("continuation", "new_root")
NEGATIVE_PHRASES = ("must not", "should not", "must NOT", "not describe", "not use", "not treat", "not assume",
                    "not incorporate", "not mention")
MIN_TURNS, MAX_TURNS = 6, 45
MIN_ITEMS, MAX_ITEMS = 2, 4
MIN_CRITERION_WORDS = 6


@dataclass(frozen=True)
class Corpus:
    """scenarios(sid, family, has_note); turns(sid, pos, turn_id, turn_index, user_message,
    assistant_message, stale, superseded_by, is_query); parents(sid, turn_id, parent_id, pos);
    marks(sid, turn_id, kind) with kind evidence, distractor or span;
    checklist(sid, item_id, criterion, required)."""

    scenarios: DataFrame
    turns: DataFrame
    parents: DataFrame
    marks: DataFrame
    checklist: DataFrame


def explode_scenarios(docs: DataFrame) -> Corpus:
    """Scenario documents to the long tables."""
    d = docs.withColumnRenamed("scenario_id", "sid")
    t = d.select("sid", (F.size("turns") - 1).alias("_last"), F.posexplode("turns").alias("pos", "t"))
    turns = t.select("sid", "pos", "t.turn_id", "t.turn_index", "t.user_message", "t.assistant_message",
                     F.coalesce("t.stale", F.lit(False)).alias("stale"), "t.superseded_by",
                     (F.col("pos") == F.col("_last")).alias("is_query"))
    parents = t.select("sid", "t.turn_id", F.posexplode("t.gold_parents").alias("pos", "parent_id")).select(
        "sid", "turn_id", "parent_id", "pos")
    mark = lambda c, k: d.select("sid", F.explode(c).alias("turn_id"), F.lit(k).alias("kind"))
    marks = mark("evidence_turn_ids", "evidence").unionByName(mark("distractor_turn_ids", "distractor")).unionByName(
        mark(F.map_keys("evidence_spans"), "span"))
    check = d.select("sid", F.inline("answer_checklist")).select(
        "sid", F.col("id").alias("item_id"), "criterion", F.coalesce("required", F.lit(True)).alias("required"))
    scen = d.select("sid", "family", (F.coalesce("evidence_note", F.lit("")) != "").alias("has_note"))
    return Corpus(scen, turns, parents, marks, check)


def _blank(c):
    return F.coalesce(F.regexp_replace(c, r"\s", ""), F.lit("")) == ""


def _rows(df: DataFrame, rule: str, severity: str = "error") -> DataFrame:
    return df.select("sid", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def _turn_rules(c: Corpus) -> DataFrame:
    rules = [
        F.when(F.col("turn_index") != F.col("pos"), "V3 turn_index out of order"),
        F.when(F.col("stale") & F.col("superseded_by").isNull(), "V9 stale without superseder"),
        F.when(F.col("superseded_by").isNotNull() & ~F.col("stale"), "V8c superseder on a turn that is not stale"),
        F.when(_blank(F.col("user_message")), "V10 blank user message"),
        F.when(F.size(signposting(F.col("user_message"))) > 0, "V11 signposting"),
        F.when(F.col("is_query") & F.col("assistant_message").isNotNull(), "V14 query has an answer"),
        F.when(~F.col("is_query") & _blank(F.col("assistant_message")), "V15 blank answer in history"),
    ]
    hits = c.turns.select("sid", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule"))
    return hits.select("sid", "rule", F.lit("error").alias("severity"))


def _reference_rules(c: Corpus) -> DataFrame:
    ids = c.turns.groupBy("sid", "turn_id").agg(
        F.max_by("turn_index", "pos").alias("_at"), F.count(F.lit(1)).alias("_n"), F.max("is_query").alias("_q"))
    at = lambda name: ids.select("sid", F.col("turn_id").alias(name), F.col("_at").alias(f"_{name}"))
    own = c.turns.select("sid", "turn_id", "turn_index", "superseded_by")
    par = c.parents.join(at("turn_id"), ["sid", "turn_id"]).join(at("parent_id"), ["sid", "parent_id"], "left")
    par = par.withColumn("rule", F.when(F.col("_parent_id").isNull(), "V5 parent missing").when(
        F.col("_parent_id") >= F.col("_turn_id"), "V6 parent not earlier")).where("rule is not null")
    sup = own.where("superseded_by is not null").join(at("superseded_by"), ["sid", "superseded_by"], "left")
    sup = sup.withColumn("rule", F.when(F.col("_superseded_by").isNull(), "V8a superseder missing").when(
        F.col("_superseded_by") <= F.col("turn_index"), "V8b superseder not later")).where("rule is not null")
    err = F.lit("error").alias("severity")
    double_parent = c.parents.groupBy("sid", "turn_id", "parent_id").count().where("count > 1").select("sid", "turn_id").distinct()
    ev = F.col("kind").isin("evidence", "distractor")
    listed = c.marks.join(ids.select("sid", "turn_id", "_q"), ["sid", "turn_id"], "left")
    kinds = c.marks.groupBy("sid", "turn_id").agg(
        F.count_if(F.col("kind") == "evidence").alias("_e"), F.count_if(F.col("kind") == "distractor").alias("_d"),
        F.count_if(F.col("kind") == "span").alias("_s"))
    loose = c.turns.where(~F.col("is_query")).select("sid", "turn_id").distinct().join(
        c.marks.where(ev).select("sid", "turn_id").distinct(), ["sid", "turn_id"], "left_anti")
    parts = [
        _rows(ids.where("_n > 1"), "V2 duplicate turn id"),
        par.select("sid", "rule", err), sup.select("sid", "rule", err),
        _rows(double_parent, "V7 duplicate parents"),
        _rows(listed.where(ev & F.col("_q").isNull()), "V12 mark on a missing turn"),
        _rows(kinds.where("_s > 0 and _e = 0"), "V13 span outside evidence"),
        _rows(listed.where(ev & F.col("_q")).select("sid").distinct(), "V16 query is marked"),
        _rows(kinds.where("_e > 0 and _d > 0"), "V17 evidence and distractor overlap"),
        _rows(loose, "V18 history turn not covered", "warn"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _scenario_rules(c: Corpus) -> DataFrame:
    known = F.col("family").isin(list(FAMILIES))
    n = c.turns.groupBy("sid").agg(F.count(F.lit(1)).alias("_n"))
    return _rows(c.scenarios.where(~known), "V1 unknown family").unionByName(
        _rows(n.where((F.col("_n") < MIN_TURNS) | (F.col("_n") > MAX_TURNS)), "V4 turn count", "warn"))


def _checklist_rules(c: Corpus) -> DataFrame:
    negative = reduce(lambda a, b: a | b, [F.col("criterion").contains(p) for p in NEGATIVE_PHRASES])
    words = F.size(F.filter(F.split(F.col("criterion"), r"\s+"), lambda w: w != ""))
    per = c.checklist.groupBy("sid").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("item_id").alias("_ids"), F.max(F.coalesce("required", F.lit(False))).alias("_req"),
        F.max(negative).alias("_neg"), F.count_if(words < MIN_CRITERION_WORDS).alias("_short"))
    d = c.scenarios.join(per, "sid", "left")
    n = F.coalesce("_n", F.lit(0))
    need = F.col("family").isin([f for f in FAMILIES if f not in NO_NEGATIVE_NEEDED])
    rule = lambda cond, name, sev="error": F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("severity")))
    rules = F.array(
        rule((n < MIN_ITEMS) | (n > MAX_ITEMS), "V21 checklist size", "warn"), rule(F.col("_ids") < n, "V22 duplicate checklist id"),
        rule(~F.coalesce("_req", F.lit(False)), "V23 nothing required"),
        rule(need & ~F.coalesce("_neg", F.lit(False)), "V24 no negative item"))
    one = d.select("sid", F.inline(F.filter(rules, lambda x: x.isNotNull())))
    short = _rows(d.select("sid", F.explode(F.array_repeat(F.lit(1), F.coalesce(F.col("_short"), F.lit(0)).cast("int")))),
                  "V25 short criterion", "warn")
    return one.unionByName(short)


def closure_rules(c: Corpus, clean: DataFrame) -> DataFrame:
    """V19 and V20 on conversations without an error so far (``clean(sid)``)."""
    t = c.turns.join(clean, "sid", "left_semi")
    size = t.groupBy("sid").agg(F.max("pos").alias("_last"))
    idx = cut_lineage(t.join(size, "sid").select(
        "sid", "turn_id", F.col("pos").cast("bigint").alias("idx"),
        (F.col("_last") - F.col("pos")).cast("bigint").alias("rev"), "stale", "superseded_by"))
    at = lambda name: idx.select("sid", F.col("turn_id").alias(name), F.col("idx").alias(f"_{name}"))
    edges = c.parents.join(at("turn_id"), ["sid", "turn_id"]).join(at("parent_id"), ["sid", "parent_id"]).select(
        "sid", F.col("_turn_id").alias("child"), F.col("_parent_id").alias("parent"), "pos")
    closed = cut_lineage(graph.closure(idx, edges))
    names = closed.join(idx.select("sid", "idx", "turn_id"), ["sid", "idx"]).select("sid", "turn_id", F.lit(1).alias("_c"))
    ev = c.marks.where("kind = 'evidence'").join(clean, "sid", "left_semi").select("sid", "turn_id", F.lit(1).alias("_e")).distinct()
    differ = names.join(ev, ["sid", "turn_id"], "full").where("_c is null or _e is null").select("sid").distinct()
    mismatch = differ.join(c.scenarios.select("sid", "has_note"), "sid").select(
        "sid", F.when(F.col("has_note"), "V19 closure differs, reviewed").otherwise("V19 closure differs, flagged").alias("rule"),
        F.lit("warn").alias("severity"))
    stale = idx.where("stale").join(names, ["sid", "turn_id"]).select("sid", F.col("superseded_by").alias("turn_id"))
    return mismatch.unionByName(_rows(stale.join(names, ["sid", "turn_id"], "left_anti"), "V20 superseder outside the closure"))


def violations(c: Corpus) -> DataFrame:
    with small_parts(c.turns.sparkSession):
        # the hits are few and feed both the result and the choice of clean conversations
        first = cut_lineage(_scenario_rules(c).unionByName(_turn_rules(c)).unionByName(_reference_rules(c)))
        bad = first.where("severity = 'error'").select("sid").distinct()
        clean = cut_lineage(c.scenarios.select("sid").join(bad, "sid", "left_anti"))
        rows = first.unionByName(closure_rules(c, clean)).unionByName(_checklist_rules(c))
        return cut_lineage(rows.groupBy("sid", "rule", "severity").agg(F.count(F.lit(1)).alias("n")))


def report(c: Corpus, found: DataFrame) -> DataFrame:
    """(sid, status, n_turns, n_evidence, n_distractors, n_errors, n_warnings)."""
    t = c.turns.groupBy("sid").agg(F.count(F.lit(1)).alias("n_turns"))
    m = c.marks.groupBy("sid").agg(F.count_if(F.col("kind") == "evidence").alias("n_evidence"),
                                   F.count_if(F.col("kind") == "distractor").alias("n_distractors"))
    v = found.groupBy("sid").agg(F.sum(F.when(F.col("severity") == "error", F.col("n"))).alias("n_errors"),
                                 F.sum(F.when(F.col("severity") == "warn", F.col("n"))).alias("n_warnings"))
    z = lambda x: F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
    return t.join(m, "sid", "left").join(v, "sid", "left").select(
        "sid", F.when(F.coalesce("n_errors", F.lit(0)) > 0, "ERR").otherwise("OK").alias("status"), "n_turns",
        z("n_evidence"), z("n_distractors"), z("n_errors"), z("n_warnings"))


def admitted(c: Corpus, found: DataFrame) -> DataFrame:
    return c.scenarios.join(found.where("severity = 'error'").select("sid").distinct(), "sid", "left_anti")


def family_counts(scenarios: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Families whose number of scenarios is not the target: (family, n, target)."""
    t = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    listed = F.explode(F.array(*[F.lit(k) for k in targets]))
    n = scenarios.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    none = scenarios.sparkSession.range(1).select(listed.alias("family"), F.lit(0).cast("bigint").alias("n"))
    every = n.unionByName(none).groupBy("family").agg(F.sum("n").alias("n"))
    return every.select("family", "n", F.coalesce(t[F.col("family")], F.lit(0)).alias("target")).where("n <> target")
