from pyspark.sql import functions as F

from convgraph.functions import text
from convgraph.operators import verdicts as vd


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first().x


def test_signposting(spark):
    hits = one(spark, "Meanwhile, going back to our plan; separately we met.", text.signposting)
    assert [h.lower() for h in hits] == ["meanwhile", "going back to", "separately"]
    assert one(spark, "We separate the lids.", text.signposting) == []


def test_retraction_reads_only_the_opening(spark):
    assert one(spark, "I don't actually have any record of it", text.is_retraction)
    assert not one(spark, "x" * 600 + " fabricated", text.is_retraction)
    assert not one(spark, None, text.is_retraction)


def test_regex_items(spark):
    t = 'Run `Make All` for max_size in DataFrameReader, said "Next  Week" and "Red  Door."; `x y`'
    assert sorted(one(spark, t, text.regex_items)) == ["dataframereader", "make all", "max_size", "red door", "x y"]


def test_bare_names_and_truncation(spark):
    for raw, want in (("Acme (a firm)", "Acme"), ("'Bolt' – a tool", "Bolt"), ("Core: part", "Core"), ("a-b", "a-b"), ("X [y]", "X")):
        assert one(spark, raw, text.bare_name) == want
    assert one(spark, "One, two  three", lambda c: text.truncate_tokens(c, F.lit(3))) == "One, two"
    assert one(spark, "One, two", text.token_count) == 3


def test_stale_turns_are_marked(spark):
    r = spark.createDataFrame([("q", "a", True), ("q", None, False)], "u string, a string, s boolean").select(
        text.render_turn(F.col("u"), F.col("a"), F.col("s")).alias("x")).collect()
    assert r[0].x.startswith("[Note:") and r[0].x.endswith("User: q\nAssistant: a\n")
    assert r[1].x == "User: q\nAssistant: \n"


def test_parse_and_score(spark):
    obj = '{"checklist": [{"id": "c1", "satisfied": true}, {"id": "c2", "satisfied": false}], "distractor_leakage": true}'
    raw = [("plain", obj), ("fence", f"```json\n{obj}\n```"), ("talk", f"Sure {{}} no: {obj}"), ("words", f"Sure: {obj} bye"),
           ("list", '[{"id": "c1", "satisfied": true}]'), ("none", "nothing"), ("empty", None)]
    v = vd.parse_verdicts(spark.createDataFrame(raw, "key string, text string"))
    got = {r["key"]: r for r in v.collect()}
    assert [got[k].parsed for k, _ in raw] == [True, True, True, True, True, False, False]
    # braces around unrelated text are no object; the list inside still is one
    assert got["talk"].distractor_leakage is None and len(got["talk"]["items"]) == 2
    assert got["list"].distractor_leakage is None and got["fence"].distractor_leakage == 1
    checks = spark.createDataFrame([(k, c, c != "c3") for k, _ in raw for c in ("c1", "c2", "c3")], "key string, item string, required boolean")
    s = {r["key"]: r for r in vd.score_verdicts(v.where("parsed"), checks).collect()}
    assert (s["plain"].checklist_score, s["plain"].n_required, s["plain"].n_satisfied, s["plain"].all_required_satisfied) == (0.5, 2, 1, 0)
    assert s["list"].checklist_score == 0.5
    none = vd.score_verdicts(v.where("key = 'plain'"), checks.withColumn("required", F.lit(False))).first()
    assert none.checklist_score is None and none.all_required_satisfied == 1


def test_items_from_literals(spark):
    m = lambda c: vd.item_map(vd.items_from_text(c))
    assert one(spark, "[{'id': 'a', 'satisfied': True}, {'id': 'b'}]", m) == {"a": True, "b": False}
    assert one(spark, '[{"id": "a", "satisfied": true}, {"id": "a", "satisfied": false}]', m) == {"a": False}


def test_one_decimal_prints_the_binary_value(spark):
    values = [k / 20 for k in range(-41, 2001)] + [49.65, 50.55, 0.05, 0.15, 45.25, 45.75, 99.95, 0.04999999999999999, 1e-9, 123456.35]
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = d.select("x", text.one_decimal(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [None if r.x is None else "%.1f" % r.x for r in got]
