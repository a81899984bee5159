import json
import os
import random

import pytest
from pyspark.sql import functions as F

from convgraph.functions.text import render_turn, token_count
from convgraph.operators import graph, quality, spend
from convgraph.sources import caches, documents, logs, schemas, sinks
from convgraph.streaming import ingest, ledger


def scenario(sid, **over):
    n = 8
    turns = [{"turn_id": f"t{i}", "turn_index": i, "user_message": f"Question number {i} here", "gold_parents": [f"t{i - 1}"] if i else [],
              "assistant_message": f"Answer number {i}" if i < n - 1 else None} for i in range(n)]
    d = {"scenario_id": sid, "family": "topic_fork", "label": "x", "turns": turns,
         "evidence_turn_ids": [f"t{i}" for i in range(n - 1)], "distractor_turn_ids": [],
         "answer_checklist": [{"id": "c1", "criterion": "the answer names the agreed day", "required": True},
                              {"id": "c2", "criterion": "the answer must not name another day"}]}
    d.update(over)
    return d


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    p = tmp_path_factory.mktemp("docs")
    a, b, c = scenario("s1"), scenario("s2", family="unknown", benchmark_version="1.1"), scenario("s3")
    c["turns"][3].update(gold_parents=["t3", "t99"], user_message="Meanwhile, the rest")
    c["turns"][2].update(stale=True)
    for d in (a, b, c):
        (p / f"{d['scenario_id']}.json").write_text(json.dumps(d, indent=2))
    return str(p)


def test_documents_and_rules(spark, folder, tmp_path):
    s = documents.read_scenarios(spark, folder)
    assert {r.scenario_id: r.benchmark_version for r in s.collect()} == {"s1": "1.0", "s2": "1.1", "s3": "1.0"}
    c = quality.explode_scenarios(s)
    found = quality.violations(c)
    got = {(r.sid, r.rule.split()[0]) for r in found.collect()}
    assert got == {("s2", "V1"), ("s3", "V5"), ("s3", "V6"), ("s3", "V9"), ("s3", "V11")}
    rep = {r.sid: r.status for r in quality.report(c, found).collect()}
    assert rep == {"s1": "OK", "s2": "ERR", "s3": "ERR"}
    documents.write_scenarios(s, str(tmp_path / "out"))
    again = spark.read.schema(schemas.SCENARIO).json(str(tmp_path / "out"))
    assert again.count() == 3
    turns, edges = documents.explode_turns(s.where("scenario_id = 's1'"), lambda t: token_count(render_turn(t["user_message"], t["assistant_message"])))
    assert graph.closure(turns, edges).count() == 7
    assert turns.where("rev = 0").first().idx == 7


def test_family_targets(spark):
    f = spark.createDataFrame([("a",), ("a",), ("b",)], "family string")
    assert {(r.family, r.n, r.target) for r in quality.family_counts(f, {"a": 2, "b": 2, "c": 1}).collect()} == {("b", 1, 2), ("c", 0, 1)}


def test_logs(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"key": "a", "judge_model": "j", "checklist_score": 0.5}\n{"key": "b", "jud\n')
    assert [r.key for r in logs.read_log(spark, str(p), schemas.VERDICT).collect()] == ["a"]
    with pytest.raises(Exception):
        logs.read_log(spark, str(p), schemas.VERDICT, "fail").collect()
    assert logs.read_log(spark, str(tmp_path / "absent"), schemas.VERDICT).count() == 0
    sinks.append_records(spark.createDataFrame([("c",)], "key string"), str(tmp_path / "app"))
    sinks.append_records(spark.createDataFrame([("d",)], "key string"), str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 2
    nan = logs.nan_to_null(spark.createDataFrame([(float("nan"), "x"), (1.0, "y")], "v double, s string"))
    assert [r.v for r in nan.orderBy("s").collect()] == [None, 1.0]


def test_selection_cache_overlay(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"s|1|1024": ["t1", "t2"], "s2|matched_budget": 77}))
    (tmp_path / "b.json").write_text(json.dumps({"s|1|1024": ["t9"]}))
    got = {r.scenario_id: r for r in caches.read_selection_cache(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).collect()}
    assert got["s|1"].selected == ["t9"] and got["s|1"].budget == 1024
    assert got["s2"].matched_budget == 77 and got["s2"].selected is None


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    sinks.write_csv(d, str(tmp_path / "t"), single_file=True)
    assert sorted(logs.read_table(spark, str(tmp_path / "t"), "k string, v double").collect()) == sorted(d.collect())
    sinks.write_json(d.limit(1), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"k": "a", "v": 1.5}
    (tmp_path / "keys.json").write_text('{"n": 2, "keys": ["x", "y"]}')
    assert {r.key for r in logs.keys_from_json(spark, str(tmp_path / "keys.json")).collect()} == {"x", "y"}


CALLS = [(float(i), f"r{i:03d}", m, "p" if i % 2 else None, "s", 1_000_000, 0) for i, m in enumerate(["us.a", "global.a", "b", "us.a"])]


def test_prices_and_budget(spark):
    c = spark.createDataFrame(CALLS, "ts double, ref string, model string, purpose string, scope string, input_tokens bigint, output_tokens bigint")
    prices = {"us.a": (2.0, 4.0), "b": (1.0, 1.0)}
    assert [r.usd for r in spend.price_calls(c, prices).orderBy("ts").collect()] == [2.0, 2.0, 1.0, 2.0]
    with pytest.raises(Exception, match="no price"):
        spend.price_calls(c, {"us.a": (2.0, 4.0)}, strict=True).collect()
    s = spend.budget_status(spend.price_calls(c, prices), F.floor(F.col("ts") / 2), 4, 7).first()
    assert (s.usd, s.warn_ref, s.stop_ref, s.status) == (7.0, "r001", "r003", "stop")
    assert spend.limits_in_order(1, 2, 3) and not spend.limits_in_order(1, 3, 2)


def test_streams_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "key string, v int, ts timestamp"
    for i, rows in enumerate(([("a", 1, 10), ("b", 2, 11)], [("a", 3, 12), ("c", 4, 13)])):
        (src / f"{i}.json").write_text("".join(json.dumps({"key": k, "v": v, "ts": f"2024-01-01T00:00:{t}Z"}) + "\n" for k, v, t in rows))
        os.utime(src / f"{i}.json", (1_700_000_000 + 60 * i,) * 2)  # files arrive in the order of their times
    st = spark.createDataFrame([], schema).schema
    got = ingest.run_to_files(ingest.dedupe_stream(ingest.read_log(spark, str(src), st, max_files=1), "key", "ts", "1 hour"))
    assert {(r.key, r.v) for r in got.collect()} == {("a", 1), ("b", 2), ("c", 4)}
    exact = ingest.first_by_key_stream(ingest.read_log(spark, str(src), st, max_files=1), "key", ["ts"])
    assert {(r.key, r.v) for r in exact.collect()} == {("a", 1), ("b", 2), ("c", 4)}


def test_first_records_by_spans_keep_a_bounded_state(spark, tmp_path):
    """Twenty days of records, a few hours out of order, in twenty files: each key once, old spans forgotten, late rows counted."""
    src = tmp_path / "days"
    src.mkdir()
    rng, rows = random.Random(6), []
    for day in range(20):
        part = [(f"k{day}_{j % 30}", j, f"2024-01-{day + 1:02d}T{rng.randrange(24):02d}:{rng.randrange(60):02d}:00Z") for j in range(90)]
        if day == 12:
            part += [("old", 1, "2024-01-02T00:00:00Z"), ("old", 2, "2024-01-03T00:00:00Z")]
        rows += part
        (src / f"{day:02d}.json").write_text("".join(json.dumps({"key": k, "v": v, "ts": t}) + "\n" for k, v, t in part))
        os.utime(src / f"{day:02d}.json", (1_700_000_000 + 60 * day,) * 2)
    schema = spark.createDataFrame([], "key string, v int, ts timestamp").schema
    got = ingest.first_record_stream(ingest.read_log(spark, str(src), schema, max_files=1), "key", "ts", ["ts", "v"], "6 hours", "1 day")
    want = {}
    for k, v, t in rows:
        if k != "old":
            want[k] = min(want.get(k, (t, v)), (t, v))
    assert {(r.key, r.v) for r in got.rows.collect()} == {(k, v) for k, (_, v) in want.items()}
    assert got.late == 2 and max(got.state) <= 3 * 30 + 1 and len(got.state) >= 20


def test_selection_cache_is_filled_once(spark, tmp_path):
    from convgraph.operators import select

    t = spark.createDataFrame([(s, i, 3 - i, 10 * (i + 1)) for s in range(4) for i in range(4)], "sid bigint, idx bigint, rev bigint, cost bigint")
    path, seen = str(tmp_path / "cache"), []

    def choose(turns, budgets):
        seen.append(sorted(r.sid for r in turns.select("sid").distinct().collect()))
        return select.sliding_window(turns, budgets)

    assert caches.update_selection_cache(t.where("sid < 2"), [30, 50], choose, path) == 4
    assert caches.update_selection_cache(t, [30, 50], choose, path) == 4
    assert caches.update_selection_cache(t, [30, 50, 5], choose, path) == 4
    assert caches.update_selection_cache(t, [30, 50, 5], choose, path) == 0
    assert seen == [[0, 1], [2, 3], [0, 1, 2, 3]]
    got = {(r.scenario_id, r.budget): r.selected for r in caches.read_cache_folder(spark, path).collect()}
    assert len(got) == 12 and got["0", 50] == ["1", "2"] and got["3", 30] == ["2"] and got["2", 5] == []


def test_spend_stream(spark, tmp_path):
    src = tmp_path / "calls"
    c = spark.createDataFrame(CALLS, "ts double, ref string, model string, purpose string, scope string, input_tokens bigint, output_tokens bigint")
    c.repartition(2).write.json(str(src))
    t = ledger.run_spend(ingest.read_log(spark, str(src), c.schema, max_files=1), {"us.a": (2.0, 4.0), "b": (1.0, 1.0)}, 2, 4)
    assert {(r.model, r.purpose): (r.usd, r.status) for r in t.collect()} == {
        ("us.a", "?"): (2.0, "stop"), ("global.a", "p"): (2.0, "stop"), ("b", "?"): (1.0, "stop"), ("us.a", "p"): (2.0, "stop")}


def test_only_the_last_line_of_a_file_may_be_broken(spark, tmp_path):
    schema = "a int, b string"
    good = ['{"a": 1, "b": "x"}', '{"a": 2}', "", '{"a": 3, "b": "y"}']
    (tmp_path / "tail").mkdir()
    (tmp_path / "tail" / "1.json").write_text("\n".join([*good, '{"a": 4, "b']))
    (tmp_path / "tail" / "2.json").write_text('{"a": 9}\n')
    assert sorted(r.a for r in logs.read_log(spark, str(tmp_path / "tail"), schema, "tail").collect()) == [1, 2, 3, 9]
    got = {r.file.rsplit("/", 1)[1]: (r.n_lines, r.n_broken, r.n_tail) for r in logs.broken_lines(spark, str(tmp_path / "tail"), schema).collect()}
    assert got == {"1.json": (4, 1, 1), "2.json": (1, 0, 0)}
    (tmp_path / "mid").mkdir()
    (tmp_path / "mid" / "3.json").write_text("\n".join([good[0], '{"a": 4, "b', good[1]]))
    with pytest.raises(ValueError, match="3.json"):
        logs.read_log(spark, str(tmp_path / "mid"), schema, "tail")
    assert logs.read_log(spark, str(tmp_path / "none"), schema, "tail").count() == 0


def test_sidecars_by_file_name(spark, tmp_path):
    from convgraph.sources import documents

    (tmp_path / "s1.json").write_text(json.dumps({"target": "s1", "base_history": 7, "chosen": [{"donor": "a#0", "turns": 3, "cosine": 0.5}]}, indent=2))
    (tmp_path / "s2.json").write_text(json.dumps({"target": "s2", "extra": 1}, indent=2))
    got = {r.name: r for r in documents.read_sidecars(spark, str(tmp_path), schemas.SPLICE_SIDECAR).collect()}
    assert got["s1"].base_history == 7 and got["s1"].chosen[0].donor == "a#0" and got["s2"].chosen is None


def test_pivot_round_trip(spark, tmp_path):
    rows = [("f1", "m1", "a", 1.5), ("f1", "m2", "a", -2.0), ("f2", "m1", "b", 3.25)]
    long = spark.createDataFrame(rows, "family string, model string, method string, v double")
    sinks.write_pivot(long, "family", ("model", "method"), "v", str(tmp_path / "p"))
    text = [r.value for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert text[:2] == ["model,m1,m1,m2", "method,a,b,a"]
    assert sorted(map(tuple, logs.read_pivot(spark, str(tmp_path / "p"), "family", ("model", "method"), "v").collect())) == sorted(rows)
    sinks.write_pivot(long.limit(0), "family", ("model", "method"), "v", str(tmp_path / "e"))
    assert logs.read_pivot(spark, str(tmp_path / "e"), "family", ("model", "method"), "v").count() == 0
