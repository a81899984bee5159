"""A judge's text is parsed once per row, whatever is filtered afterwards."""

from pyspark.sql import functions as F

from convgraph.operators import verdicts as vd


def test_filter_reads_the_parsed_value(spark):
    rows = [(1, '```json\n{"checklist": [{"id": "c1", "satisfied": true}]}\n```'), (2, "no verdict here"), (3, "Here: {\"checklist\": []} Done."),
            (4, '[{"id": "c1", "satisfied": false}]'), (5, None)]
    raw = spark.createDataFrame(rows, "key long, text string").repartition(2)
    all_ = vd.parse_verdicts(raw)
    some = all_.where("items is not null")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and not any("regexp" in line or "parse" in line.lower() for line in filters)
    assert sorted(r["key"] for r in some.collect()) == [1, 3, 4]
    assert {r["key"]: r["parsed"] for r in all_.collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    bare = all_.where(F.col("parsed")).where("distractor_leakage is null").select("key", F.size("items").alias("n"))
    assert sorted(map(tuple, bare.collect())) == [(1, 1), (3, 0), (4, 1)]
