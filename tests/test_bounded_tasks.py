"""Settings under which steps run whose tasks would otherwise grow with the input."""

from convgraph.functions import lineage
from convgraph.operators import quality, splice
from convgraph.plans import catalog_quality, catalog_splice

SF = "/root/testdata/sf0.001"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _recorded(monkeypatch, spark, module, name):
    cut, seen = module.cut_lineage, []
    monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append((df.columns, spark.conf.get(name, None))) or cut(df))
    return seen


def test_rules_read_shuffles_in_small_parts(spark, monkeypatch):
    before = spark.conf.get(ADVISORY, None)
    seen = _recorded(monkeypatch, spark, quality, ADVISORY)
    found = catalog_quality.v1_v25_violations(spark, SF)
    assert seen and all(v == lineage.PART_SIZE for _, v in seen)
    assert seen[-1][0] == found.columns == ["sid", "rule", "severity", "n"]  # what is returned is written under it as well
    assert spark.conf.get(ADVISORY, None) == before


def test_files_are_read_in_small_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4_000_000).selectExpr("xxhash64(id) AS h").repartition(8).write.parquet(path)  # 32 MB, whose even share is 8 MB
    spark.range(4_000_000).selectExpr("xxhash64(-id) AS h").repartition(8).write.mode("append").parquet(path)
    whole = spark.read.parquet(path).rdd.getNumPartitions()
    with lineage.small_parts(spark):
        assert spark.read.parquet(path).rdd.getNumPartitions() > whole


def test_python_gets_one_pair_of_donor_and_target_blocks_at_a_time(spark, monkeypatch):
    seen = _recorded(monkeypatch, spark, splice, lineage.BATCH)
    assert catalog_splice.x5_choose_donors(spark, SF).count() >= 0
    assert [v for c, v in seen if "n_rejected" in c] == ["1"]
    assert [v for c, v in seen if c == ["sid", "idx", "root"]] == [str(splice.BLOCKS)]
