"""Reliable cuts of long plans."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local one is used if driver and executors are one process, as in tests; on a cluster, where
    machines do not share local folders, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = current.get() if current.isDefined() else "/tmp/convgraph-checkpoints"
    return named.rstrip("/")


# Spark's setting that removes the shuffle files of a finished query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Parts of a shuffle before small ones are put together, and what is put together at most.
PARTS, PART_SIZE = 512, "8m"
# Spark's setting of how many rows Python gets at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting ``name`` is ``value`` for what runs inside, and then again what it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def small_parts(spark: SparkSession) -> Iterator[None]:
    """Shuffles and files of what runs inside are read some MB at a time, however large the input is.

    For steps that sort and join narrow rows: these shrink so far in a shuffle or a file that a part of Spark's usual size is more than
    one task can hold.  Small inputs are still read in as few parts as there are cores.
    """
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with setting(spark, "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts)), \
            setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", PART_SIZE), \
            setting(spark, "spark.sql.files.maxPartitionBytes", PART_SIZE):
        yield


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result feeds several later steps: they read it instead of
    computing it again, with its true size known to the planner and only the
    columns they need; losing an executor does not lose it.  Once it is written,
    the shuffle files that led to it are of no more use and are removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut_lineage`` that no plan reads any more; what was made from them must have been written."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("cut-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
