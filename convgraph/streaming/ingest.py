"""Keyed ingest of append-only logs as Structured Streaming jobs."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convgraph.functions.lineage import shared_dir


def work_dir(spark: SparkSession) -> str:
    """A new folder for a stream's output and state, in the shared checkpoint folder."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_log(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", glob: str | None = None,
             max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if glob is not None:
        r = r.option("pathGlobFilter", glob)
    if max_files is not None:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def dedupe_stream(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First arrival per key wins; keys are forgotten ``delay`` after their event time."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_to_files(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run what is available into a Parquet sink and read the result."""
    spark = stream.sparkSession
    out = path or work_dir(spark)
    q = (stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def first_by_key_stream(stream: DataFrame, key: str, order: list[str], path: str | None = None) -> DataFrame:
    """Earliest record per key in ``order``, kept as streaming aggregation state.

    Unlike ``dedupe_stream`` it does not depend on arrival order.  Each batch
    writes its changed keys; the last version of a key is its result.
    """
    spark = stream.sparkSession
    out = path or work_dir(spark)
    rest = [c for c in stream.columns if c != key]
    best = stream.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(key, "_r.*").withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/data/batch={batch_id}")

    q = (best.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/data").drop("batch")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
    return last.select(key, "_r.*")


class Ingested(NamedTuple):
    """``rows``: first records; ``late``: rows dropped behind the watermark; ``state``: rows kept after each batch."""

    rows: DataFrame
    late: int
    state: list[int]


def first_record_stream(stream: DataFrame, key: str, ts: str, order: list[str], delay: str, horizon: str, path: str | None = None) -> Ingested:
    """Earliest record per key by event time, emitted once per ``horizon`` of event time, with the state freed after it.

    Records may come up to ``delay`` out of order; later ones are dropped and counted.  A key's record is kept as state
    until the watermark has passed its span of ``horizon``; then it is written and forgotten, so the state holds the keys
    of the open spans only, however long the log is.  At the end of the log one clock row, written beside the output,
    moves the watermark past all spans.  The result takes the earliest span of each key.
    """
    spark = stream.sparkSession
    out = path or work_dir(spark)
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("_clock", F.lit(False))
    clock = f"{out}/clock"
    spark.createDataFrame([], rows.schema).write.parquet(clock)
    ticks = spark.readStream.schema(rows.schema).parquet(clock)
    rest = [c for c in rows.columns if c not in (key, "_clock")]
    first = rows.unionByName(ticks).withWatermark(ts, delay).groupBy(F.window(ts, horizon).alias("_span"), key, "_clock").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.max(ts).alias("_last"))
    late, state = 0, []

    def run() -> None:
        nonlocal late
        q = (first.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        for p in q.recentProgress:
            for op in p["stateOperators"]:
                late += op["numRowsDroppedByWatermark"]
                state.append(op["numRowsTotal"])

    run()
    # an event time beyond any span that is still open
    tick = spark.range(1).select(*[(F.current_timestamp() + F.expr("INTERVAL 1000 YEARS") if c == ts else F.lit(c == "_clock") if c == "_clock"
                                    else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    tick.write.mode("append").parquet(clock)
    run()
    done = spark.read.schema(first.schema).parquet(f"{out}/data").where("not _clock")
    found = done.groupBy(key).agg(F.min_by("_r", "_span.start").alias("_r"))
    return Ingested(found.select(key, "_r.*"), late, state)
