"""Running spend of a call log as a Structured Streaming job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convgraph.operators.spend import price_calls
from convgraph.streaming.ingest import work_dir


def spend_stream(calls: DataFrame, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Totals per scope, model and purpose; calls without a price are left out."""
    d = price_calls(calls, prices).where("usd is not null").withColumn("purpose", F.coalesce("purpose", F.lit("?")))
    return d.groupBy("scope", "model", "purpose").agg(
        F.sum("usd").alias("usd"), F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))


def with_status(totals: DataFrame, warn: float, limit: float) -> DataFrame:
    """Limits hold for all that a scope has spent, so each of its rows has the status of the scope's total."""
    spent = F.sum("usd").over(Window.partitionBy("scope"))
    return totals.withColumn("status", F.when(spent >= limit, "stop").when(spent >= warn, "warn").otherwise("ok"))


def run_spend(calls: DataFrame, prices: Mapping[str, tuple[float, float]], warn: float, limit: float,
              path: str | None = None) -> DataFrame:
    """Run what is available; each batch writes the whole small table of totals with its status."""
    spark = calls.sparkSession
    out = path or work_dir(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        with_status(batch, warn, limit).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    q = (spend_stream(calls, prices).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/data")
    last = rows.agg(F.max("batch").alias("_b"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("_b")).drop("batch", "_b")
