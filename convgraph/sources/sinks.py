"""Sinks of result tables and small text readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON document in the column ``value``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    as_json(df).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header; ``single_file`` only for small result tables."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).csv(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def matching_lines(text: Column, pattern: str) -> Column:
    """Number of lines of a text that contain ``pattern``."""
    return F.regexp_count(text, F.lit(f"(?m)^.*{pattern}.*$"))


def write_pivot(long: DataFrame, index: str, heads: tuple[str, ...], value: str, path: str, mode: str = "overwrite") -> None:
    """``long(index, *heads, value)`` as a CSV pivot with one header row per entry of ``heads``: a result table in one file.

    The combinations of heads, as many as the table has columns, come to the driver.
    """
    columns = sorted(tuple(r) for r in long.select(*heads).distinct().collect())
    cells = [F.max(F.when(F.lit(True) if not heads else F.expr(" AND ".join(f"`{h}` <=> '{x}'" for h, x in zip(heads, c))), F.col(value))).cast("string").alias(f"c{k}")
             for k, c in enumerate(columns)]
    body = long.groupBy(F.col(index).cast("string").alias("_i")).agg(*cells) if cells else long.select(F.col(index).cast("string").alias("_i")).distinct()
    rows = body.withColumn("_row", F.lit(len(heads)))
    names = ["_row", "_i", *[f"c{k}" for k in range(len(columns))]]
    head = long.sparkSession.createDataFrame([(k, h, *[str(c[k]) for c in columns]) for k, h in enumerate(heads)], ", ".join(["_row int", *[f"{n} string" for n in names[1:]]]))
    out = head.unionByName(rows.select(*names)).orderBy("_row", "_i").drop("_row")
    out.coalesce(1).write.mode(mode).option("emptyValue", "").option("nullValue", "").csv(path)
