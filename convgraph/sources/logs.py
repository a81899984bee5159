"""Append-only JSON-lines logs of answers, verdicts and calls."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: str | StructType, on_bad: str = "drop") -> DataFrame:
    """Records of a log; an absent log is empty.

    ``on_bad``: ``drop`` skips lines that are not whole records, ``fail`` makes the
    query fail on them, ``tail`` skips one at the end of a file, which a writer may
    just be writing, and raises if there is one before it.
    """
    modes = {"drop": "DROPMALFORMED", "fail": "FAILFAST", "tail": "DROPMALFORMED"}
    if on_bad not in modes:
        raise ValueError(f"on_bad must be one of {sorted(modes)}")
    try:
        if on_bad == "tail":
            broken = broken_lines(spark, path, schema).where("n_broken > n_tail").orderBy("file").limit(5).collect()
            if broken:
                raise ValueError("lines that are no whole records before the end of " + ", ".join(r.file for r in broken))
        df = spark.read.schema(schema).option("mode", modes[on_bad]).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)
    return df


def broken_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """(file, n_lines, n_broken, n_tail) per file of a log: lines that are no whole records, and whether the last one is.

    The place of a line is its split's offset and its place in the split, so files of any size are read in parallel.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at"))
    bad = F.coalesce(F.from_json("value", full, {"mode": "PERMISSIVE"})["_corrupt_record"].isNotNull(), F.lit(False)).cast("bigint")
    d = d.where(F.trim("value") != "").withColumn("_bad", bad)
    return d.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("_bad").alias("n_broken"), F.max_by("_bad", F.struct("_from", "_at")).alias("n_tail"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN scores become NULL, so that means skip them."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in doubles}) if doubles else df


def epoch_to_timestamp(df: DataFrame, col: str = "ts") -> DataFrame:
    return df.withColumn(col, F.timestamp_seconds(col))


def keys_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The ``keys`` array of a sample file as rows."""
    doc = spark.read.schema("keys array<string>").option("multiLine", True).json(path)
    return doc.select(F.explode("keys").alias("key"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table written as CSV with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_pivot(spark: SparkSession, path: str, index: str, heads: tuple[str, ...], value: str) -> DataFrame:
    """A pivot table with one header row per entry of ``heads``, back in long form: (index, *heads, value), empty cells left out.

    Only the header rows, as wide as the table, come to the driver.
    """
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    raw = spark.read.option("nullValue", "").csv(path)
    names = raw.columns
    raw = raw.select("*", at.alias("_at"))
    top = raw.orderBy("_at").limit(len(heads)).collect()
    last = F.lit(None) if not top else F.struct(*[F.lit(x) for x in top[-1]["_at"]]).cast(raw.schema["_at"].dataType)
    cells = [F.struct(*[F.lit(row[c]).alias(h) for h, row in zip(heads, top)], F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(value)) for c in names[1:]]
    body = raw.where(F.col("_at") > last) if top else raw.limit(0)
    if not cells:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (index, *heads)] + [T.StructField(value, T.DoubleType())]))
    return body.select(F.col(names[0]).alias(index), F.inline(F.array(*cells))).where(F.col(value).isNotNull())
