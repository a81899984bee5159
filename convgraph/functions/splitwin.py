"""Windows over keys that may be arbitrarily large.

A plain window sends every row of a key to one task.  The helpers here cut each
key into ordered splits (a coarse, monotone prefix of the sort order such as the
day of a timestamp), run the window inside ``(key, split)`` and add the totals
of the earlier splits.  The totals are one small row per ``(key, split)``, built
with map-side combining, so a hot key is spread over its splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _split_totals(df: DataFrame, key: Sequence[str], total: Column) -> DataFrame:
    before = Window.partitionBy(*key).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*key, "_split")
        .agg(total.alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_total").over(Window.partitionBy(*key)))
        .drop("_total")
    )


def _attach(df: DataFrame, totals: DataFrame, key: Sequence[str]) -> DataFrame:
    # plain equality, so that the join finds the rows where the window left them;
    # a row without a key or split keeps its place in the result, without a position
    return df.join(totals.select(*key, "_split", "_before", "_all"), [*key, "_split"], "left")


def split_row_number(
    df: DataFrame,
    key: Sequence[str],
    split: Column,
    order: Sequence[Column],
    out: str = "pos",
    count_out: str | None = None,
) -> DataFrame:
    """1-based row number of each row within ``key``; ``split`` must follow ``order``."""
    d = df.withColumn("_split", split)
    totals = _split_totals(d, key, F.count(F.lit(1)))
    local = F.row_number().over(Window.partitionBy(*key, "_split").orderBy(*order)).cast("bigint")
    res = _attach(d.withColumn("_local", local), totals, key)
    res = res.withColumn(out, F.col("_local") + F.col("_before"))
    if count_out:
        res = res.withColumn(count_out, F.col("_all"))
    return res.drop("_split", "_local", "_before", "_all")


def split_cumsum(
    df: DataFrame,
    key: Sequence[str],
    split: Column,
    order: Sequence[Column],
    value: Column,
    out: str = "cum",
) -> DataFrame:
    """Running sum of ``value`` within ``key`` up to and including the row."""
    d = df.withColumn("_split", split).withColumn("_v", value)
    totals = _split_totals(d, key, F.sum("_v"))
    w = Window.partitionBy(*key, "_split").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    res = _attach(d.withColumn("_local", F.sum("_v").over(w)), totals, key)
    return res.withColumn(out, F.col("_local") + F.col("_before")).drop(
        "_split", "_v", "_local", "_before", "_all")


def split_percentile(
    df: DataFrame,
    key: Sequence[str],
    value: str,
    points: dict[str, float],
    split: Column,
) -> DataFrame:
    """Exact interpolated percentiles of ``value`` per key, NULLs skipped.

    Needs no per-key buffer of values: it ranks within splits and keeps the two
    rows around each percentile.
    """
    ranked = split_row_number(df.where(F.col(value).isNotNull()).select(*key, value),
                              key, split, [F.col(value)], "_rn", "_n")
    aggs = [F.max("_n").alias("n_values")]
    for name, p in points.items():
        at = (F.col("_n") - 1) * F.lit(float(p)) + 1
        lo = F.max(F.when(F.col("_rn") == F.floor(at), F.col(value)))
        hi = F.max(F.when(F.col("_rn") == F.ceil(at), F.col(value)))
        frac = F.max(at - F.floor(at))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return ranked.groupBy(*key).agg(*aggs)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salt: Column,
    how: str = "inner",
    n_salts: int = 16,
) -> DataFrame:
    """Equi-join in which one key of ``big`` may hold a large share of the rows.

    ``small`` (few rows per key) is repeated once per salt value; ``salt`` is a
    well spread integer column of ``big``.
    """
    b = big.withColumn("_salt", F.pmod(salt, F.lit(n_salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
    return b.join(s, [*on, "_salt"], how).drop("_salt")
