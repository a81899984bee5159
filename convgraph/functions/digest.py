"""Digests of long ordered texts, made without bringing a text into one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convgraph.functions.splitwin import split_row_number

#: Rows of one step of a digest (fixed: it is part of the digest's definition).
RUN = 256


def ordered_digest(rows: DataFrame, key: Sequence[str], order: str, text: str, out: str = "digest") -> DataFrame:
    """One SHA-256 per key over the texts in ``order``, which must be unique in the key: (*key, out, n).

    Every text is hashed where it lies.  The hashes of RUN consecutive rows make a hash, the hashes of runs in order make
    the key's.  A change of any text, its place or the number of texts changes the digest; a null text differs from an
    empty one.
    """
    hashed = F.coalesce(F.sha2(F.col(text), 256), F.lit("-"))
    d = split_row_number(rows.select(*key, F.col(order).alias("_o"), hashed.alias("_d")), key, F.floor(F.col("_o") / RUN), [F.col("_o")], "_pos")
    runs = d.groupBy(*key, F.floor((F.col("_pos") - 1) / RUN).alias("_run")).agg(
        F.sha2(_in_order("_pos", "_d"), 256).alias("_d"), F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*key).agg(F.sha2(_in_order("_run", "_d"), 256).alias(out), F.sum("_n").alias("n"))


def _in_order(place: str, value: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, value))), lambda x: x[value]), "")


def digest_sql(rows: str, key: str, order: str, text: str) -> str:
    """The same as a query over ``rows``, for engines with ``sha256`` and ``string_agg``."""
    return f"""SELECT {key}, sha256(string_agg(d, '' ORDER BY run)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT {key}, run, sha256(string_agg(d, '' ORDER BY pos)) AS d, count(*) AS n FROM (
        SELECT {key}, pos, (pos - 1) // {RUN} AS run, d FROM (
          SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS pos, coalesce(sha256({text}), '-') AS d FROM {rows}) a) b
      GROUP BY {key}, run) c GROUP BY {key}"""
