"""Register of runnable queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: CRC-32 in SQL: the table of the reversed polynomial 0xEDB88320, and a fold over the UTF-8 bytes of a text.
CRC_TABLE = ("crc_table(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), "
             "lambda c, s: xor(c >> 1, (c & 1) * 3988292384))))")


def crc32_sql(text: str) -> str:
    """CRC-32 of ``text`` where ``crc_table`` is joined."""
    digit = f"strpos('0123456789ABCDEF', hex(encode({text}))[2 * k + {{}}]) - 1"
    byte = f"lambda k: ({digit.format(1)}) * 16 + {digit.format(2)}"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({text})), 1), {byte})), "
            "lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)")


def big(c: str, alias: str | None = None):
    return F.col(c).cast("bigint").alias(alias or c)


def r6(c, alias: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6)
    return out.alias(alias or c) if isinstance(c, str) or alias else out


def r96(c: str):
    """Two steps, so that the last bits of a quantile do not decide a tie."""
    return F.round(F.round(c, 9), 6).alias(c)


def load_all() -> None:
    """Import every catalog module, which registers its queries."""
    import importlib

    for m in ("catalog_context", "catalog_candidates", "catalog_facts", "catalog_tables", "catalog_stats",
              "catalog_quality", "catalog_spend", "catalog_splice", "catalog_text"):
        importlib.import_module(f"convgraph.plans.{m}")
