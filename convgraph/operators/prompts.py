"""Context and prompt text of a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convgraph.functions.text import assemble_prompt


def assemble(selected: DataFrame, queries: DataFrame, key: str, order: str, body: str, prefix: DataFrame | None = None) -> DataFrame:
    """Selected turns in chronological order, then the query: (key, context, prompt).

    The prompt is one value by definition; everything that only counts or
    compares turns works on the long form instead.
    """
    texts = selected.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, body))), lambda x: x[body]), "").alias("_c"))
    d = queries.join(texts, key, "left")
    context = F.coalesce("_c", F.lit(""))
    if prefix is not None:
        d = d.join(prefix.select(key, "prefix"), key, "left")
        context = F.concat(F.coalesce("prefix", F.lit("")), context)
    return d.select(key, context.alias("context"), assemble_prompt(context, F.col("query")).alias("prompt"))
