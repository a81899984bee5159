"""Mixing sources to target weights by entropy balancing.

The mix that departs least, in relative entropy per word, from the corpus as it is and still gives every source its
target number of words has document rates exp(lambda of the source), held to at most ``cap``.  The lambdas solve a
smooth convex dual whose gradient is (words of a source at its rates - target); Spark sums the words of each source over
all documents and runs the Newton iterations of all sources in parallel.  Rates are then rounded into whole copies.

Scale: documents are read once; every later table has one row per (source, size) class or per source.  Rounding walks
the distinct sizes of one source, which are bounded by its longest document, not by its number of documents.  Which
documents of a class get one more copy is decided by rank inside the class, cut into splits, so neither a source nor a
group of copies has to fit one task.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 take 0
words; an empty table gives an empty mix; repeated rows are separate documents; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage
from convgraph.functions.splitwin import split_row_number
from convgraph.llm.common import WORD, rank_in_class


def capped_targets(sources: DataFrame, total: int, cap: float) -> DataFrame:
    """Add ``target``: ``total`` shared by ``weight``, none above cap * source_size; excess is shared again by weight."""
    full = F.col("source_size") * F.lit(float(cap))
    theta = 0.0
    while True:
        # scalars of one pass: what the sources above their limit hold, and the weight of the others
        held, free = sources.agg(F.sum(F.when(F.col("weight") * theta > full, full)),
                                 F.sum(F.when(F.col("weight") * theta > full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - (held or 0.0)) / free if free else theta
        if not free or new <= theta:
            break
        theta = new
    return sources.withColumn("target", F.least(F.col("weight") * theta, full))


def newton_rates(targets: DataFrame, cap: float, max_steps: int = 200) -> DataFrame:
    """Solve the dual; adds ``rate`` so that source_size * rate = target, rates at most ``cap``.

    A source's gradient is source_size * exp(lambda) - target and its second derivative source_size * exp(lambda): the
    constraints do not overlap, so each row runs its own Newton iteration, all rows in parallel.  A step is held to one
    unit, so it cannot overshoot; targets a thousand times below a source still settle within the steps given.
    """
    def step(lam: Column, _: Column) -> Column:
        words = F.col("source_size") * F.exp(lam)
        return lam - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (words - F.col("target")) / words))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(max_steps)), F.lit(0.0), step)
    rate = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.least(F.exp(solved), F.lit(float(cap)))).otherwise(0.0)
    return targets.withColumn("rate", rate)


def _round_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the size classes of one source: ``base`` each, one more for ``extra`` documents of the class.

    Largest sizes first, each class takes what brings the running sum nearest to the running rate, so the error left at
    the end is about half of the smallest size.
    """
    pdf = pdf.sort_values("size", ascending=False)
    base = [math.floor(r + 1e-9) for r in pdf["rate"]]
    want = got = 0.0
    extra = []
    for z, n, r, k in zip(pdf["size"], pdf["n"], pdf["rate"], base):
        want += n * z * max(0.0, r - k)
        m = int(min(n, max(0, round((want - got) / z)))) if z and r > k + 1e-9 else 0
        got += m * z
        extra.append(m)
    return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "base": base, "extra": extra})


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, total_share: float = 1.0, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, size, source_size, target, rate, copies, taken) and the columns of ``carry``.

    Sources in order of their names take the ``weights`` in turn and share ``total_share`` of all words.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("~"))
    d = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), skey.alias("skey"), *carry)
    if not carry:
        d = cut_lineage(d)  # texts are read once
    classes = cut_lineage(d.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")))
    src = classes.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    first = F.when(F.col("skey") == "~", F.lit(0x110000)).otherwise(F.ascii(F.substring("skey", 2, 1)))
    src = split_row_number(src.withColumn("_all_sources", F.lit(0)), ["_all_sources"], first, [(F.col("skey") == "~").asc(), F.col("skey")], "at")
    w = F.array(*[F.lit(float(x)) for x in weights])
    src = cut_lineage(src.select("skey", "source_size", F.get(w, F.pmod(F.col("at") - 1, F.lit(len(weights))).cast("int")).alias("weight")))
    total, rows = src.agg(F.sum("source_size")).first()[0] or 0, classes.agg(F.sum("n")).first()[0] or 0
    rates = cut_lineage(newton_rates(capped_targets(src, total * total_share, cap), cap))
    rounded = classes.join(rates, "skey").groupBy("skey").applyInPandas(_round_source, "skey string, size bigint, base bigint, extra bigint")
    per_class = cut_lineage(rounded.join(rates.select("skey", "source_size", "target", "rate"), "skey"))
    ranked = rank_in_class(d, ["skey", "size"], F.xxhash64("doc_id", "skey", "size"), rows, ties=[F.col("doc_id")], classes=per_class)
    copies = F.col("base") + (F.col("rank") < F.col("extra")).cast("bigint")
    return ranked.select("doc_id", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)


def repeat_documents(docs: DataFrame, mixed: str = "copies") -> DataFrame:
    """Each row as often as its number of copies says."""
    return docs.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col(mixed).cast("int")))).drop("_copy")
