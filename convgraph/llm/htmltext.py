"""Main text of web pages by wrappers: one union-free expression per host, inferred from the host's own pages.

Every page is read once into a folded token stream and its text blocks (``wrapper.read_page``).  The distinct streams of a
host are aligned one after the other (``wrapper.align``): what not all pages have becomes optional, what repeats becomes a
group, text becomes a slot.  Every slot of every stream is then placed in its host's wrapper, and the host's pages together
say which slots of the wrapper hold the article:

* slots inside an ``article`` or ``main`` element, where the host has them;
* else, of the slots that are not mostly links, those under the smallest element of the wrapper that holds nearly all of
  the text that changes from page to page, with headings beside it.  A text that stands in the same slot on more than half
  of the host's different pages is part of the template, not of an article.

Menus, headers outside an article, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
known by element, role or the words of their class and id; their text is left out wherever they stand.  An element marked
by such words in which an article stands is not left out.

Blocks are the texts between block elements and line breaks; character references are decoded, white space becomes one
space, blocks are joined by a line feed in page order.

Defined cases: null or empty html, or html without such text, gives an empty text; a null url or one without a host shares
the empty host with its like; a host of one page has that page as its wrapper; repeated pages give repeated rows and count
once where texts are compared; pages may be cut off anywhere and be of any length.  An empty table gives no rows.  Other
columns than page_id, url and html are not read.

Scale: pages are read in their own partitions and never shuffled by host.  What moves is one row per distinct stream of a
host (aligned in groups of ``FAN``, then group results likewise, so a host with a third of all pages is no single task),
small rows of hashes and counts, and the plan, one row per distinct stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from convgraph.functions.lineage import cut_lineage
from convgraph.llm import wrapper

FAN = 32  # streams aligned by one task
SHARE = 0.8  # of an element's changing text: a child with so much of it is entered
TEMPLATE = 0.5  # of a host's different pages: a text found on more of them is template

BLOCK = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("linked", T.IntegerType()),
                      T.StructField("article", T.BooleanType())])
READ = T.StructType([T.StructField("stream", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK))])


def host_of(url: Column) -> Column:
    """Host part of a url, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pandas_udf(READ)
def _read(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        streams, blocks = [], []
        for page in batch:
            nodes, found = wrapper.read_page(page or "")
            streams.append(json.dumps(nodes, separators=(",", ":")))
            blocks.append([{"slot": s, "text": t, "linked": k, "article": a} for s, t, k, a in found])
        yield pd.DataFrame({"stream": pd.Series(streams, dtype=object), "blocks": pd.Series(blocks, dtype=object)})


def _align(group: pd.DataFrame) -> pd.DataFrame:
    """One wrapper for the streams or wrappers of a group, aligned in a fixed order."""
    expressions = sorted(group["wrapper"])
    out = json.loads(expressions[0])
    for e in expressions[1:]:
        out = wrapper.align(out, json.loads(e))
    return pd.DataFrame({"host": pd.Series([group["host"].iloc[0]], dtype=object), "wrapper": pd.Series([json.dumps(out, separators=(",", ":"))], dtype=object)})


def infer_wrappers(streams: DataFrame) -> DataFrame:
    """(host, wrapper) from the distinct streams (host, stream) of each host."""
    w = streams.select("host", F.col("stream").alias("wrapper"))
    while True:
        sizes = w.groupBy("host").agg(F.count(F.lit(1)).alias("k"))
        if (sizes.agg(F.max("k")).first()[0] or 0) <= 1:
            return w
        cut = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("k") / FAN)).alias("cut")
        w = cut_lineage(w.join(sizes, "host").select("host", "wrapper", cut).groupBy("host", "cut").applyInPandas(_align, "host string, wrapper string"))


@pandas_udf(T.ArrayType(T.IntegerType()))
def _locate(wrappers: pd.Series, streams: pd.Series) -> pd.Series:
    return pd.Series([wrapper.locate(json.loads(w), json.loads(s)) for w, s in zip(wrappers, streams)], dtype=object)


def _container(nodes: list, mass: dict[int, int]) -> set[int]:
    """Slots under the smallest element with nearly all of the text ``mass`` of the slots."""
    level, base = nodes, 0
    while True:
        spans, at = [], base
        for n in level:
            size = 1 if n[0] == "#" else wrapper.slots(n[2])
            spans.append((n, at, at + size, sum(mass.get(s, 0) for s in range(at, at + size))))
            at += size
        whole = sum(m for *_, m in spans)
        beside = any(n[0].split(".")[0] == "h1" and m > 0 for n, _, _, m in spans)
        big = [x for x in spans if whole and x[3] >= SHARE * whole and x[0][0] not in ("#", "p") and x[0][1] in ("", "?")]
        if beside or not big:
            return {s for _, lo, hi, _ in spans for s in range(lo, hi) if mass.get(s, 0) > 0}
        level, base = big[0][0][2], big[0][1]


def _choose(group: pd.DataFrame) -> pd.DataFrame:
    """Per slot of a host's wrapper: whether it holds the article, on pages that have an article element and on others."""
    nodes = json.loads(group["wrapper"].iloc[0])
    open_ = group[~group["article"] & (group["linked"] * 2 <= group["chars"])]
    held = _container(nodes, dict(zip(open_["slot"].tolist(), open_["changing"].tolist())))
    return pd.DataFrame({"host": group["host"], "slot": group["slot"], "article": group["article"], "main": [s in held for s in group["slot"].tolist()]})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of all pages."""
    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), _read("html").alias("r"))
    read = cut_lineage(read.select("page_id", "url", "host", "r.stream", F.md5("r.stream").alias("sid"), "r.blocks"))
    streams = cut_lineage(read.groupBy("host", "sid").agg(F.first("stream").alias("stream")))
    wrappers = cut_lineage(infer_wrappers(streams))
    located = streams.join(wrappers, "host").select("host", "sid", F.posexplode(_locate("wrapper", "stream")).alias("at", "slot"))
    located = cut_lineage(located.where("slot >= 0"))

    # what the host's different pages say of each slot; equal pages count once
    texts = F.xxhash64(F.to_json("blocks"))
    seen = read.select("host", "sid", "blocks", texts.alias("same")).withColumn("b", F.explode("blocks"))
    seen = seen.select("host", "sid", "same", F.col("b.slot").alias("at"), F.xxhash64("b.text").alias("text"), F.length("b.text").alias("chars"), F.col("b.linked").alias("linked"),
                       F.col("b.article").alias("article"))
    in_article = seen.where("article").groupBy("host", "sid", "at").agg(F.count(F.lit(1)).alias("n"))
    in_article = in_article.join(located, ["host", "sid", "at"]).select("host", "slot").distinct().withColumn("article", F.lit(True))
    other = seen.where("not article").distinct().groupBy("host", "sid", "at", "text").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    other = other.join(located, ["host", "sid", "at"]).groupBy("host", "slot", "text").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    different = read.select("host", texts.alias("same")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("different"))
    other = cut_lineage(other.join(different, "host").withColumn("template", (F.col("different") > 2) & (F.col("pages") > TEMPLATE * F.col("different"))))
    template = other.where("template").groupBy("host", "slot").agg(F.collect_list("text").alias("template"))  # at most two texts a block of a mean page
    by_slot = other.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
                                                F.sum(F.when(~F.col("template"), F.col("chars")).otherwise(0)).alias("changing"))
    by_slot = by_slot.join(in_article, ["host", "slot"], "full").select(
        "host", "slot", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chars", "linked", "changing")], F.coalesce("article", F.lit(False)).alias("article"))
    chosen = by_slot.join(wrappers, "host").groupBy("host").applyInPandas(_choose, "host string, slot int, article boolean, main boolean")
    plan = located.join(chosen.join(template, ["host", "slot"], "left"), ["host", "slot"]).groupBy("host", "sid").agg(
        F.collect_list(F.when(F.col("article"), F.col("at"))).alias("article_slots"), F.collect_list(F.when(F.col("main"), F.col("at"))).alias("main_slots"),
        F.flatten(F.collect_list(F.when(F.col("main"), F.coalesce("template", F.array().cast("array<bigint>"))))).alias("template"))
    plan = cut_lineage(plan)

    def article_block(b: Column) -> Column:
        return F.array_contains("article_slots", b["slot"])

    def main_block(b: Column) -> Column:
        return F.array_contains("main_slots", b["slot"]) & ~F.array_contains("template", F.xxhash64(b["text"]))

    d = read.select("page_id", "url", "host", "sid", "blocks").join(plan, ["host", "sid"], "left")
    taken = F.when(F.exists("blocks", article_block), F.filter("blocks", article_block)).otherwise(F.filter("blocks", main_block))
    d = d.select("page_id", "url", F.coalesce(F.array_join(F.transform(taken, lambda b: b["text"]), "\n"), F.lit("")).alias("text"))
    return d.withColumn("n_chars", F.length("text").cast("bigint"))
