"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage

#: Words are runs without ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def id_remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null ids give null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod))


IDS = 100_000  # ids up to which a list of them is sent to every executor; of more, a bit each is sent
BLOCK_BITS, BLOCKS = 15, 1 << 14  # ids of a block, which Spark's bitmaps fix, and blocks that are sent at most (64 MB)


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``, a written table of distinct ids.

    Wide rows stay where they are: a short list is broadcast, of a longer one a bit for each id of the blocks that it
    touches.  Only ids so scattered that these are too many are joined by a shuffle.
    """
    if ids.count() <= IDS:
        return df.join(F.broadcast(ids), key, "left_semi")
    block, place = F.shiftright(key, BLOCK_BITS), F.pmod(F.col(key), F.lit(1 << BLOCK_BITS))
    if ids.select(block).distinct().count() > BLOCKS:
        return df.join(ids, key, "left_semi")
    bits = ids.select(block.alias("_block"), place.alias("_place")).repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    octet = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    met = df.withColumn("_block", block).join(F.broadcast(cut_lineage(bits)), "_block")
    return met.where(F.call_function("getbit", octet, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*df.columns)


def numbered(df: DataFrame, row: Column, out: str = "rid") -> DataFrame:
    """Columns ``row`` and ``out``, a bigint of each row's own that is the same whenever the result is read again.

    Parquet files are read as they lie, the number being a row's place in its file behind the file's place among those
    read; anything else is written first.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or not plan.relation().getClass().getSimpleName() == "HadoopFsRelation" or plan.relation().fileFormat().toString() != "Parquet":
        return cut_lineage(df.select(row).withColumn(out, F.monotonically_increasing_id()))
    of = df.metadataColumn("_metadata")
    files = df.select(of.getField("file_path").alias("_file"), F.monotonically_increasing_id().alias("_first")).groupBy("_file").agg(F.min("_first").alias("_first")).collect()  # a row for each file
    places = [(r["_file"], k) for k, r in enumerate(sorted(files, key=lambda r: r["_first"]))]
    known = df.sparkSession.createDataFrame(places, "_file string, _place bigint")
    d = df.select(row, of.getField("file_path").alias("_file"), of.getField("row_index").alias("_at")).join(F.broadcast(known), "_file")
    return d.select(*df.select(row).columns, (F.shiftleft("_place", 33) + F.col("_at")).alias(out))


def split_bits(rows: int, per_split: int = 1000) -> int:
    """Bits of a hash that cut ``rows`` rows into splits of about ``per_split``."""
    return max(1, math.ceil(math.log2(max(2, rows / per_split))))


def rank_in_class(df: DataFrame, keys: Sequence[str], hash_: Column, rows: int, *, ties: Sequence[Column] = (),
                  classes: DataFrame | None = None, out: str = "rank") -> DataFrame:
    """0-based position of each row in its class, in the order of ``hash_`` and then ``ties``.

    A class may hold most of the rows: it is cut by the leading bits of the hash, whose number follows ``rows``; the
    sizes of a class's earlier splits, one small row per split, are added.  ``keys`` must hold no null.  Columns of
    ``classes`` (one row per class) are attached through those small rows, so no large join has a class as its key.
    """
    bits = split_bits(rows)
    d = df.withColumn("_h", hash_).withColumn("_split", F.shiftright("_h", 64 - bits))
    earlier = Window.partitionBy(*keys).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "_split").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if classes is not None:
        counts = counts.join(classes, list(keys), "left")
    local = F.row_number().over(Window.partitionBy(*keys, "_split").orderBy("_h", *ties)).cast("bigint") - 1
    d = d.withColumn("_local", local).join(counts, [*keys, "_split"], "left")
    return d.withColumn(out, F.col("_local") + F.col("_before")).drop("_h", "_split", "_local", "_before")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest node reachable.

    Labels move to the smallest label of a neighbour, and each label jumps to its label's label, so a path of n nodes
    needs about log2(n) rounds.  Every round is joins and aggregates with map-side combining, written to the shared
    folder; only the number of changed labels comes to the driver.  Nodes without an edge do not appear.  Loops and
    repeated edges are allowed, null ends are ignored, no edge gives no row.
    """
    e = edges.select("a", "b").where("a <> b")
    e = cut_lineage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = cut_lineage(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                      .select("node", F.least("node", "m").alias("f")))
    for _ in range(max_rounds):
        up = lab.select(F.col("node").alias("f"), F.col("f").alias("g"))
        two = lab.join(up, "f")  # node, its label f, the label's label g
        near = e.join(two.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("m"))
        both = two.join(near, "node").select("node", "f", F.least("g", "m").alias("m"))
        cand = both.select("node", "m").unionByName(both.select(F.col("f").alias("node"), "m"))
        new = cand.groupBy("node").agg(F.min("m").alias("m")).join(lab, "node")
        new = cut_lineage(new.select("node", F.least("f", "m").alias("f"), (F.col("m") < F.col("f")).alias("moved")))
        moved = new.where("moved").count()
        lab = new.select("node", "f")
        if not moved:
            return lab.select("node", F.col("f").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
