"""Merkle manifest of a dataset: stored hash levels, and proofs climbed by a recursive query.

``build`` turns every row into a leaf digest, orders the leaves of each part and hashes runs of ``arity`` consecutive
nodes until one node per part is left (its subroot); the subroots, in order of the parts, are hashed likewise to the root.
Each level is written as a table.  ``node_rows`` reads the levels as one table of nodes, each linked to its parent and
holding the digests beside it.  ``climb`` is a recursive Spark query over that table: it starts at every run of leaves
with the digests to be tested, and each step joins the parent's row, appends the siblings and folds.  The leaves of a run
share all siblings above them, so they travel as one row: the rows of a step are 1/arity of the leaves, and each leaf
keeps its own folded digest in them.

A digest is SHA-256; digests enter another digest as lower-case hexadecimal text.  A column value enters as ``-`` if it is
null, else as its UTF-8 byte count, a colon and the value.

Defined cases: a null part is a part of its own, before all others (so is the empty string, after it).  Rows without an
order value come first in their part, rows with equal order values are ordered by their leaf digests, and repeated rows
are leaves of their own.  A part of one leaf has that leaf as its subroot, a dataset of one part that subroot as its root.
An empty table gives no rows.  Whole texts are hashed however long they are.  Only the named columns are read, so other
columns may have any name.

Scale: texts are read once and never shuffled; leaves are ordered by a range partitioning over (part, order, digest), which
splits a part of any size; every later level has 1/arity of the rows.  Only the number of rows of the largest part comes
to the driver, which sets the number of levels.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage

TOP = -1  # part number of the tree over the subroots
KEY = ["part", "level", "pos"]


@dataclasses.dataclass(frozen=True)
class Manifest:
    """Written tables of runs: (part, pos, members, digest, n), n the number of runs of that part and level.

    ``leaves`` are the runs of leaves, ``levels`` the runs of the nodes above them, ``top`` the runs of the tree over the
    subroots (part, digest), ``root`` one row.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: DataFrame


def canonical(columns: Sequence[Column]) -> Column:
    """The text of a row that its leaf hashes."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _hex_all(digests: Column) -> Column:
    return F.array_join(F.transform(digests, as_hex), "")


def _beside(digests: Column, i: Column) -> tuple[Column, Column]:
    """The digests before and after place ``i`` (from 0) of a run, in one binary each."""
    return F.unhex(_hex_all(F.slice(digests, F.lit(1), i))), F.unhex(_hex_all(F.slice(digests, i + 2, F.size(digests))))


def _places(df: DataFrame, key: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` sorted over ranges of (key, order), with ``_at`` rising in that sort; per (key, _range) what to add to
    ``_at`` for the 0-based place within the key, and the key's number of rows."""
    ranged = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    d = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    ranges = d.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_range")
    earlier = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d, ranges.select(key, "_range", (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(key)).alias("m"))


def _runs(nodes: DataFrame, arity: int, carry: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive nodes (part, pos, digest, m nodes in the part); a part's only node stands for itself."""
    d = nodes.groupBy("part", F.expr(f"pos div {arity}").alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", *carry))).alias("members"), F.first("m").alias("m"))
    hashed = digest(_hex_all(F.col("members.digest")))
    return cut_lineage(d.select("part", "pos", "members", F.when(F.col("m") == 1, F.col("members.digest")[0]).otherwise(hashed).alias("digest"),
                                F.ceil(F.col("m") / arity).cast("bigint").alias("n"), "m"))


def _levels(first: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``first`` until one node a part is left, and those nodes (part, digest)."""
    above, last, lv = [], first.where("n = 1").select("part", "digest"), first
    most = first.agg(F.max("n")).first()[0] or 0
    while most > 1:
        lv = _runs(lv.where("n > 1").select("part", "pos", "digest", F.col("n").alias("m")), arity)
        above.append(lv)
        last = last.unionByName(lv.where("n = 1").select("part", "digest"))
        most = -(-most // arity)
    return above, cut_lineage(last)


def build(leaves: DataFrame, part: str, order: str, arity: int = 8, carry: Sequence[str] = ()) -> Manifest:
    """The levels over ``leaves``: a part column, an order column, ``leaf`` (binary) and carried columns."""
    tag = F.coalesce(F.concat(F.lit("+"), F.col(part).cast("string")), F.lit(""))  # a text in whose byte order null is first
    d = leaves.select(tag.alias("_tag"), F.col(order).alias("_order"), "leaf", *carry)
    d, ranges = _places(d, "_tag", [F.col("_order").asc_nulls_first(), F.col("leaf")])
    t, tag_ranges = _places(ranges.select("_tag").distinct().withColumn("_one", F.lit(0)), "_one", [F.col("_tag")])
    numbers = t.join(tag_ranges, ["_one", "_range"]).select("_tag", (F.col("_at") + F.col("_shift")).alias("part"), F.col("m").alias("parts"))
    numbers = cut_lineage(numbers)
    # one join gives the part's number, its size and the place in it; its key is spread over the ranges
    d = d.join(ranges.join(numbers, "_tag"), ["_tag", "_range"])
    runs = _runs(d.select("part", (F.col("_at") + F.col("_shift")).alias("pos"), F.col("leaf").alias("digest"), "m", *carry), arity, carry)
    levels, subroots = _levels(runs, arity)
    over = subroots.join(numbers.select("part", F.col("parts").alias("m")), "part")
    top = _runs(over.select(F.lit(TOP).cast("bigint").alias("part"), F.col("part").alias("pos"), "digest", "m"), arity)
    above, root = _levels(top, arity)
    return Manifest(runs, levels, subroots, [top, *above], root.select(F.col("digest").alias("root")))


def _parent(level: int, top: bool) -> list[Column]:
    """Key of the node that a run becomes: the last node of a part is a leaf of the tree over the subroots."""
    last = F.lit(not top) & (F.col("n") == 1)
    part, pos = F.col("part"), F.col("run")
    return [F.when(last, F.lit(TOP).cast("bigint")).otherwise(part).alias("p_part"),
            F.when(last, F.lit(0)).otherwise(F.lit(level + 1)).alias("p_level"), F.when(last, part).otherwise(pos).alias("p_pos")]


def node_rows(m: Manifest) -> DataFrame:
    """All nodes between leaves and root: key, the digests beside them in their run, key of their parent.

    The root has no row, and neither has a subroot that is the root.
    """
    tables = []
    for top, levels, first in ((False, m.levels, 1), (True, m.top, 0)):
        for k, lv in enumerate(levels):
            d = lv.where("m > 1").withColumnRenamed("pos", "run").withColumn("ds", F.col("members.digest"))
            d = d.select("part", "run", "n", "ds", F.posexplode("members.pos").alias("i", "pos"))
            before, after = _beside(F.col("ds"), F.col("i"))
            tables.append(d.select("part", F.lit(first + k).alias("level"), "pos", before.alias("before"), after.alias("after"), *_parent(first + k, top)))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


CLIMB = """
WITH RECURSIVE climb(part, run, p_part, p_level, p_pos, folded, siblings) MAX RECURSION LEVEL 200 AS (
  SELECT part, run, p_part, p_level, p_pos, folded, siblings FROM {start}
  UNION ALL
  SELECT c.part, c.run, n.p_part, n.p_level, n.p_pos,
         transform(c.folded, d -> unhex(sha2(concat(lower(hex(n.before)), lower(hex(d)), lower(hex(n.after))), 256))),
         concat(c.siblings, n.before, n.after)
  FROM climb c JOIN {nodes} n ON n.part = c.p_part AND n.level = c.p_level AND n.pos = c.p_pos
)
SELECT part, run, folded, siblings FROM climb WHERE p_part = {top} AND p_level = {height}
"""


def climb(m: Manifest, tested: str) -> DataFrame:
    """Per run of leaves (part, run): the digests of ``tested``, a carried binary column, folded up to the root, and the
    siblings above the run in one binary, upwards."""
    spark: SparkSession = m.leaves.sparkSession
    nodes = cut_lineage(node_rows(m))
    d = m.leaves.withColumnRenamed("pos", "run").select("part", "run", "n", "m", F.col("members.digest").alias("ds"), F.col(f"members.{tested}").alias("ts"))

    def fold(t: Column, i: Column) -> Column:
        whole = F.concat(_hex_all(F.slice("ds", F.lit(1), i)), as_hex(t), _hex_all(F.slice(F.col("ds"), i + 2, F.size("ds"))))
        return F.when(F.col("m") == 1, t).otherwise(digest(whole))

    start = d.select("part", "run", *_parent(0, False), F.transform("ts", fold).alias("folded"), F.unhex(F.lit("")).alias("siblings"))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # a run of leaves is a row of every step
    try:
        # where one part's subroot is the root, the climb ends at the first level of the tree over the subroots
        height = len(m.top) if m.subroots.limit(2).count() > 1 else 0
        return cut_lineage(spark.sql(CLIMB, start=start, nodes=nodes, top=TOP, height=height))
    finally:
        spark.conf.set(limit, before)


def prove(m: Manifest, tested: str, carry: Sequence[str]) -> DataFrame:
    """One row per leaf: the carried columns, leaf, subroot, root, siblings (binary, upwards) and the folded root."""
    up = climb(m, tested)
    d = m.leaves.withColumnRenamed("pos", "run").join(up, ["part", "run"]).join(m.subroots.withColumnRenamed("digest", "subroot"), "part")
    root = F.broadcast(m.root)  # one row
    d = d.select("subroot", "siblings", "folded", F.col("members.digest").alias("ds"), F.posexplode("members").alias("i", "leaf_row")).join(root)
    before, after = _beside(F.col("ds"), F.col("i"))
    return d.select(*[F.col(f"leaf_row.{c}").alias(c) for c in carry], F.col("leaf_row.digest").alias("leaf"), "subroot", "root",
                    F.concat(before, after, "siblings").alias("siblings"), F.element_at("folded", F.col("i") + 1).alias("folded_root"))


def tampered(text: Column, id_: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of the decimal id."""
    hit = F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 0
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def verify_documents(docs: DataFrame, arity: int = 8) -> DataFrame:
    """Per document: doc_id, digests of its leaf, its part and the whole, its proof, and the root folded from a tampered text."""
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    d = docs.select(*cols)
    changed = canonical([tampered(F.col(c), F.col("doc_id")) if c == "text" else F.col(c) for c in cols])
    leaves = cut_lineage(d.select("doc_id", "lang", digest(canonical([F.col(c) for c in cols])).alias("leaf"), digest(changed).alias("tested")))
    m = build(leaves, "lang", "doc_id", arity, carry=("doc_id", "tested"))
    p = prove(m, "tested", ("doc_id",))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))
