"""Operators on conversation dependency graphs, in long form.

``turns(sid, idx, rev, ...)`` has one row per turn: ``idx`` counts from the first
turn, ``rev`` from the last, so ``rev = 0`` is the query.  ``edges(sid, child,
parent, pos)`` has one row per parent, ``pos = 0`` being the primary one; parents
always come before their children.  Results are long as well, so that no row
grows with the length of a conversation.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convgraph.functions.lineage import cut_lineage

# Conversations are cut into blocks of so many turns, which are folded in parallel.
BLOCK = 1024
# Blocks in which ancestors are sought are so many times as wide.
WIDER = 32
TURNS = T.ArrayType(T.LongType())


def query_turns(turns: DataFrame) -> DataFrame:
    return turns.where("rev = 0").select("sid", F.col("idx").alias("query_idx"))


def primary_parent(edges: DataFrame) -> DataFrame:
    return edges.where("pos = 0").select("sid", "child", "parent")


@F.pandas_udf(T.StructType([T.StructField(c, TURNS) for c in ("inside", "outside")]))
def _walk(child: pd.Series, parent: pd.Series, seeds: pd.Series) -> pd.DataFrame:
    """Turns of a block reached from ``seeds``, and turns before the block; edges latest child first, counted from its start."""
    inside, outside = [], []
    for c, p, s in zip(child, parent, seeds, strict=True):
        c, p, s = ([] if x is None else x for x in (c, p, s))
        hit = bytearray(1 + max([*s, c[0] if len(c) else 0]))
        for i in s:
            hit[i] = 1
        left = set()
        for i, up in zip(map(int, c), map(int, p), strict=True):
            if hit[i]:
                if up < 0:
                    left.add(up)
                else:
                    hit[up] = 1
        inside.append([i for i, x in enumerate(hit) if x])
        outside.append(list(left))
    return pd.DataFrame({"inside": inside, "outside": outside})


def _reach(starts: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """Turns reachable from ``starts(sid, node)`` through ``edges(sid, child, parent)``, the starts included: (sid, idx).

    A block of turns is a row with its edges, latest child first, and is walked once from the turns at which it is entered.
    Where edges lead from block to block, the blocks entered at new turns are walked, all in parallel, until no walk leaves
    a block for a turn not yet known; then every block is walked from all its entries.  Rounds are at most as many as the
    blocks of the longest conversation, and a conversation of one block takes none.
    """
    blk = lambda c: F.floor(F.col(c) / block).cast("bigint").alias("blk")
    here = lambda c: F.col(c) - F.floor(F.col(c) / block).cast("bigint") * block
    low = F.col("blk") * block
    e = edges.select("sid", blk("child"), here("child").alias("c"), (F.col("parent") - F.floor(F.col("child") / block).cast("bigint") * block).alias("p"))
    rows = e.groupBy("sid", "blk").agg(F.sort_array(F.collect_list(F.struct("c", "p")), asc=False).alias("_e"))
    rows = cut_lineage(rows.select("sid", "blk", F.col("_e.c").alias("_c"), F.col("_e.p").alias("_p"), (F.array_min("_e.p") < 0).alias("_leaves")))
    leaving = rows.where("_leaves").drop("_leaves")
    entries = lambda d: d.groupBy("sid", "blk").agg(F.collect_set(here("node")).alias("_s"))
    seen = starts.select("sid", "node", blk("node")).distinct()
    if not leaving.isEmpty():
        seen = new = cut_lineage(seen)
        while not new.isEmpty():
            entered = entries(seen.join(new.select("sid", "blk").distinct(), ["sid", "blk"], "left_semi"))
            left = entered.join(leaving.hint("merge"), ["sid", "blk"]).select("sid", "blk", F.explode(_walk("_c", "_p", "_s")["outside"]).alias("_o"))
            left = left.select("sid", (F.col("_o") + low).alias("node")).distinct()
            new = cut_lineage(left.join(seen, ["sid", "node"], "left_anti").select("sid", "node", blk("node")))
            seen = cut_lineage(seen.unionByName(new))
    d = entries(seen).join(rows.hint("merge"), ["sid", "blk"], "left")
    return d.select("sid", "blk", F.explode(_walk("_c", "_p", "_s")["inside"]).alias("_i")).select("sid", (F.col("_i") + low).alias("idx"))


def closure(turns: DataFrame, edges: DataFrame, primary_only: bool = False, block: int = BLOCK) -> DataFrame:
    """Ancestors of each query, the query excluded: (sid, idx).

    ``primary_only`` follows only first parents.  Conversations may be of any length.
    """
    e = (edges.where("pos = 0") if primary_only else edges).select("sid", "child", "parent")
    starts = query_turns(turns).select("sid", F.col("query_idx").alias("node"))
    return _reach(starts, e, block * WIDER).join(starts.withColumnRenamed("node", "idx").hint("merge"), ["sid", "idx"], "left_anti")


def active_branch(turns: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """The turn before the query and its chain of primary parents: (sid, idx, hop)."""
    pp = primary_parent(edges)
    level = turns.where("rev = 1").select("sid", "idx", F.lit(0).alias("hop"))
    out = level
    for hop in range(1, depth):
        level = level.join(pp.withColumnRenamed("child", "idx"), ["sid", "idx"]).select(
            "sid", F.col("parent").alias("idx"), F.lit(hop).alias("hop"))
        out = out.union(level)
    return out


def branch_heads(turns: DataFrame, edges: DataFrame) -> DataFrame:
    """History turns that are no history turn's primary parent: (sid, idx, rev)."""
    q = query_turns(turns)
    used = (
        primary_parent(edges)
        .join(q.withColumnRenamed("query_idx", "child"), ["sid", "child"], "left_anti")
        .select("sid", F.col("parent").alias("idx"))
    )
    return turns.where("rev > 0").select("sid", "idx", "rev").join(used, ["sid", "idx"], "left_anti")


@F.pandas_udf(TURNS)
def _local_roots(idx: pd.Series, up: pd.Series, low: pd.Series) -> pd.Series:
    """Root of each member of a block in order, its own ``up`` being none; below zero, -1 less the turn outside that is met."""
    out = []
    for ids, ups, first in zip(idx, up, low, strict=True):
        to = {}
        for i, u in zip(map(int, ids), map(int, ups), strict=True):
            to[i] = i if u == i else -1 - u if u < first else to[u]
        out.append(list(to.values()))
    return pd.Series(out)


def _roots(links: DataFrame, block: int) -> DataFrame:
    """links(sid, idx, up) -> (sid, idx, root); ``up`` is an earlier member or NULL.

    Blocks of turns are folded in parallel: a member's root, or the turn outside the block that its chain leads to.
    Those turns are then followed from block to block, twice as far in each round.
    """
    low = F.floor(F.col("idx") / block).cast("bigint") * block
    rows = links.groupBy("sid", low.alias("_low")).agg(F.sort_array(F.collect_list(F.struct("idx", "up"))).alias("_t"))
    rows = rows.select("sid", F.col("_t.idx").alias("idx"), _local_roots(F.col("_t.idx"), F.transform("_t", lambda t: F.coalesce(t["up"], t["idx"])), "_low").alias("to"))
    local = cut_lineage(rows.select("sid", F.inline(F.arrays_zip("idx", "to"))).toDF("sid", "idx", "to"))
    far = local.where("to < 0").select("sid", "idx", (-1 - F.col("to")).alias("node"))
    if far.isEmpty():
        return local.select("sid", "idx", F.col("to").alias("root"))
    ptr = far.select("sid", "node").distinct().join(local.withColumnRenamed("idx", "node"), ["sid", "node"])
    ptr = cut_lineage(ptr.select("sid", "node", "to"))
    while not ptr.where("to < 0").isEmpty():
        onward = ptr.select("sid", (-1 - F.col("node")).alias("to"), F.col("to").alias("_further"))
        ptr = cut_lineage(ptr.join(onward, ["sid", "to"], "left").select("sid", "node", F.coalesce("_further", "to").alias("to")))
    found = far.join(ptr, ["sid", "node"]).select("sid", "idx", F.col("to").alias("root"))
    return local.where("to >= 0").select("sid", "idx", F.col("to").alias("root")).unionByName(found)


def donor_branches(turns: DataFrame, edges: DataFrame, gold: DataFrame, block: int = BLOCK) -> DataFrame:
    """Non-gold history turns grouped by membership of their primary parent.

    (sid, idx, root): ``root`` is the first turn of the branch; branch numbers in
    order of first turn are the dense rank of ``root``.
    """
    # written turns are small as files and large as a broadcast
    members = turns.where("rev > 0").select("sid", "idx").join(gold.select("sid", "idx").hint("merge"), ["sid", "idx"], "left_anti")
    up = primary_parent(edges).select("sid", F.col("child").alias("idx"), F.col("parent").alias("up"))
    linked = members.join(up.hint("merge"), ["sid", "idx"], "left")
    kept = members.select("sid", F.col("idx").alias("up"), F.lit(True).alias("_in"))
    return _roots(linked.join(kept.hint("merge"), ["sid", "up"], "left").select("sid", "idx", F.when(F.col("_in"), F.col("up")).alias("up")), block)


def branch_numbers(branches: DataFrame) -> DataFrame:
    """(sid, root, branch, n_turns) with branches numbered from 0 by first turn."""
    from convgraph.functions.splitwin import split_row_number

    heads = branches.groupBy("sid", "root").agg(F.count(F.lit(1)).alias("n_turns"))
    numbered = split_row_number(heads, ["sid"], F.floor(F.col("root") / 4096), [F.col("root")], "_b")
    return numbered.select("sid", "root", (F.col("_b") - 1).alias("branch"), "n_turns")


def is_subsequence(a: Column, b: Column) -> Column:
    """True if array ``a`` occurs in ``b`` in order, gaps allowed."""
    n = F.size(a)
    walked = F.aggregate(
        b, F.lit(0),
        lambda p, x: F.when((p < n) & (F.get(a, p) == x), p + F.lit(1)).otherwise(p))
    return walked == n


def follows_pattern(turns: DataFrame, value: str, pattern: list[str], out: str, block: int = 4 * BLOCK) -> DataFrame:
    """Whether ``pattern`` is a subsequence of each conversation's ``value``s: (sid, out).

    The walk through one block of turns maps "matched so far" to "matched after",
    for every possible start; blocks are mapped in parallel and then chained.
    """
    pat = F.array(*[F.lit(p) for p in pattern])
    m = len(pattern)
    blocks = turns.withColumn("_blk", F.floor(F.col("idx") / block)).groupBy("sid", "_blk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", value))), lambda x: x[value]).alias("_s"))

    def walk(start: int) -> Column:
        return F.aggregate("_s", F.lit(start), lambda p, x: F.when(
            (p < m) & F.get(pat, p).eqNullSafe(x), p + F.lit(1)).otherwise(p))

    mapped = blocks.select("sid", "_blk", F.array(*[walk(i) for i in range(m + 1)]).alias("_to"))
    chained = mapped.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("_blk", "_to"))).alias("_c"))
    return chained.select("sid", (F.aggregate("_c", F.lit(0), lambda p, b: F.get(b["_to"], p)) == m).alias(out))


def in_order(closed: DataFrame) -> DataFrame:
    """Chronological ordinal of each closure turn: (sid, idx, ord)."""
    from convgraph.functions.splitwin import split_row_number

    return split_row_number(closed.select("sid", "idx"), ["sid"], F.floor(F.col("idx") / (4 * BLOCK)),
                            [F.col("idx")], "ord")


def closure_ratio(turns: DataFrame, closed: DataFrame) -> DataFrame:
    """(sid, n_closure, n_history, closure_ratio)."""
    h = turns.groupBy("sid").agg(F.sum(F.when(F.col("rev") > 0, 1).otherwise(0)).alias("n_history"))
    c = closed.groupBy("sid").agg(F.count(F.lit(1)).alias("n_closure"))
    return h.join(c, "sid", "left").select(
        "sid", F.coalesce("n_closure", F.lit(0)).cast("bigint").alias("n_closure"), "n_history",
        F.try_divide(F.coalesce("n_closure", F.lit(0)), F.col("n_history")).alias("closure_ratio"))


def edge_faults(turns: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that name a missing turn or do not point backwards: (sid, child, parent, fault)."""
    known = turns.select("sid", F.col("idx").alias("parent"), F.lit(True).alias("_known"))
    e = edges.join(known, ["sid", "parent"], "left")
    fault = F.when(F.col("_known").isNull(), "missing").when(F.col("parent") >= F.col("child"), "forward")
    return e.withColumn("fault", fault).where("fault is not null").select("sid", "child", "parent", "fault")
