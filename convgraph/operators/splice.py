"""Longer conversations by splicing branches of other conversations into them.

Donors are all branches of all conversations; targets are any list of conversations.
Both are packed into blocks, and a task scores one block of donors against one block
of targets as a matrix product.  It returns, per target, counts of what it saw and, per
branch size, the best donors that can still fit: the pairs themselves are never rows.
Everything else is long; only the ranked donor queue of a target is an array, and its
size is bounded by the wanted length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convgraph.functions.digest import ordered_digest
from convgraph.functions.lineage import BATCH, cut_lineage, setting
from convgraph.functions.splitwin import split_row_number
from convgraph.operators import graph
from convgraph.operators.facts import first_per_group

# Fixed value: turns a spliced history may have above the wanted length.
SLACK = 6
# Rows of a block of donors and of a block of targets; a pair of blocks is one step of a task.
DONORS, TARGETS = 1024, 256
# Blocks of turns that Python gets at once.
BLOCKS = 1000


def donor_pool(turns: DataFrame, edges: DataFrame, closed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (sid, idx, root) and donors (sid, root, branch, n_turns) of all conversations."""
    with setting(turns.sparkSession, BATCH, str(BLOCKS)):
        members = cut_lineage(graph.donor_branches(turns, edges, closed))
    return members, graph.branch_numbers(members)


def targets(turns: DataFrame, families: Sequence[str] | None, per_family: int) -> DataFrame:
    """First conversations per family by id: (sid, family, base_n)."""
    q = turns.where("rev = 0").select("sid", "family", F.col("idx").alias("base_n"))
    if families is not None:
        q = q.where(F.col("family").isin(list(families)))
    return cut_lineage(first_per_group(q, "family", "sid", per_family))


def target_lengths(t: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Lengths to build per target: those above its own, else the longest: (sid, base_n, length)."""
    ls = F.array(*[F.lit(int(x)) for x in sorted(lengths)])
    above = F.filter(ls, lambda x: x > F.col("base_n"))
    return t.select("sid", "base_n", F.explode(F.when(F.size(above) > 0, above).otherwise(
        F.array(F.lit(int(max(lengths)))))).alias("length"))


def _score(room: int):
    """One block of donors against one of targets.  Returns per target a row of counts (sid null) and the rows of the best
    donors by size: as many of a size as still fit, since of one size the better ranked are taken first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for donors, targets in zip(batch["donors"], batch["targets"]):
                d, t = pd.DataFrame(list(donors)), pd.DataFrame(list(targets))
                missing = np.array([x is None for x in d["u"]])
                width = len(t["u"].iloc[0])
                du = np.stack([np.full(width, np.nan) if x is None else x for x in d["u"]])
                cosine = np.einsum("ij,kj->ki", du, np.stack(t["u"].to_list()))  # each pair by itself: equal vectors tie exactly
                other = d["sid"].to_numpy()[None, :] != t["target"].to_numpy()[:, None]
                having: dict[str, list[int]] = {}
                for i, items in enumerate(d["items"]):
                    for x in items if items is not None else ():
                        having.setdefault(x, []).append(i)
                clash = np.zeros(cosine.shape, dtype=bool)
                for k, items in enumerate(t["items"]):
                    for x in items if items is not None else ():
                        clash[k, having.get(x, [])] = True
                clash &= other
                n = d["n_turns"].to_numpy()
                out = []
                for k, (target, base_n) in enumerate(zip(t["target"], t["base_n"])):
                    seen, free = other[k] & ~missing, other[k] & ~missing & ~clash[k]
                    out.append({"target": target, "base_n": base_n, "n_donors": int(seen.sum()), "sum_cosine": float(cosine[k, seen].sum()),
                                "max_cosine": float(cosine[k, seen].max()) if seen.any() else None, "n_rejected": int(clash[k].sum()),
                                "n_admissible": int(free.sum()), "turns_admissible": int(n[free].sum())})
                    at = np.flatnonzero(free & (n <= room - base_n))
                    at = at[np.lexsort((d["root"].to_numpy()[at], d["sid"].to_numpy()[at], -cosine[k, at], n[at]))]
                    rank = pd.Series(n[at]).groupby(n[at]).cumcount().to_numpy() + 1
                    for i in at[rank * n[at] <= room - base_n]:
                        out.append({"target": target, "base_n": base_n, "sid": d["sid"].iat[i], "root": d["root"].iat[i], "branch": d["branch"].iat[i],
                                    "n_turns": n[i], "cosine": float(cosine[k, i])})
                cols = ["target", "base_n", "sid", "root", "branch", "n_turns", "cosine", "n_donors", "sum_cosine", "max_cosine", "n_rejected",
                        "n_admissible", "turns_admissible"]
                res = pd.DataFrame(out, columns=cols)
                whole = [c for c in cols if c not in ("cosine", "sum_cosine", "max_cosine")]
                yield res.astype({c: "Int64" for c in whole})

    return run


def score_donors(t: DataFrame, query_vectors: DataFrame, donors: DataFrame, donor_vectors: DataFrame, closed: DataFrame, members: DataFrame,
                 items: DataFrame, lengths: Sequence[int], slack: int = SLACK) -> tuple[DataFrame, DataFrame]:
    """Every donor of another conversation against every target, in blocks: (best donors, reports per target).

    query_vectors(sid, u) and donor_vectors(sid, root, u) are of unit length.  A donor that shares an item with the target's
    gold turns or query is rejected.  Best donors: (target, base_n, sid, root, branch, n_turns, cosine), complete for the
    choice by ``choose_donors`` at these lengths.  Reports: (target, n_donors, mean_cosine, best_cosine, n_rejected,
    n_admissible, turns_admissible).
    """
    gold = closed.select("sid", "idx").unionByName(t.select("sid", F.col("base_n").alias("idx")))
    mine = gold.join(t.select("sid"), "sid").join(items, ["sid", "idx"]).select("sid", "item").distinct()
    mine = cut_lineage(mine)
    theirs = members.join(items, ["sid", "idx"]).join(mine.select("item").distinct(), "item", "left_semi")
    theirs = theirs.groupBy("sid", "root").agg(F.collect_set("item").alias("items"))
    d = cut_lineage(donors.join(donor_vectors, ["sid", "root"], "left").join(theirs, ["sid", "root"], "left"))
    n_chunks = max(1, math.ceil(d.count() / DONORS))
    chunk = F.pmod(F.xxhash64("sid", "root"), F.lit(n_chunks)).alias("chunk")
    chunks = d.groupBy(chunk).agg(F.collect_list(F.struct("sid", "root", "branch", "n_turns", "u", "items")).alias("donors"))
    tv = t.join(query_vectors, "sid").join(mine.groupBy("sid").agg(F.collect_set("item").alias("items")), "sid", "left")
    tv = cut_lineage(tv.select(F.col("sid").alias("target"), "base_n", "u", "items"))
    n_blocks = max(1, math.ceil(tv.count() / TARGETS))
    block = F.pmod(F.xxhash64("target"), F.lit(n_blocks)).alias("block")
    blocks = cut_lineage(tv.groupBy(block).agg(F.collect_list(F.struct("target", "base_n", "u", "items")).alias("targets")))
    # every pair of blocks meets once; blocks of targets are repeated over salts, so that no block is one task
    salts = max(1, min(n_chunks, d.sparkSession.sparkContext.defaultParallelism))
    left = chunks.select("donors", F.pmod("chunk", F.lit(salts)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block"))
    right = blocks.select("block", "targets", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    schema = ("target bigint, base_n bigint, sid bigint, root bigint, branch bigint, n_turns bigint, cosine double, n_donors bigint, sum_cosine double, "
              "max_cosine double, n_rejected bigint, n_admissible bigint, turns_admissible bigint")
    # a row is a whole pair of blocks, so Python gets one at a time
    with setting(d.sparkSession, BATCH, "1"):
        scored = cut_lineage(left.join(right, ["block", "salt"]).select("donors", "targets").mapInPandas(_score(int(max(lengths)) + slack), schema))
    best = scored.where("sid is not null").select("target", "base_n", "sid", "root", "branch", "n_turns", "cosine")
    reports = scored.where("sid is null").groupBy("target").agg(
        F.sum("n_donors").alias("n_donors"), F.try_divide(F.sum("sum_cosine"), F.sum("n_donors")).alias("mean_cosine"), F.max("max_cosine").alias("best_cosine"),
        *[F.sum(c).alias(c) for c in ("n_rejected", "n_admissible", "turns_admissible")])
    return best, reports


def choose_donors(best: DataFrame, lengths: Sequence[int], slack: int = SLACK) -> DataFrame:
    """Greedy fill of each length in turn, skipping donors that would overshoot.

    (target, pick, length, sid, root, branch, n_turns, cosine): ``pick`` counts
    from 0, ``length`` is the first length that includes the donor.  Donors of one
    size are taken in rank order, and no more than (longest + slack) / size of
    them fit, so only those enter the queue.
    """
    room = int(max(lengths)) + slack
    w = Window.partitionBy("target", "n_turns").orderBy(F.desc("cosine"), "sid", "root")
    ok = best.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") * F.col("n_turns") <= room - F.col("base_n"))
    item = F.struct((-F.col("cosine")).alias("o"), "sid", "root", "branch", "n_turns", "cosine")
    q = ok.groupBy("target", "base_n").agg(F.sort_array(F.collect_list(item)).alias("_q"))
    pick_t = "array<struct<length:int,at:int>>"
    state: Column = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast(pick_t).alias("picks"))
    steps = F.sequence(F.lit(0), F.size("_q") - 1)
    d = q.withColumn("_s", state)
    for length in sorted(lengths):
        d = d.withColumn("_s", F.aggregate(steps, F.col("_s"), _take_if_it_fits(int(length), slack)))
    p = d.select("target", "_q", F.posexplode("_s.picks").alias("pick", "_p"))
    return p.select("target", "pick", F.col("_p.length").alias("length"), F.get("_q", F.col("_p.at")).alias("_d")).select(
        "target", "pick", "length", "_d.sid", "_d.root", "_d.branch", "_d.n_turns", "_d.cosine")


def _take_if_it_fits(length: int, slack: int):
    def step(acc: Column, j: Column) -> Column:
        n = F.get("_q", j)["n_turns"]
        now = F.col("base_n") + acc["total"]
        used = F.exists(acc["picks"], lambda p: p["at"] == j)
        take = ~used & (now < length) & (now + n <= length + slack)
        return F.when(take, F.struct(
            (acc["total"] + n).cast("bigint").alias("total"),
            F.array_append(acc["picks"], F.struct(F.lit(length).alias("length"), j.alias("at"))).alias("picks"))).otherwise(acc)

    return step


def assign_slots(t: DataFrame, closed: DataFrame, picks: DataFrame, seed: int, max_picks: int) -> DataFrame:
    """Picks with the insertion point of their block: before the first gold turn or after one.

    Slots are shuffled by a seeded hash and used round-robin; without gold turns
    they are the start and the end.
    """
    gold = closed.join(t.select("sid"), "sid").select("sid", (F.col("idx") + 1).alias("slot"))
    none = t.join(gold.select("sid").distinct(), "sid", "left_anti").select("sid", F.col("base_n").alias("slot"))
    slots = gold.unionByName(none).unionByName(t.select("sid", F.lit(0).cast("bigint").alias("slot"))).distinct()
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sid").cast("string"), F.col("slot").cast("string")))
    n = slots.groupBy("sid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("sid").orderBy(h, "slot")
    first = slots.withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") <= max_picks)
    p = picks.join(n.withColumnRenamed("sid", "target"), "target").withColumn("_k", (F.col("pick") % F.col("_n")).cast("int"))
    return p.join(first.withColumnRenamed("sid", "target"), ["target", "_k"]).drop("_k", "_n")


def interleave(turns: DataFrame, members: DataFrame, wanted: DataFrame, picks: DataFrame) -> DataFrame:
    """New turn order: (target, length, new_idx, rev, origin, sid, idx, pick, cost).

    ``wanted(sid, base_n, length)``, ``picks`` with slots.
    """
    want = wanted.select(F.col("sid").alias("target"), F.col("length").alias("want"), "base_n")
    base = turns.select("sid", "idx", "cost").join(want, F.col("sid") == F.col("target")).select(
        "target", "want", F.col("idx").alias("_at"), F.lit(1).alias("_base"), F.lit(None).cast("int").alias("pick"), "sid", "idx", "cost")
    blocks = picks.join(want, "target").where(F.col("length") <= F.col("want")).select(
        "target", "want", F.col("slot").alias("_at"), "pick", "sid", "root")
    donor = members.join(blocks, ["sid", "root"]).join(turns.select("sid", "idx", "cost"), ["sid", "idx"]).select(
        "target", "want", "_at", F.lit(0).alias("_base"), "pick", "sid", "idx", "cost")
    rows = base.unionByName(donor).withColumnRenamed("want", "length")
    out = split_row_number(rows, ["target", "length"], F.floor(F.col("_at") / 256),
                           [F.col("_at"), F.col("_base"), F.col("pick"), F.col("idx")], "_rn", "_n")
    return out.select(
        "target", "length", (F.col("_rn") - 1).alias("new_idx"), (F.col("_n") - F.col("_rn")).alias("rev"),
        F.when(F.col("_base") == 1, "base").otherwise("donor").alias("origin"), "sid", "idx", "pick", "cost")


def splice_key(target: Column, length: Column) -> Column:
    return F.concat(target.cast("string"), F.lit("__L"), length.cast("string"))


def remap_edges(spliced: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the new conversations: the target's own, and each donor block as a chain."""
    b = spliced.where("origin = 'base'")
    own = edges.join(b.select("sid", F.col("idx").alias("child"), "target", "length", F.col("new_idx").alias("_c")), ["sid", "child"])
    own = own.join(b.select("sid", F.col("idx").alias("parent"), "target", "length", F.col("new_idx").alias("_p")),
                   ["sid", "parent", "target", "length"])
    own = own.select("target", "length", F.col("_c").alias("child"), F.col("_p").alias("parent"), "pos")
    w = Window.partitionBy("target", "length", "pick").orderBy("new_idx")
    chain = spliced.where("origin = 'donor'").withColumn("_prev", F.lag("new_idx").over(w)).where("_prev is not null")
    return own.unionByName(chain.select("target", "length", F.col("new_idx").alias("child"), F.col("_prev").alias("parent"),
                                        F.lit(0).alias("pos")))


def remap_marks(spliced: DataFrame, superseders: DataFrame, evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """Marks of the new turns: (target, length, new_idx, kind, value).

    ``superseders(sid, idx, by)`` and ``evidence(sid, idx)`` of the target follow their turns (``value`` of a superseder is
    the new place of the later turn, and it is lost if that turn is none of the conversation's); every history turn
    outside the target's ``gold`` closure is a distractor, spliced ones included.
    """
    key = ["target", "length"]
    own = spliced.where("origin = 'base' and sid = target").select(*key, "sid", "idx", "new_idx")
    later = own.select(*key, F.col("idx").alias("by"), F.col("new_idx").alias("value"))
    none = F.lit(None).cast("bigint").alias("value")
    stale = own.join(superseders, ["sid", "idx"]).join(later, [*key, "by"]).select(*key, "new_idx", F.lit("superseded").alias("kind"), "value")
    proof = own.join(evidence.select("sid", "idx"), ["sid", "idx"]).select(*key, "new_idx", F.lit("evidence").alias("kind"), none)
    kept = own.join(gold.select("sid", "idx"), ["sid", "idx"], "left_semi").select(*key, "new_idx")
    rest = spliced.where("rev > 0").join(kept, [*key, "new_idx"], "left_anti").select(*key, "new_idx", F.lit("distractor").alias("kind"), none)
    return stale.unionByName(proof).unionByName(rest)


def donor_lists(picks: DataFrame, wanted: DataFrame, spliced: DataFrame) -> DataFrame:
    """Per target and length: the donors used in the order in which they were chosen, as ``sid#branch``, and the history's
    real length: (target, length, used, n_used, actual_length).  A list is as long as the wanted length allows."""
    key = ["target", "length"]
    want = wanted.select(F.col("sid").alias("target"), F.col("length").alias("want"))
    name = F.concat(F.col("sid").cast("string"), F.lit("#"), F.col("branch").cast("string")).alias("name")
    used = picks.join(want, "target").where(F.col("length") <= F.col("want")).groupBy("target", F.col("want").alias("length")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pick", name))), lambda x: x["name"]), " ").alias("used"), F.count(F.lit(1)).alias("n_used"))
    real = spliced.where("rev > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("actual_length"))
    return real.join(used, key, "left").select(*key, F.coalesce("used", F.lit("")).alias("used"), F.coalesce("n_used", F.lit(0)).cast("bigint").alias("n_used"), "actual_length")


def text_checks(turns: DataFrame, closed: DataFrame, new_closed: DataFrame, checklist: DataFrame, new_checklist: DataFrame, new_turns: DataFrame) -> DataFrame:
    """Whether the spliced conversations still say what their targets said: (target, length, context_same, query_same,
    checklist_same).

    ``turns(sid, idx, rev, body)`` are the old turns as rendered, ``new_turns(target, length, new_idx, rev, body)`` the new
    ones; ``closed`` and ``new_closed(target, length, new_idx)`` their closures; ``checklist(sid, item_id, text)`` and
    ``new_checklist(target, length, item_id, text)``.  Texts are compared by ordered digests, each text read where it lies.
    """
    key = ["target", "length"]
    made = new_turns.where("rev = 0").select(*key, F.sha2("body", 256).alias("_new_query"))
    old_context = ordered_digest(closed.join(turns, ["sid", "idx"]), ["sid"], "idx", "body", "_old").drop("n")
    new_context = ordered_digest(new_closed.join(new_turns, [*key, "new_idx"]), key, "new_idx", "body", "_new").drop("n")
    old_list = ordered_digest(checklist, ["sid"], "item_id", "text", "_old_list").drop("n")
    new_list = ordered_digest(new_checklist, key, "item_id", "text", "_new_list").drop("n")
    query = turns.where("rev = 0").select("sid", F.sha2("body", 256).alias("_old_query"))
    d = made.join(new_context, key, "left").join(new_list, key, "left").withColumn("sid", F.col("target"))
    d = d.join(query, "sid", "left").join(old_context, "sid", "left").join(old_list, "sid", "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    return d.select(*key, same("_old", "_new").alias("context_same"), same("_old_query", "_new_query").alias("query_same"), same("_old_list", "_new_list").alias("checklist_same"))


def sidecar(t: DataFrame, picks: DataFrame, reports: DataFrame, wanted: DataFrame, spliced: DataFrame, longest: int) -> DataFrame:
    """(sid, family, base_n, n_donors, donor_turns, mean_cosine, n_rejected, sufficient)."""
    p = picks.groupBy(F.col("target").alias("sid")).agg(
        F.count(F.lit(1)).alias("n_donors"), F.sum("n_turns").alias("donor_turns"), F.avg(F.round("cosine", 4)).alias("mean_cosine"))
    r = reports.select(F.col("target").alias("sid"), "n_rejected")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return t.join(p, "sid", "left").join(r, "sid", "left").select(
        "sid", "family", "base_n", z("n_donors").alias("n_donors"), z("donor_turns").alias("donor_turns"), "mean_cosine",
        z("n_rejected").alias("n_rejected"), (F.col("base_n") + z("donor_turns") >= longest).alias("sufficient"))


def _in_order(pairs: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    """Whether ``b`` grows with ``a`` within ``key``: one row per key."""
    w = Window.partitionBy(*key, F.floor(F.col(a) / 256)).orderBy(a)
    d = pairs.withColumn("_ok", F.coalesce(F.col(b) > F.lag(b).over(w), F.lit(True)))
    per = d.groupBy(*key, F.floor(F.col(a) / 256).alias("_s")).agg(
        F.bool_and("_ok").alias("_ok"), F.min(b).alias("_lo"), F.max(b).alias("_hi"))
    v = Window.partitionBy(*key).orderBy("_s")
    joined = per.withColumn("_j", F.coalesce(F.col("_lo") > F.lag("_hi").over(v), F.lit(True)))
    return joined.groupBy(*key).agg(F.bool_and(F.col("_ok") & F.col("_j")).alias("ordered"))


def new_closure(spliced: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Closure of the new conversations' queries: (target, length, new_idx)."""
    key = splice_key(F.col("target"), F.col("length")).alias("sid")
    nt = spliced.select(key, F.col("new_idx").alias("idx"), "rev")
    found = graph.closure(nt, new_edges.select(key, "child", "parent", "pos")).withColumnRenamed("sid", "_k").withColumnRenamed("idx", "new_idx")
    back = spliced.select("target", "length", splice_key(F.col("target"), F.col("length")).alias("_k"), "new_idx")
    return found.join(back, ["_k", "new_idx"]).select("target", "length", "new_idx")


def preflight(turns: DataFrame, closed: DataFrame, members: DataFrame, items: DataFrame, t: DataFrame, spliced: DataFrame,
              new_edges: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Checks per target and length.

    closure_same: the closure of the new graph is the old closure, turn by turn,
    in the same order; base_inside and shorter_inside: subsequence tests;
    disjoint: no spliced turn shares an item with the gold turns or the query.
    """
    key = ["target", "length"]
    back = spliced.select(*key, "new_idx", "origin", "sid", "idx")
    got = new_closure(spliced, new_edges).join(back, [*key, "new_idx"]).select(*key, "origin", "sid", "idx", F.lit(1).alias("_n"))
    old = closed.join(back.where("origin = 'base' and sid = target"), ["sid", "idx"]).select(
        *key, "origin", "sid", "idx", F.lit(1).alias("_o"))
    same = old.join(got, [*key, "origin", "sid", "idx"], "full").groupBy(*key).agg(
        F.count_if(F.col("_n").isNull() | F.col("_o").isNull()).alias("_diff"))
    base = spliced.where("origin = 'base'")
    ordered = _in_order(base.select(*key, "idx", "new_idx"), key, "idx", "new_idx").withColumnRenamed("ordered", "base_inside")
    lo, hi = min(lengths), max(lengths)
    cols = ["target", "sid", "idx", "origin"]
    short = spliced.where(F.col("length") == lo).select(*cols, F.col("new_idx").alias("_a"))
    long = spliced.where(F.col("length") == hi).select(*cols, F.col("new_idx").alias("_b"))
    both = short.join(long, cols, "left")
    inside = both.groupBy("target").agg(F.count_if(F.col("_b").isNull()).alias("_miss")).join(
        _in_order(both.where("_b is not null"), ["target"], "_a", "_b"), "target").select(
        "target", ((F.col("_miss") == 0) & F.col("ordered")).alias("shorter_inside"))
    gold = closed.unionByName(t.select("sid", F.col("base_n").alias("idx")))
    mine = gold.join(t.select("sid"), "sid").join(items, ["sid", "idx"]).select(F.col("sid").alias("target"), "item").distinct()
    clash = spliced.where("origin = 'donor'").join(items, ["sid", "idx"]).join(mine, ["target", "item"]).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_clash"))
    total = spliced.where("rev > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n_history"), F.sum("cost").alias("full_tokens"))
    return total.join(same, key, "left").join(ordered, key).join(inside, "target", "left").join(clash, key, "left").select(
        *key, "n_history", "full_tokens", (F.coalesce("_diff", F.lit(0)) == 0).alias("closure_same"), "base_inside",
        F.coalesce("shorter_inside", F.lit(True)).alias("shorter_inside"), F.col("_clash").isNull().alias("disjoint"))


def preflight_summary(checks: DataFrame, cars: DataFrame) -> DataFrame:
    c = checks.agg(*[F.bool_and(x).alias(f"all_{x}") for x in ("closure_same", "base_inside", "shorter_inside", "disjoint")])
    s = cars.agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(~F.col("sufficient")).alias("n_insufficient"),
                 F.sum("n_rejected").alias("total_rejected"))
    return s.join(F.broadcast(c))
