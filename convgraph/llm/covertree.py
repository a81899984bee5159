"""Exact near-duplicate search among embeddings by dual traversal of cover trees.

Vectors are compared as unit vectors, where a cosine of at least c is a distance of at most t = sqrt(2 - 2c).  A node
covers its descendants within a known radius; two nodes whose centres are farther apart than both radii and t hold no
link and are left out together.

Upper levels are tables.  Each label's distinct vectors start as one cell; a cell with more than ``CELL`` vectors is
split among some of its members taken as centres (nested: a centre stays in its cell), each vector going to the nearest,
until no cell is too large.  Pairs of cells are then traversed level by level by joins, dropping pairs by the bound.
Lower levels are trees in tasks: each pair of cells left is one group of at most 2 * CELL vectors, for which cover trees
with halving radii are built and traversed together.

Equal vectors of a label are one node with a count, so copies make no pairs.  A group gives, per vector, its number of
links and the smallest node of its local component, never pairs.

Scale: cells are of bounded size and spread over all tasks.  Where vectors of a label are nearly orthogonal to each other,
no radius prunes and the exact search compares all cells of a label; its work then grows with the square of the label.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label,
link with nothing and are their own component; vectors of different lengths never link; repeated ids are separate
vectors; null ids stay; an empty table stays empty; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage
from convgraph.llm.common import components, rank_in_class

CELL, FAN_OUT, MAX_DEPTH = 2048, 64, 40
SLACK = 1e-7  # for bounds only; links are decided by the cosine itself


class Tree:
    """Cover tree of a few thousand vectors: nested nodes, radii halving from 2, each child within its parent's radius."""

    def __init__(self, unit: np.ndarray):
        self.far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ unit.T)))
        np.fill_diagonal(self.far, 0.0)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        if len(unit):
            self._grow(0, np.arange(len(unit)), 2.0)

    def _node(self, centre: int, members: np.ndarray) -> int:
        self.centre.append(centre)
        self.members.append(members)
        self.radius.append(float(self.far[centre, members].max()))
        self.children.append([])
        return len(self.centre) - 1

    def _grow(self, centre: int, members: np.ndarray, reach: float) -> None:
        todo = [(self._node(centre, members), reach)]
        while todo:
            node, reach = todo.pop()
            c, m = self.centre[node], self.members[node]
            if self.radius[node] <= SLACK * 10:  # nearer than rounding can tell: a leaf, whatever its size
                continue
            reach /= 2
            while self.radius[node] <= reach:  # levels at which the node is its own only child
                reach /= 2
            net, open_ = [c], np.ones(len(m), dtype=bool)
            open_ &= self.far[c, m] > reach
            while open_.any():  # a net: centres more than `reach` apart that cover all members
                nxt = int(m[np.argmax(open_)])
                net.append(nxt)
                open_ &= self.far[nxt, m] > reach
            of = np.argmin(self.far[np.ix_(net, m)], axis=0)
            for k, x in enumerate(net):
                mine = m[of == k]
                if len(mine):
                    child = self._node(x, mine)
                    self.children[node].append(child)
                    todo.append((child, reach))


def dual_links(left: np.ndarray, right: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of rows with at least ``cosine``; i < j if both sides are the same rows."""
    none = np.zeros(0, dtype=np.int64)
    if not len(left) or not len(right):
        return none, none
    norm_l, norm_r = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    ul, ur = left / norm_l[:, None], right / norm_r[:, None]
    a = Tree(ul)
    b = a if same else Tree(ur)
    t = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + SLACK
    found_i, found_j, todo = [], [], [(0, 0)]
    ra, rb = np.array(a.radius), np.array(b.radius)
    ca, cb = np.array(a.centre), np.array(b.centre)
    while todo:
        x, y = todo.pop()
        mx, my = a.members[x], b.members[y]
        xs = a.children[x] or [x]
        ys = b.children[y] or [y]
        if len(mx) * len(my) <= 1024 or (xs == [x] and ys == [y]):
            cos = (left[mx] @ right[my].T) / (norm_l[mx][:, None] * norm_r[my][None, :])
            i, j = np.nonzero(cos >= cosine)
            found_i.append(mx[i])
            found_j.append(my[j])
            continue
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (ul[ca[xs]] @ ur[cb[ys]].T)))
        i, j = np.nonzero(d <= ra[xs][:, None] + rb[ys][None, :] + t)
        pairs = ((xs[p], ys[q]) for p, q in zip(i.tolist(), j.tolist()))
        todo += [p for p in pairs if p[0] <= p[1]] if same and x == y else pairs
    i, j = np.concatenate(found_i or [none]), np.concatenate(found_j or [none])
    if same:
        lo, hi = np.minimum(i, j), np.maximum(i, j)
        pair = np.unique(lo[lo < hi] * len(left) + hi[lo < hi])
        i, j = pair // len(left), pair % len(left)
    return i, j


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return finite & F.exists(v, lambda x: x != 0)


def _unit(v: Column) -> Column:
    """Scaled by the largest component first, so that squares neither overflow nor vanish."""
    big = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.transform(v, lambda x: x / big)


def _nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Send each point of a split cell to the nearest of the cell's centres (ties: the first); adds cell and far."""
    lists = centres.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("gid", "vec"))).alias("cs"))  # at most FAN_OUT each

    @F.pandas_udf("cell bigint, far double")
    def choose(vec: pd.Series, ids: pd.Series, vecs: pd.Series) -> pd.DataFrame:
        cells, far = [], []
        cache: dict = {}
        for v, i, c in zip(vec, ids, vecs):
            if (key := i[0]) not in cache:
                m = np.vstack(list(c))
                cache[key] = m / np.linalg.norm(m, axis=1, keepdims=True)
            d = cache[key] @ (v / np.linalg.norm(v))
            k = int(np.argmax(d))
            cells.append(int(i[k]))
            far.append(math.sqrt(max(0.0, 2.0 - 2.0 * float(d[k]))))
        return pd.DataFrame({"cell": cells, "far": far})

    joined = points.join(lists, "cell").withColumn("_to", choose("vec", F.col("cs.gid"), F.col("cs.vec")))
    return joined.select("gid", "part", "vec", "n", F.col("_to.cell").alias("cell"), F.col("_to.far").alias("far"))


def _centre_distance() -> Column:
    unit_a, unit_b = F.col("ca"), F.col("cb")
    dot = F.aggregate(F.zip_with(unit_a, unit_b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    aa = F.aggregate(unit_a, F.lit(0.0), lambda s, x: s + x * x)
    bb = F.aggregate(unit_b, F.lit(0.0), lambda s, x: s + x * x)
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot / F.sqrt(aa * bb)))


def links(vectors: DataFrame, cosine: float) -> DataFrame:
    """Rows (gid, links, root) from all groups of cells; ``vectors`` has (gid, part, vec, n), distinct within a part."""
    points = cut_lineage(vectors.select("gid", "part", "vec", "n"))
    total = points.count()
    size = points.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("gid").alias("first"))
    # level 0: one cell per part, around its first vector, with the largest possible radius
    start = size.join(points.select("gid", "vec"), F.col("first") == F.col("gid")).select(F.col("first").alias("cell"), F.col("vec").alias("centre"), F.lit(2.0).alias("radius"), "size", "part")
    level = cut_lineage(start)
    placed = points.join(F.broadcast(level.select("part", "cell")) if total < CELL else level.select("part", "cell"), "part").withColumn("far", F.lit(2.0))
    pairs = level.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    for depth in range(MAX_DEPTH):
        if not level.where(F.col("size") > CELL).head(1):
            break
        large = level.where(F.col("size") > CELL).select("cell", F.least(F.lit(FAN_OUT), F.ceil(2 * F.col("size") / CELL)).alias("fan"))
        inside = placed.join(large.select("cell"), "cell", "left_semi")
        kept = placed.join(large.select("cell"), "cell", "left_anti")
        ranked = rank_in_class(inside.select("cell", "gid", "vec"), ["cell"], F.xxhash64("gid", F.lit(depth)), total, ties=[F.col("gid")], classes=large)
        centres = cut_lineage(ranked.where("rank < fan").select("cell", "gid", "vec"))
        moved = _nearest(inside, centres)
        placed = cut_lineage(moved.unionByName(kept.select("gid", "part", "vec", "n", "cell", "far")))
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("far").alias("radius"), F.first("part").alias("part"))
        below = sizes.join(points.select(F.col("gid").alias("cell"), F.col("vec").alias("centre")), "cell")
        level = cut_lineage(below.select("cell", "centre", "radius", "size", "part"))
        family = centres.select(F.col("cell").alias("parent"), F.col("gid").alias("cell")).unionByName(kept.select(F.col("cell").alias("parent"), "cell").distinct())
        family = cut_lineage(family.join(level, "cell").select("parent", "cell", "centre", "radius"))
        ends = [family.select(F.col("parent").alias(old), F.col("cell").alias(f"{old}2"), F.col("centre").alias(f"c{old}"), F.col("radius").alias(f"r{old}")) for old in "ab"]
        grown = pairs.join(ends[0], "a").join(ends[1], "b").where((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2")))
        near = _centre_distance() <= F.col("ra") + F.col("rb") + F.lit(math.sqrt(2.0 - 2.0 * cosine) + SLACK)
        pairs = cut_lineage(grown.where((F.col("a2") == F.col("b2")) | near).select(F.col("a2").alias("a"), F.col("b2").alias("b")))
    else:
        raise RuntimeError(f"cells did not shrink to {CELL} vectors in {MAX_DEPTH} levels")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gid")
        l, r = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = r.empty
        x = np.vstack(l["vec"].to_numpy())
        y = x if same else np.vstack(r["vec"].to_numpy())
        i, j = dual_links(x, y, cosine, same)
        ids = l["gid"].to_numpy() if same else np.concatenate([l["gid"].to_numpy(), r["gid"].to_numpy()])
        n = l["n"].to_numpy() if same else np.concatenate([l["n"].to_numpy(), r["n"].to_numpy()])
        j = j if same else j + len(l)
        count = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][local_roots(len(ids), place[i], place[j])][place]
        hit = count > 0
        return pd.DataFrame({"gid": ids[hit], "links": count[hit].astype(np.int64), "root": root[hit]})

    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("cell"), F.lit(0).alias("side"))))
                                             .otherwise(F.array(F.struct(F.col("a").alias("cell"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cell"), F.lit(1).alias("side"))))).alias("_s"))
    rows = sides.select("a", "b", "_s.cell", "_s.side").join(placed.select("cell", "gid", "vec", "n"), "cell").select("a", "b", "side", "gid", "vec", "n")
    return rows.groupBy("a", "b").applyInPandas(group, "gid bigint, links bigint, root bigint")


def near_duplicates(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept); links only within equal labels."""
    d = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vec"))
    ok = F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & _usable(F.col("vec")), F.lit(False))
    d = cut_lineage(d.withColumn("ok", ok))
    vec = F.col("vec")
    same = d.where("ok").groupBy("label", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    nodes = cut_lineage(same.withColumn("gid", F.monotonically_increasing_id()).withColumn("part", F.struct("label", F.size("vec"))))
    found = cut_lineage(links(nodes.select("gid", F.xxhash64("part").alias("part"), _unit(vec).alias("vec"), "n"), cosine))
    comp = components(found.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("gid").agg(F.sum("links").alias("links"))
    named = nodes.join(counts, "gid", "left").join(comp.withColumnRenamed("node", "gid"), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    named = cut_lineage(named.select("label", "vec", "gid", "n", "first", "root", F.coalesce("links", F.lit(0)).alias("links")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("label", "vec", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    hit = d.where("ok").join(named, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    out = hit.unionByName(d.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
