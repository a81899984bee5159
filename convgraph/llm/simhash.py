"""SimHash near-duplicate search by covering locality-sensitive hashing.

Fingerprints.  A text's words (ASCII lower case) make shingles; bit i of its fingerprint is the majority of bit i of
their XXH64 values.

Covering tables.  Bits are dealt to the non-zero vectors of {0,1}^(r+1); table v keeps the bits whose vector is not
orthogonal to v.  Any r vectors leave some v != 0 orthogonal to all of them, so two fingerprints with at most r differing
bits agree on every bit that table v keeps: every such pair shares a bucket in one of 2^(r+1) - 1 tables.

Exact links without pairs.  Fingerprints that share a bucket are linked at 2 or fewer differing bits by a rule that
needs no pairs: x and y differ in at most two bits exactly if {x and its one-bit neighbours} and {y and its one-bit
neighbours} meet.  So each candidate fingerprint is written once under itself and under its neighbours in the bits its
shared buckets mask out, and equal keys are links.  A key has at most 65 fingerprints whatever the size of a bucket.

Similar texts.  ``similar_documents`` links texts whose fingerprints the covering tables bring together, after a check of
their resemblance.  Five-word shingles at a resemblance of 0.8 move a 64-bit fingerprint by about ten bits, far beyond a
radius that covering tables can afford (radius 14: 32,767 tables); the links that are left come from an exact rule on the
shingle sets themselves (prefixes in one order of all shingles) and are verified likewise.

Defined cases: null text counts as empty; no words give fingerprint zero, linked like any other; fewer words than a
shingle give one shingle of all words; equal texts always share a class; repeated ids are rows of their own class
member; null ids keep their class and never name it; empty tables stay empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage, release, setting
from convgraph.llm.common import among, components

BITS, SEED = 64, 42
BLOCK = 1 << 16  # shingles whose bits are counted at a time


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each shingle of ``k`` words, repeats included; bytes.split() splits at ASCII white space only."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words), SEED)], dtype=np.uint64)
    return np.fromiter((h(b" ".join(s), SEED) for s in zip(*[words[i:] for i in range(k)])), dtype=np.uint64, count=len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of ``hashes``."""
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i:i + BLOCK].astype(">u8")).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: Column, k: int = 3) -> Column:
    """Fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(majority(shingle_hashes(t, k))) for t in texts], dtype="int64")

    return simhash(text)


def covering_masks(radius: int) -> list[int]:
    """Bits kept by each of the 2^(radius+1) - 1 tables."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2 == 1) for v in range(1, vectors + 1)]


def links_within_two(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` with at most ``radius`` (1 or 2) differing bits."""
    if radius not in (1, 2):
        raise ValueError("links without pairs are defined for a radius of 1 or 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks)])
    rows = prints.select("fp").withColumn("_t", F.explode(tables)).select("fp", "_t.t", F.col("_t.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("_t.mask")).alias("key"))
    shared = rows.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("t", "key")
    # one row per candidate: the bits that some shared bucket leaves open
    open_bits = rows.join(shared, ["t", "key"]).groupBy("fp").agg(F.bit_or(F.bitwise_not("mask")).alias("bits"))
    flips = F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1),
                        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    own = F.array("fp")
    keys = open_bits.select("fp", F.explode(F.concat(own, flips) if radius == 2 else F.concat(own, F.filter(flips, lambda x: x < F.col("fp")))).alias("key"))
    met = keys.groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 each
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Rows (doc_id, fp, component_id): classes of documents chained by fingerprints within ``radius`` bits."""
    d = cut_lineage(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))
    prints = cut_lineage(d.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(links_within_two(prints, radius))
    cls = prints.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    cls = cut_lineage(cls)
    least = cls.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cls.join(least, "root").select("fp", "component_id")
    return d.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- similar texts ---------------------------------------------------------------------------------------------------

ROUNDS = 6  # at most so often are members of postings compared with chosen ones before the exact search
RARE = 1000  # rounds end when one finds fewer links than one in so many members
LARGE = 16  # members above which a posting is worth more than the first of these rounds
HASHES_PER_RANGE = 1 << 16  # shingle hashes of prefixes that are grouped together, about
SALTS = 8  # parts of a posting that the exact search joins in different tasks
SLACK = 1e-9  # against rounding: bounds may let a pair through, the resemblance itself decides
ROWS = 500  # texts whose hashes a task holds at a time, and rows sent to its Python at a time
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SAMPLED = 32  # one text in so many tells which shingles are frequent
FREQUENT = 2048  # a shingle of one sampled text in so many, and of four at least, is frequent


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for start in range(0, len(whole), ROWS):
            yield whole.iloc[start:start + ROWS].reset_index(drop=True)


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of frequent shingles, the less frequent first.

    They only steer the order of shingles: any one order finds every pair, and one with frequent shingles last makes
    short postings.  Their number is at most FREQUENT times the mean size of a text's set.
    """
    some = docs.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLED)) == 0).select("rid", "text")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["text"]:
                yield pd.DataFrame({"g": np.unique(shingle_hashes(t, k)).astype(np.int64)})

    counted = some.mapInPandas(make, "g bigint").groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    least = max(4, some.count() // FREQUENT)
    rows = counted.where(F.col("df") >= least).orderBy("df", "g").toPandas()
    return rows["g"].to_numpy(dtype=np.int64)


def _prefixes(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(rid, same, fp, n, grams, light, bits): digest of the word sequence, fingerprint, size of the shingle set and the prefix
    that meets every similar set: the first n - ceil(similarity * n) + 1 in the order (infrequent by hash, then frequent);
    ``light`` of them are infrequent; the whole set's row of bits."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = shared.value
        by_hash = np.argsort(frequent)
        known = frequent[by_hash]
        for pdf in _parts(batches):
            prints, n, grams, light, bits = [], [], [], [], []
            for t in pdf["text"]:
                hashes = shingle_hashes(t, k)
                prints.append(signed(majority(hashes)))
                g = np.unique(hashes).astype(np.int64)
                place = np.zeros(len(g), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    place = np.where(known[at] == g, by_hash[at] + 1, 0)
                m = len(g) - int(np.ceil(similarity * len(g) - SLACK)) + 1
                order = np.lexsort((g, place))[:m]
                n.append(len(g))
                grams.append(g[order])
                light.append(int((place[order] == 0).sum()))
                bits.append(_bit_row(g))
            yield pd.DataFrame({"rid": pdf["rid"], "same": pdf["same"], "fp": prints, "n": n, "grams": grams, "light": light, "bits": pd.Series(bits, dtype=object)})

    return docs.mapInPandas(make, "rid bigint, same binary, fp bigint, n int, grams array<bigint>, light int, bits binary")


def _postings(prefixes: DataFrame) -> DataFrame:
    """(g, rid, n, pos): members of the prefixes that more than one set may have.

    Infrequent hashes travel as arrays by range of the hash and go on if two sets of their range have them; frequent ones,
    of which there may be any number, are kept without being brought together.
    """
    total = prefixes.agg(F.sum(F.size("grams"))).first()[0] or 0
    ranges = max(1, min(1 << 31, total // HASHES_PER_RANGE))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 1000):
                pdf = whole.iloc[start:start + 1000]
                size = np.array([len(x) for x in pdf["grams"]], dtype=np.int64)
                if not size.sum():
                    continue
                g = np.concatenate(pdf["grams"].to_list()).astype(np.int64)
                pos = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
                at = (((g.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
                at[pos >= np.repeat(pdf["light"].to_numpy(), size)] = -1 - int(pdf["rid"].iloc[0])  # a group of this batch alone
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                cols = {"rs": np.repeat(pdf["rid"].to_numpy(), size), "gs": g, "ns": np.repeat(pdf["n"].to_numpy(), size).astype(np.int32), "ps": pos.astype(np.int32)}
                yield pd.DataFrame({"at": used} | {c: np.split(x[order], first[1:]) for c, x in cols.items()})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        g, rid, n, pos = (np.concatenate(pdf[c].to_list()) for c in ("gs", "rs", "ns", "ps"))
        if pdf["at"].iloc[0] >= 0:
            _, back, count = np.unique(g, return_inverse=True, return_counts=True)
            keep = count[back] > 1
            g, rid, n, pos = g[keep], rid[keep], n[keep], pos[keep]
        return pd.DataFrame({"g": g, "rid": rid, "n": n, "pos": pos})

    dealt = prefixes.mapInPandas(deal, "at bigint, rs array<bigint>, gs array<bigint>, ns array<int>, ps array<int>")
    return dealt.groupBy("at").applyInPandas(meet, "g bigint, rid bigint, n int, pos int")


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(rid, grams): all distinct shingle hashes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _parts(batches):
            yield pd.DataFrame({"rid": pdf["rid"], "grams": [np.unique(shingle_hashes(t, k)).astype(np.int64) for t in pdf["text"]]})

    return docs.select("rid", "text").mapInPandas(make, "rid bigint, grams array<bigint>")


def _bit_row(grams: np.ndarray) -> bytes:
    """A bit for each of a set's hashes in a row of 8 to 16 bits per hash."""
    row = np.zeros(1 << max(3, (8 * len(grams) - 1).bit_length()), dtype=np.uint8)
    row[grams & (len(row) - 1)] = 1
    return np.packbits(row).tobytes()


def _bits_differ(a: bytes, b: bytes) -> int:
    """A lower bound of the number of hashes that only one of two sets has: bits that only one has, at the shorter width."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in (a, b))
    while len(x) != len(y):  # the longer row folded in two: its places modulo half the width
        if len(x) > len(y):
            x = x[:len(x) // 2] | x[len(x) // 2:]
        else:
            y = y[:len(y) // 2] | y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _may_be_alike(x: str, y: str, similarity: float) -> Column:
    """False where the sizes, or the places of the first common shingle, leave too few common ones."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    return (F.least(nx, ny) >= F.lit(similarity - SLACK) * F.greatest(nx, ny)) & (rest >= F.lit(similarity / (1 + similarity) - SLACK) * (nx + ny))


def _alike(pairs: DataFrame, rows: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (x, y: structs with rid) whose whole sets have the resemblance.

    ``rows`` (rid, n, bits), an eighth of the sets' size, rule out most pairs for certain: alike sets differ in at most
    (1 - similarity) / (1 + similarity) of their hashes.  The sets of the others are made from ``texts`` and compared.
    """
    pairs = cut_lineage(pairs.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct())
    least = (1 - similarity) / (1 + similarity) + SLACK

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _parts(batches):
            near = [_bits_differ(x, y) <= least * n for x, y, n in zip(pdf["x"], pdf["y"], pdf["n"])]
            yield pdf.loc[near, ["a", "b"]]

    side = lambda to, bits, n: rows.select(F.col("rid").alias(to), F.col("bits").alias(bits), F.col("n").alias(n))
    both_bits = pairs.join(side("a", "x", "nx"), "a").join(side("b", "y", "ny"), "b")
    likely = cut_lineage(both_bits.select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("n")).mapInPandas(keep, "a bigint, b bigint"))
    ids = cut_lineage(likely.select(F.col("a").alias("rid")).union(likely.select("b")).distinct())
    few = cut_lineage(_shingle_sets(among(texts, ids, "rid"), k))
    left, right = few.select(F.col("rid").alias("a"), F.col("grams").alias("x")), few.select(F.col("rid").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    out = cut_lineage(likely.join(left, "a").join(right, "b").where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).select("a", "b"))
    release(pairs, likely, ids, few)
    return out


def _near_prints(heads: DataFrame) -> DataFrame:
    """Pairs (x, y: structs with rid) that chain all ``heads`` (rid, fp) whose fingerprints are linked."""
    prints = cut_lineage(heads.groupBy("fp").agg(F.min("rid").alias("first")))
    links = links_within_two(prints)
    side = lambda to, first: prints.select(F.col("fp").alias(to), F.col("first").alias(first))
    apart = links.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    equal = heads.join(prints, "fp").where("rid <> first").select(F.col("first").alias("x"), F.col("rid").alias("y"))
    return apart.unionByName(equal).select(*[F.struct(F.col(c).alias("rid")).alias(c) for c in ("x", "y")])


def _open_postings(rows: DataFrame, texts: DataFrame, alike: DataFrame) -> DataFrame:
    """Members (g, root, x, main, members, minor) of the postings that are in several classes of ``alike``: whether a member is
    in the posting's largest class, how many members there are and how many outside that class."""
    named = cut_lineage(texts.join(components(alike).withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    placed = cut_lineage(rows.join(named, "rid"))
    sizes = placed.groupBy("g", "root").agg(F.count(F.lit(1)).alias("k"))
    open_ = sizes.groupBy("g").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.sum("k").alias("members"), (F.sum("k") - F.max("k")).alias("minor")).where("minor > 0")
    out = cut_lineage(placed.join(open_, "g").select("g", "root", F.struct("rid", "n", "pos", "shared").alias("x"), (F.col("root") == F.col("largest")).alias("main"), "members", "minor"))
    release(placed)
    return out


def _pivot_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of ``_open_postings`` members with up to four of their posting in another class: the one with most shingles in
    common with others, from the largest class and from outside it, and two at random; others at each turn."""
    chance = lambda k: F.xxhash64("x.rid", F.lit(4 * turn + k))
    best = [F.max_by(F.struct("root", "x"), F.struct(c, F.col("x.shared"), chance(k))) for k, c in enumerate((F.col("main"), ~F.col("main")))]
    some = [F.max_by(F.struct("root", "x"), chance(k)) for k in (2, 3)]
    pivots = members.groupBy("g").agg(F.array_distinct(F.array(*best, *some)).alias("pivots"))
    return members.join(pivots, "g").select("root", "x", F.explode("pivots").alias("p")).where("root <> p.root").select("x", F.col("p.x").alias("y"))


def similar_documents(docs: DataFrame, *, rid: str, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (rid, root): classes of texts chained by a resemblance of ``similarity`` or more on ``shingle``-word shingles.

    ``rid`` must be unique.  Texts are first reduced to one per equal word sequence (128-bit digest of the whole
    sequence, the smallest ``rid`` stands for it).  Those with linked fingerprints are compared.  Any two sets of the
    resemblance meet in a posting: members of a posting are compared with a few of them in other classes, in large ones
    again with others while that finds many links and the exact search would not be linear.  This chains large groups of near
    copies.  Then every pair of a posting that is still in two classes is compared, unless sizes or places rule it out:
    members outside the posting's largest class with all others.  A pair left out is in one class already or below the
    resemblance, so the classes are those of all pairs.
    """
    with setting(docs.sparkSession, BATCH, str(ROWS)):
        return _similar_documents(docs, rid, text, shingle, similarity)


def _similar_documents(docs: DataFrame, rid: str, text: str, shingle: int, similarity: float) -> DataFrame:
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase), r"[\x20\x09-\x0D]+", " "))
    d = docs.select(F.col(rid).alias("rid"), F.col(text).alias("text"), F.unhex(F.md5(words)).alias("same"))
    prefixes = cut_lineage(_prefixes(d, shingle, similarity))  # texts are read here, and again only where sets are compared
    exact = cut_lineage(prefixes.select("rid", "same"))
    heads = cut_lineage(prefixes.groupBy("same").agg(F.min("rid").alias("rid"), F.min("fp").alias("fp")))
    only = cut_lineage(heads.select("rid"))
    rows = cut_lineage(_postings(among(prefixes, only, "rid")))
    # the part of its prefix that a text shares with others: near 1 in the middle of a group of near copies
    wanted = cut_lineage(rows.groupBy("rid").agg((F.count(F.lit(1)) / (F.first("n") + 1 - F.ceil(similarity * F.first("n") - SLACK))).alias("shared")))
    bits = cut_lineage(among(prefixes.select("rid", "n", "bits"), wanted.select("rid"), "rid"))
    release(prefixes, only)
    alike = _alike(_near_prints(heads), bits, d, shingle, similarity)
    for turn in range(ROUNDS + 1):
        met, apart = rows, _open_postings(rows, wanted, alike)
        release(met)
        rows = apart.select("g", "x.rid", "x.n", "x.pos")  # a posting in one class stays in one
        pool = apart if not turn else apart.where(F.col("members") > LARGE)
        size, work = pool.agg(F.count(F.lit(1)), F.sum("minor")).first()  # a posting's minor members once for each member
        if turn == ROUNDS or not size or (turn and work <= LARGE * size):
            break
        found = _alike(_pivot_pairs(pool, turn).where(_may_be_alike("x", "y", similarity)), bits, d, shingle, similarity)
        alike = alike.unionByName(found)
        if turn and found.count() * RARE < size:
            break
    # pairs still apart
    salted = apart.where("members > 2").select("g", "root", "x", "main", F.pmod(F.xxhash64("x.rid"), F.lit(SALTS)).cast("int").alias("salt"))
    minor = apart.where("members > 2 and not main").select("g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("root").alias("other"), F.col("x").alias("y"))
    pairs = salted.join(minor, ["g", "salt"]).where("root <> other").where("main or x.rid < y.rid").where(_may_be_alike("x", "y", similarity))
    alike = alike.unionByName(_alike(pairs, bits, d, shingle, similarity))
    release(bits, apart, wanted)
    # copies follow their head and take no part in the search for components, where a large group would be a hot node
    comp = components(alike)
    named = heads.join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("same", F.coalesce("root", "rid").alias("root"))
    return exact.join(named, "same").select("rid", "root")
