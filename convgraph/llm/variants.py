"""Spelling variants: words of a vocabulary one code point apart, and the frequent form that each stands for.

Two words are near if one inserted, deleted or replaced code point makes one the other.  The search is that of
``fmindex``: one half of the word agrees exactly, the error is sought in the other with suffix-rank intervals.  Spark
brings together what can be near: an indexed word of length L lies in one shard for the scheme that matches left halves
(by L and its first p(L) code points) and in one for the other scheme (by L and its last p(L)); p(L) is the least half of
any word it can be near to.  A word asks at the keys of lengths L-1, L and L+1.  So every near pair meets in exactly one
shard of one of the two schemes, and is counted once.

A word's form is its near word of largest count (ties: smallest in code-point order), if that count is at least ``ratio``
times its own; its root is the last word reached by following forms.  Counts rise with every step, so there are no cycles.

Defined cases: null texts give no words; a null document id alters no word; repeated rows count again; an empty table or
vocabulary gives no rows.  Texts are read whole.  Only the named columns are read, so others may have any name.

Scale: words are counted with map-side combining.  A shard holds about ``SHARD`` indexed words, and their number follows
the vocabulary.  A key with more than ``SPLIT`` words is cut by a hash of the word and its queries are sent to all its
cuts.  A task returns one row per query (number of near words and the best), never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage
from convgraph.llm.fmindex import WordIndex

#: Letters that words are made of (fixed by the contract).
RUN = r"[A-Za-zÀ-ÿ]+"
SHARD = 20_000
SPLIT = 2_000


def runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, run): every maximal run of letters, A-Z lower-cased."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))


def lose_a_letter(run: Column, doc_id: Column, every: int = 199) -> Column:
    """The run, without one code point where ``every`` divides the CRC-32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words of enough code points that occur often enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _key(forward: bool, word: Column, of_length: Column, min_length: int) -> Column:
    """Shard key at which a word of ``of_length`` is indexed, cut from ``word``."""
    p = F.greatest(F.lit(1), F.floor((of_length - 1) / 2), F.lit(min_length // 2)).cast("int")
    piece = F.substr(word, F.lit(1), p) if forward else F.substr(word, F.length(word) - p + 1, p)
    return F.xxhash64(F.lit(forward), of_length, piece)


def _answers(word, n_near, best_n, best) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(word, dtype=object), "n_near": np.asarray(n_near, dtype=np.int64),
                         "best_n": np.asarray(best_n, dtype=np.int64), "best": pd.Series(best, dtype=object)})


def _search(forward: bool):
    def search(shard: pd.DataFrame) -> pd.DataFrame:
        indexed = shard[shard["n"].notna()].sort_values("word")  # Python compares strings by code points
        queries = shard.loc[shard["n"].isna(), "word"].drop_duplicates().tolist()
        if indexed.empty or not queries:
            return _answers([], [], [], [])
        words, n = indexed["word"].tolist(), indexed["n"].to_numpy(dtype=np.int64)
        q, w = WordIndex(words).neighbours(queries, forward)
        order = np.lexsort((w, -n[w], q))
        q, w = q[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.concatenate((first, [len(q)])))
        return _answers([queries[k] for k in q[first]], count, n[w[first]], [words[k] for k in w[first]])

    return search


def near_words(vocab: DataFrame, min_length: int = 6) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a near one; ``vocab`` holds distinct words of min_length or more."""
    shards = max(1, math.ceil(vocab.count() / SHARD))
    length = F.length("word")
    found = None
    for forward in (True, False):
        index = vocab.select("word", "n", _key(forward, F.col("word"), length, min_length).alias("key"))
        lengths = F.filter(F.array(length - 1, length, length + 1), lambda x: x >= min_length)
        asked = vocab.select("word", F.explode(lengths).alias("of")).select("word", _key(forward, F.col("word"), F.col("of"), min_length).alias("key"))
        cuts = index.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("cuts"))
        hot = cuts.where("cuts > 1")  # at most one key for SPLIT words
        index = index.join(hot, "key", "left").withColumn("cut", F.pmod(F.xxhash64("word"), F.coalesce("cuts", F.lit(1))).cast("int"))
        asked = asked.join(hot, "key", "left").withColumn("cut", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)))
        rows = index.select("key", "cut", "word", "n").unionByName(asked.select("key", "cut", "word", F.lit(None).cast("bigint").alias("n")))
        rows = rows.select(F.pmod(F.xxhash64("key", "cut"), F.lit(shards)).alias("shard"), "word", "n")
        got = rows.groupBy("shard").applyInPandas(_search(forward), "word string, n_near bigint, best_n bigint, best string")
        found = got if found is None else found.unionByName(got)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root): the last word reached from ``links`` (word, form), which hold no cycle; each round doubles the steps."""
    at = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return at


def group_variants(vocab: DataFrame, ratio: int = 5, min_length: int = 6) -> DataFrame:
    """Per word of ``vocab`` (word, n): form, root, n_near, form_n."""
    v = cut_lineage(vocab.select("word", "n"))
    near = v.join(near_words(v, min_length), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    near = cut_lineage(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"),
                                   F.when(good, F.col("best_n")).alias("form_n")))
    roots = follow(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, every: int = 199, min_length: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """Variants among the words of whole texts, some of which lose a letter first."""
    long = runs(docs).where(F.length("run") >= min_length)  # losing a letter makes no run longer
    words = long.select(lose_a_letter(F.col("run"), F.col("doc_id"), every).alias("word"))
    return group_variants(vocabulary(words, min_length, min_count), ratio, min_length)
