"""Packing token sequences by best-fit decreasing.

Overlong documents are cut into full windows.  The pieces left, with lengths 1 to window - 1, go in decreasing length
into the open window that they fill most tightly; a segment tree over remaining capacities finds it.  Only the number
of pieces of each length matters to best fit, so the driver packs the histogram (at most ``window`` numbers, whatever
the size of the corpus): pieces of one length move in groups between remaining capacities, and the result is a list of
moves that says which ranks of a length go to which windows.  Each piece then finds its window from its length and rank.

Scale: one pass over the texts makes the pieces; they carry what the caller asks for (by default their ids).  Ranks
inside a length are made in splits, so a length that holds a third of all pieces is spread.  The list of moves has at
most window * window / 2 rows by construction and is a few thousand in practice.

Defined cases: null and empty texts are the end id alone; repeated rows and repeated ids are separate documents; an
empty table packs into nothing; a document whose length is a multiple of the window has full windows only.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convgraph.functions.lineage import cut_lineage
from convgraph.llm.common import rank_in_class

BATCH_CHARS = 8_000_000  # characters encoded together, about; bounds a task's memory


class ByteBpe:
    """Ids of a byte-level BPE file.

    The distinct chunks between single spaces of many texts are encoded together, in one string, because no token of such
    a vocabulary crosses from one chunk into the next; the texts' ids are then gathered from them.  Texts where that does
    not hold (adjacent white space) are encoded whole; texts with the string of a special token go to the file's own
    library, as do all texts if the vocabulary's ids are not in the order of its merges.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._path, self._slow = path, None
        self._load = lambda: Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, vocab = _byte_chars(), spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in tok): i for tok, i in vocab.items() if tok not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.exact = all(vocab.get("".join(p)) == len(of) + k for k, p in enumerate(pairs))
        self._special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        self._crowded = re.compile(r"\s\s|^\s|\s$")
        # the split of byte-level BPE files that name no pattern of their own (fixed value)
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._length = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        for tok, i in ranks.items():
            self._length[i] = len(tok)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self._fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if not text:
            return np.zeros(0, dtype="<u4")
        if not self.exact or (self._special and self._special.search(text)):
            if self._slow is None:
                self._slow = self._load()
            return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self._ids(text)

    def by_chunks(self, text: str) -> bool:
        """Whether the text's ids are those of its chunks."""
        return bool(text) and self.exact and not (self._special and self._special.search(text)) and not self._crowded.search(text)

    def encode_together(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts for which ``by_chunks`` holds, each followed by ``end``, in one array; and the number of each."""
        chunks: list[str] = []
        ends = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            chunks += t.split(" ")
            chunks.append("")  # no chunk of such a text is empty: this one stands for the end
            ends[k] = len(chunks)
        code, distinct = pd.factorize(np.array(chunks, dtype=object))
        blank = int(code[-1])
        spaced = " " + " ".join([c for c in distinct if c])
        ids = self._ids(spaced)
        at = np.cumsum(self._length[ids]) - self._length[ids]  # first byte of each id
        begins = np.flatnonzero(np.frombuffer(spaced.encode(), dtype=np.uint8) == 32)
        start = np.insert(np.searchsorted(at, begins), blank, 0)
        count = np.insert(np.diff(np.append(np.searchsorted(at, begins), len(ids))), blank, 1)
        # the end, and the first chunks, which have no space before them
        firsts, first_code = list(dict.fromkeys(t.partition(" ")[0] for t in texts)), {}
        pool = [ids, np.array([end], dtype="<u4")]
        start[blank] = len(ids)
        size, starts, counts = len(ids) + 1, [], []
        for c in firsts:
            first_code[c] = len(distinct) + len(starts)
            pool.append(self._ids(c))
            starts.append(size)
            counts.append(len(pool[-1]))
            size += counts[-1]
        start, count, ids = np.concatenate([start, starts]).astype(np.int64), np.concatenate([count, counts]).astype(np.int64), np.concatenate(pool)
        begin = ends - np.diff(np.concatenate(([0], ends)))
        code[begin] = [first_code[t.partition(" ")[0]] for t in texts]
        n = count[code]
        place = np.cumsum(n) - n
        return ids[np.repeat(start[code] - place, n) + np.arange(int(n.sum()))], np.add.reduceat(n, begin)


@functools.cache
def _byte_chars() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary of 50,257 ids that comes with the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, ids): the windows of each document's ids; ids as 32-bit little-endian binary."""

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "doc_tokens")] + [T.StructField("ids", T.BinaryType())])

    def windows(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """The pieces of documents whose ids follow each other; the ids' bytes are shared, not copied per piece."""
        n = -(-counts // window)
        row = np.repeat(np.arange(len(counts)), n)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
        length = np.minimum(window, counts[row] - start)
        cuts = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(ids))])
        cols = [doc_ids.take(pa.array(row)), pa.array(start), pa.array(length), pa.array(counts[row]), binary]
        return pa.RecordBatch.from_arrays(cols, schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = tokenizer(path), np.array([end_id], dtype="<u4")
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                together, apart, chars = [], [], 0
                while at < len(texts) and chars < BATCH_CHARS:
                    chars += len(texts[at] or "") + 1
                    (together if texts[at] and bpe.by_chunks(texts[at]) else apart).append(at)
                    at += 1
                if together:
                    yield windows(keys.take(pa.array(together)), *bpe.encode_together([texts[k] for k in together], end_id))
                if apart:
                    ids = [np.concatenate([bpe.encode(texts[k] or ""), end]) for k in apart]
                    yield windows(keys.take(pa.array(apart)), np.concatenate(ids), np.array([len(x) for x in ids], dtype=np.int64))

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; finds the smallest open one that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, value: bool) -> None:
        i = capacity + self.size
        self.open[i] = value
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        while not self.open[i]:
            while i & 1:  # a right child: go up until there is a right neighbour
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: Mapping[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``counts`` pieces per length; moves (length, first rank, pieces, first window, pieces per window, offset).

    Piece ``first rank + i`` goes to window ``first window + i // per`` at ``offset + (i % per) * length``.  Gives what
    best fit would give piece by piece: in the tightest window of remaining capacity r, r // length equal pieces follow
    each other, because no other window is tighter.
    """
    tree = CapacityTree(window)
    open_: dict[int, list[tuple[int, int]]] = {}
    moves, used = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                r, first, n = window, used, -(-left // (window // length))
                used += n
            else:
                first, n = open_[r].pop()
                if not open_[r]:
                    tree.set(r, False)
            per = r // length
            full = min(n, left // per)
            if full:
                moves.append((length, rank, full * per, first, per, window - r))
                put(r - per * length, first, full)
            elif left:
                full = 1
                moves.append((length, rank, left, first, left, window - r))
                put(r - left * length, first, 1)
                per = left
            done = full * per
            rank, left = rank + done, left - done
            if n > full:
                if r == window:  # windows reserved for the rest of this length
                    used -= n - full
                else:
                    put(r, first + full, n - full)
    return moves


def pack(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0,
         carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, and what ``carry`` makes of each piece (by default its ``ids``)."""
    carry = {"ids": F.col("ids")} if carry is None else carry
    cut = pieces(docs, path, doc_id=doc_id, text=text, window=window, end_id=end_id)
    cut = cut_lineage(cut.select("doc_id", "start", "length", "doc_tokens", *[c.alias(k) for k, c in carry.items()]))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    moves = np.array(sorted(best_fit_decreasing(counts, window)), dtype=np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(moves)  # bounded by window * window / 2 rows
    big = max(counts.values(), default=0) + 1

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        m = shared.value
        at = np.searchsorted(m[:, 0] * big + m[:, 1], length.to_numpy() * big + rank.to_numpy(), side="right") - 1
        i = rank.to_numpy() - m[at, 1]
        return pd.DataFrame({"sequence_id": m[at, 3] + i // m[at, 4], "offset": m[at, 5] + (i % m[at, 4]) * m[at, 0]})

    ranked = rank_in_class(cut, ["length"], F.xxhash64("doc_id", "start", "doc_tokens"), sum(counts.values()), ties=[F.col("doc_id"), F.col("start")])
    placed = ranked.withColumn("_at", place("length", "rank"))
    return placed.select("doc_id", "start", "length", "doc_tokens", "_at.sequence_id", "_at.offset", *carry)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences: (sequence_id, ids, length), ids concatenated in order of offset; one bounded group per sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
