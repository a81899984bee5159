"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes ``len(NAMES)`` statistics: logarithms of counts and smoothed logits of shares, which are near enough
to normal for class covariances to describe them.  A class covariance is shrunk towards the pooled one and towards a
diagonal; its Cholesky factor is made once and reused for every row.  The score is the logistic of the difference of
Mahalanobis log densities plus the log prior.

Scale: every text is read once, into statistics of fixed width; classes are learned from sums of outer products, added up
in Spark, so all labelled rows count and the driver sees two matrices.

Defined cases: null and empty texts have statistics (all counts zero) and a score like any other; with no labelled row
of a class the score is the smoothed prior; labels that contradict each other are left out; repeated rows are scored
alike; empty tables stay empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage

NAMES = ("words", "word_length", "word_length_spread", "upper", "digits", "stops", "symbols", "marks", "bars", "newlines", "other_bytes",
         "distinct_words", "distinct_lines", "line_words", "entropy", "top_byte", "short_words", "marked_words")
_CLASS = np.full(256, 6, dtype=np.int64)  # symbols
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 3, 4, 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]], _CLASS[ord("!")], _CLASS[ord("|")] = 7, 8, 9


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    lower, upper, digit, _, newline, other, symbol, stop, mark, bar = np.bincount(_CLASS, weights=count, minlength=10)
    n, words, lines = len(b), b.split(), b.split(b"\n")
    long = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    nw = len(words)
    ink = count.copy()
    ink[[9, 10, 11, 12, 13, 32]] = 0
    total = max(1, ink.sum())
    share = ink[ink > 0] / total
    ends = sum(w[-1] in b"*%&$#!|" for w in words)
    return [
        np.log1p(nw), np.log((long.sum() + 4) / (nw + 1)), np.log1p(long.std()) if nw else 0.0, _logit(upper, lower + upper), _logit(digit, n),
        _logit(stop, n), _logit(symbol, n), _logit(mark, n), _logit(bar, n), _logit(newline, n), _logit(other, n),
        _logit(len(set(words)), nw), _logit(len(set(lines)), len(lines)), np.log1p(nw / len(lines)), float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
        _logit(ink.max(), total), _logit(int((long <= 3).sum()), nw), _logit(ends, nw),
    ]


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), make(F.col(text)).alias("x"))


@dataclass
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor, and log prior - half log determinant."""

    means: list[np.ndarray]
    inverses: list[np.ndarray]
    offsets: list[float]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = [o - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for m, inv, o in zip(self.means, self.inverses, self.offsets)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(moments: list[np.ndarray], to_pooled: float = 0.1, to_diagonal: float = 0.02) -> Discriminant:
    """From the sums of outer products of (1, x) of class 0 and class 1."""
    n = [m[0, 0] for m in moments]
    if min(n) < 2:
        return Discriminant([], [], [], constant=float((n[1] + 1) / (sum(n) + 2)))
    means = [m[0, 1:] / m[0, 0] for m in moments]
    scatter = [m[1:, 1:] - k * np.outer(mu, mu) for m, k, mu in zip(moments, n, means)]
    pooled = sum(scatter) / sum(n)
    out = Discriminant(means, [], [])
    for s, k in zip(scatter, n):
        cov = (1 - to_pooled) * s / k + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        out.inverses.append(np.linalg.inv(factor))
        out.offsets.append(float(np.log(k / sum(n)) - np.log(np.diag(factor)).sum()))
    return out


def class_moments(labelled: DataFrame, width: int) -> list[np.ndarray]:
    """Sums of outer products of (1, x) per class; ``labelled`` has y and x."""
    side = width + 1

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, side, side))
        for pdf in batches:
            for y in (0, 1):
                rows = pdf["x"][pdf["y"] == y]
                if len(rows):
                    x = np.column_stack([np.ones(len(rows)), np.vstack(rows.to_numpy())])
                    total[y] += x.T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "s": total.ravel()})

    sums = labelled.select("y", "x").mapInPandas(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    total = np.zeros(2 * side * side)
    for r in sums.collect():  # 2 * side * side rows
        total[r["at"]] = r["s"]
    return list(total.reshape(2, side, side))


def score_documents(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score) for all of ``docs``; ``labels`` has (doc_id, y) of the rows to learn from."""
    stats = cut_lineage(document_statistics(docs, doc_id, text))
    model = fit(class_moments(stats.join(labels, "doc_id"), len(NAMES)))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(x.to_numpy())) if len(x) else [], dtype="float64")

    return stats.select("doc_id", score("x").alias("score"))
