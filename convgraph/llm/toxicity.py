"""Toxicity classifier with counterfactual regularisation.

A logistic model over the words of a text and their beginnings (which join inflected forms).  Besides the labels it is
fitted to counterfactuals: in labelled texts identity terms are swapped for other terms of their set and for nothing, and
a change of the score is penalised, so naming a group does not raise a score by itself.

Scale: features are counted by Spark over the learning sample; the ``MAX_FEATURES`` most telling ones are kept, and the
model is fitted on the driver to at most ``SAMPLE_ROWS`` labelled rows, chosen by the hash of their id.  Scoring reads
every text once, with a model of fixed size.

Defined cases: null and empty texts score by the intercept alone; without labels of both classes the score is the
smoothed prior; contradicting labels are left out; repeated rows are scored alike; empty tables stay empty; extra columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage

SAMPLE_ROWS, MAX_FEATURES, MIN_ROWS = 20_000, 4_000, 5
MIN_CHI = 15.0  # features whose class shares differ by less are taken for chance
PREFIXES = (4, 5, 6)
EDGE = ".,;:!?'\"()[]{}<>*%&$#|-_/\\+=~^`@"

#: Identity terms by set; terms of one set stand for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "sikhs", "atheists"),
    ("black", "white", "asian", "african", "latino", "hispanic", "european", "arab", "indigenous"),
    ("immigrant", "refugee", "foreigner", "migrant", "citizen"), ("immigrants", "refugees", "foreigners", "migrants", "citizens"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish", "polish"),
)


def words_of(text: str | None) -> set[str]:
    return {w.strip(EDGE) for w in set(text.lower().split())} - {""} if text else set()


def features_of(words: set[str]) -> set[str]:
    """The words and, marked by ^, their beginnings."""
    return words.union(*[{"^" + w[:n] for w in words if len(w) > n} for n in PREFIXES])


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def logits(self, texts: Sequence[str | None]) -> np.ndarray:
        known = self.vocabulary.keys()
        return np.array([self.bias + sum(self.weights[self.vocabulary[f]] for f in known & features_of(words_of(t))) for t in texts])

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, n, n1): rows of the sample with the feature, and those of class 1."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                n, n1 = Counter(), Counter()
                for t, y in zip(pdf["text"].iloc[at:at + 1000], pdf["y"].iloc[at:at + 1000]):
                    f = features_of(words_of(t))
                    n.update(f)
                    if y:
                        n1.update(f)
                yield pd.DataFrame({"feature": list(n), "n": list(n.values()), "n1": [n1[k] for k in n]})

    return sample.select("text", "y").mapInPandas(count, "feature string, n bigint, n1 bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def telling_features(counts: DataFrame, rows: int, ones: int, k: int) -> list[str]:
    """The ``k`` features whose class shares differ most by the chi-squared statistic (ties by name)."""
    a, n = F.col("n1").cast("double"), F.col("n").cast("double")
    gap = a * F.lit(float(rows)) - n * F.lit(float(ones))
    chi = gap * gap * F.lit(rows / (ones * (rows - ones))) / (n * (F.lit(float(rows)) - n + 1))
    top = counts.where((F.col("n") >= MIN_ROWS) & (chi >= MIN_CHI)).orderBy(chi.desc(), "feature").limit(k).select("feature")
    return [r.feature for r in top.collect()]  # at most k


def swapped(words: set[str], terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[set[str]]:
    """Variants of a text's words: each identity term swapped for the next of its set, and left out."""
    out = []
    for group in terms:
        for i, t in enumerate(group):
            if t in words:
                rest = words - {t}
                out += [rest | {group[(i + 1) % len(group)]}, rest]
    return out


def fit(rows: Sequence[tuple[np.ndarray, int]], pairs: Sequence[tuple[np.ndarray, np.ndarray]], width: int, *,
        ridge: float = 1e-5, fairness: float = 1.0, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss + ridge * |w|^2 + fairness * mean squared change of the logit over ``pairs``.

    ``rows`` are (feature positions, label), both classes weighing the same in sum; ``pairs`` are positions before and
    after a swap.
    """
    y = np.array([r[1] for r in rows], dtype=np.float64)
    c = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum()))
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col = np.concatenate([r[0] for r in rows] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
    p_at = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    p_col = np.concatenate([np.concatenate([a, b]) for a, b in pairs] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
    p_val = np.concatenate([np.concatenate([-np.ones(len(a)), np.ones(len(b))]) for a, b in pairs] or [np.zeros(0)])
    share = 1.0 / max(1, len(pairs))

    def gram(v: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = np.bincount(at, weights=v[col], minlength=len(y)) + b
        d = np.bincount(p_at, weights=p_val * v[p_col], minlength=len(pairs))
        return (np.bincount(col, weights=0.25 * (c * z)[at], minlength=width) + 2 * ridge * v
                + 2 * fairness * share * np.bincount(p_col, weights=p_val * d[p_at], minlength=width)), 0.25 * (c * z).sum()

    v, b = np.ones(width) / np.sqrt(width + 1), 1 / np.sqrt(width + 1)
    top = 1.0
    for _ in range(30):  # largest curvature, for the step size
        v, b = gram(v, b)
        top = float(np.sqrt((v * v).sum() + b * b)) or 1.0
        v, b = v / top, b / top
    w, bias, w0, bias0 = np.zeros(width), 0.0, np.zeros(width), 0.0
    for t in range(1, steps + 1):
        m = (t - 1) / (t + 2)
        u, ub = w + m * (w - w0), bias + m * (bias - bias0)
        z = np.clip(np.bincount(at, weights=u[col], minlength=len(y)) + ub, -500, 500)
        r = c * (1 / (1 + np.exp(-z)) - y)
        d = np.bincount(p_at, weights=p_val * u[p_col], minlength=len(pairs))
        g = np.bincount(col, weights=r[at], minlength=width) + 2 * ridge * u + 2 * fairness * share * np.bincount(p_col, weights=p_val * d[p_at], minlength=width)
        w0, bias0 = w, bias
        w, bias = u - g / (1.05 * top), ub - r.sum() / (1.05 * top)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS,
          identity_terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    chosen = cut_lineage(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "y"))
    # at most sample_rows rows of 16 bytes are broadcast
    sample = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # repeated ids may bring more rows than were chosen; one text per id keeps the bound
    sample = cut_lineage(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")))
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        p = (ones + 1) / (n + 2)
        return Model({}, np.zeros(0), float(np.log(p / (1 - p))))
    names = telling_features(feature_counts(sample), n, ones, MAX_FEATURES)
    terms = [t for g in identity_terms for t in g]
    names = list(dict.fromkeys([*names, *terms]))
    vocabulary = {f: i for i, f in enumerate(names)}

    def locate(words: set[str]) -> list[int]:
        return sorted(vocabulary[f] for f in vocabulary.keys() & features_of(words))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [words_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "at": [locate(w) for w in words], "swaps": [[locate(s) for s in swapped(w, identity_terms)] for w in words]})

    got = sample.select("text", "y").mapInPandas(encode, "y int, at array<int>, swaps array<array<int>>").collect()  # at most sample_rows
    rows = [(np.array(r["at"], dtype=np.int64), r["y"]) for r in got]
    pairs = [(x, np.array(s, dtype=np.int64)) for (x, _), r in zip(rows, got) for s in r["swaps"]]
    # terms that no labelled text has: a text with the term against the text without it
    held = set(itertools.chain.from_iterable(r["at"] for r in got))
    pairs += [(np.array(locate({t}), dtype=np.int64), np.zeros(0, dtype=np.int64)) for t in terms if vocabulary[t] not in held]
    w, bias = fit(rows, pairs, len(names))
    keep = np.flatnonzero(np.abs(w) > 1e-9)
    return Model({names[i]: k for k, i in enumerate(keep)}, w[keep], bias)


def score_documents(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", out: str = "score", **options) -> DataFrame:
    """All columns of ``docs`` and the score; ``labels`` has (doc_id, y) of the rows to learn from."""
    model = train(docs, labels, doc_id=doc_id, text=text, **options)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(texts)), dtype="float64")

    return docs.withColumn(out, score(F.col(text)))
