"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below one fixed fraction of the hash range, whatever the length of the text, so its size
follows the text's, sketches of parts merge by union, and the containment of a small text in a large one can be estimated
as well as that of equals.  What is kept of a hash is ``BITS`` other bits of it, six hexadecimal digits in the printed
fingerprint, about a twelfth of the text's length.  Likeness is computed from two sketches and nothing else: the share of
the smaller one that the larger one has.  For texts with n shingles in common range the estimate of a containment c has a
standard error of about sqrt(c (1 - c) / (FRACTION n)): 0.09 for 400 words at c = 1/2, and a text of few words often has an
empty sketch.

All of it is column expressions: hashes of words, then of runs of ``SHINGLE`` word hashes (63 bits).

Scale: a sketch is made in its row.  ``next_rows`` finds each row's successor in a global order with one shuffle: ranges
of the order key are cut at approximate quantiles, which are values of the key; the row that ends a range is also sent
to the range before it, so no range depends on another and no single task sees the whole order.

Defined cases: null text counts as empty; two empty sketches are alike (1), an empty and another are not (0); fewer words
than a shingle give one hash of them all; texts may be of any length; rows with equal ids follow each other in the order of their texts' hashes and
texts; null ids come last; a single row is its own successor; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convgraph.functions.lineage import cut_lineage

SHINGLE, FRACTION, BITS = 5, 1 / 12, 24
ROWS_PER_RANGE, MAX_RANGES = 512, 1 << 16
SPACE = " \t\n\x0b\x0c\r"


def with_hashes(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Add all distinct shingle hashes of column ``text``."""
    trimmed = F.lower(F.call_function("btrim", F.coalesce(F.col(text), F.lit("")), F.lit(SPACE)))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    last = F.greatest(F.size("_w") - (shingle - 1), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice("_w", i, F.lit(shingle))), 1))
    return df.withColumn(out, F.array_distinct(F.when(F.size("_w") > 0, runs).otherwise(F.array().cast("array<bigint>")))).drop("_w")


def sketch_of(hashes: Column, fraction: float = FRACTION) -> Column:
    """Sketch of a set of hashes: BITS low bits of those below the limit, sorted and distinct."""
    kept = F.filter(hashes, lambda h: h < F.lit(int(fraction * 2**63)))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1)))))


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Add the sketch of column ``text``."""
    return with_hashes(df, text, "_all", shingle).withColumn(out, sketch_of(F.col("_all"), fraction)).drop("_all")


def as_string(sketch: Column) -> Column:
    """Six hex digits per value, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), "")


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that are in ``b``; an empty sketch is contained in an empty one only."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise((F.size(b) == 0).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger; of two empty ones 1, of an empty and another one 0."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def next_rows(df: DataFrame, key: str, ties: list[Column], columns: list[str]) -> DataFrame:
    """Add ``next_<column>``: the values of the row that follows in descending ``key``; after the last comes the first."""
    df = df.withColumn("_key", F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63))))
    n = df.count()
    ranges = max(1, min(MAX_RANGES, math.ceil(n / ROWS_PER_RANGE)))
    points = [k / ranges for k in range(1, ranges)] or [0.5]
    ends = df.agg(F.percentile_approx("_key", points, max(10_000, 20 * ranges)).alias("p"), F.max("_key").alias("m"))
    ends = cut_lineage(ends.select(F.sort_array(F.array_distinct(F.concat("p", F.array("m")))).alias("ends")))
    count = ends.select(F.size("ends")).first()[0] if n else 1  # ranges really there
    at = ends.scalar()

    def halve(lo: Column, k: Column) -> Column:
        probe = lo + F.call_function("shiftleft", F.lit(1), k)
        return F.when((probe <= count) & (F.try_element_at(F.col("_ends"), F.least(probe, F.lit(count))) < F.col("_key")), probe).otherwise(lo)

    steps = F.sequence(F.lit(count.bit_length() - 1), F.lit(0), F.lit(-1))
    df = df.withColumn("_ends", at).withColumn("_range", F.aggregate(steps, F.lit(0), halve))
    closes = F.try_element_at(F.col("_ends"), F.col("_range") + 1) == F.col("_key")  # the range's last key in ascending order
    places = F.when(closes, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("ahead")), F.struct(F.pmod(F.col("_range") + 1, F.lit(count)).alias("r"), F.lit(1).alias("ahead"))))
    places = places.otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("ahead"))))
    df = df.withColumn("_p", F.explode(places)).withColumn("_r", F.col("_p.r")).withColumn("_ahead", F.col("_p.ahead")).drop("_ends", "_range", "_p")
    w = Window.partitionBy("_r").orderBy("_ahead", F.col("_key").desc(), *ties)
    df = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return df.where("_ahead = 0").drop("_r", "_ahead", "_key")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's sketch, an edited text's, the next document's, and the likeness of the two latter to the first.

    Columns: doc_id, n_chars, edited, sketch, edited_sketch, next_sketch, near_edited, near_next.  The edited text has
    the last half of the code points replaced by the first as many of the next document.  Only texts are moved to the
    neighbour; sketches are made and compared in the row.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = next_rows(d, "doc_id", [F.xxhash64("text"), F.col("text")], ["text"])
    d = d.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("_half"))
    d = d.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), F.col("_half"))))
    for source, out in (("text", "sketch"), ("edited", "edited_sketch"), ("next_text", "next_sketch")):
        d = with_sketch(d, source, out)
    return d.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch", likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                    likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
