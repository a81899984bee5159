"""Paired and clustered resampling by weights: every unit gets its number of draws where it lies.

The units of a group are cut into blocks of BLOCK consecutive positions.  The number of draws of a resample that fall into
a block is found by halving the draws down a tree over the blocks, each halving a binomial taken from hashes of (resample,
node); so a block's task knows its draws without seeing the other blocks.  Within the block the draws are counted per unit,
and the weights times the values are the block's share of the resample's sums.  Nothing is joined or broadcast, and one
exchange adds up blocks: groups x resamples rows of sums.

Positions, hashes and halvings are fixed integer functions (and correctly rounded operations on doubles), so a result does
not depend on the engine, the partitioning or a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convgraph.functions.lineage import cut_lineage
from convgraph.functions.splitwin import split_row_number

# Fixed values of the draw function.
MODULUS = 2147483647
BLOCK = 4096
POSITION_SPLITS = 64
# Resamples of one block that a task row stands for; a block's values are sent once for each.
RESAMPLES = 1000


def seed_column(seed: int, *parts: Column) -> Column:
    """A seed pinned to the parts that name a comparison."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % MODULUS


def number_units(values: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """Adds the position ``_i`` of each unit in its group and the group size ``_n``."""
    spread = F.pmod(F.col(unit) if dict(values.dtypes)[unit] == "bigint" else F.crc32(F.col(unit).cast("binary")),
                    F.lit(POSITION_SPLITS)).cast("bigint")
    out = split_row_number(values, by, spread, [F.col(unit)], "_i", "_n")
    return out.withColumn("_i", F.col("_i") - 1)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo MODULUS (2^31 - 1) for 0 <= x < 2^63, by folding its bits."""
    x = (x & MODULUS) + (x >> 31)
    x = (x & MODULUS) + (x >> 31)
    return np.where(x >= MODULUS, x - MODULUS, x)


def _halved(draws: np.ndarray, u2: np.ndarray, start: int, size: int, left: int, units: int) -> np.ndarray:
    """How many of the draws in a node of ``units`` units fall into its first ``left`` ones: a binomial count, from the sum
    of twelve hashes as a standard normal deviate (blocks are large, so the normal form is close)."""
    base = _mod(u2 + start * 69621 + size * 16807 + 7)
    total = np.zeros(len(draws), dtype=np.int64)
    for t in range(1, 13):
        w = _mod(base * 48271 + t * 69621)
        w = _mod(w * w + base)
        total += _mod(w * w + t)
    z = total / float(MODULUS) - 6.0
    mean = draws * float(left) / float(units)
    count = np.floor(mean + np.sqrt(mean * float(units - left) / float(units)) * z + 0.5)
    return np.clip(count, 0, draws).astype(np.int64)


def block_draws(b: np.ndarray, n: int, seed: int, block: int) -> np.ndarray:
    """Draws that fall into ``block`` in the resamples ``b`` of a group of ``n`` units; over all blocks they add up to n."""
    u = _mod(b * 48271 + seed)
    u2 = _mod(u * u)
    draws, start, size = np.full(len(b), n, dtype=np.int64), 0, -(-n // BLOCK)
    while size > 1:
        units = min(n, (start + size) * BLOCK) - start * BLOCK
        half = size // 2
        left = _halved(draws, u2, start, size, half * BLOCK, units)
        if block < start + half:
            draws, size = left, half
        else:
            draws, start, size = draws - left, start + half, size - half
    return draws


def _fold(x: np.ndarray, t: np.ndarray) -> None:
    """Adds the bits of unsigned 64-bit ``x`` above the 31st to those below in place, keeping it modulo MODULUS; ``t`` is room
    of the same shape.  Once brings it below 2^34, twice near 2^31."""
    np.right_shift(x, 31, out=t)
    np.bitwise_and(x, MODULUS, out=x)
    np.add(x, t, out=x)


def _places(first: np.ndarray, second: np.ndarray, draws: int, size: int, room: Sequence[np.ndarray] | None = None) -> np.ndarray:
    """Place in the block of each draw (columns) of each resample (rows), from the resample's two keys (``second`` below 2^29).

    The first key and a draw's step stay below 2^31.5 for up to 2 * BLOCK draws, so once folded, their square is below 2^33.
    Lowered by MODULUS it is within 2^32 of zero if ``draws`` is at most 5,000, and its square fits into 64 bits; beyond
    that, it is folded a second time.  ``room``: two arrays to
    work in, of which the first then holds the places.
    """
    shape = (len(first), draws)
    w, t = (x[:shape[0] * draws].reshape(shape) for x in room or [np.empty(shape[0] * draws, dtype=np.uint64) for _ in range(2)])
    np.add(first[:, None], np.arange(draws, dtype=np.uint64)[None, :] * np.uint64(69621), out=w)
    np.multiply(w, w, out=w)
    _fold(w, t)
    if draws > 5000:
        _fold(w, t)
        w += second[:, None]
    else:
        w += (second - np.uint64(MODULUS))[:, None]  # wraps around, as does the square
    np.multiply(w, w, out=w)
    _fold(w, t)
    # the second folding leaves at most 6 above MODULUS; cut to 31 bits, these lie at place 0 as they should, and MODULUS
    # itself, which stands for 0, is seldom met
    np.right_shift(w, 31, out=t)
    np.add(w, t, out=w)
    np.bitwise_and(w, MODULUS, out=w)
    if w.size and w.max() == MODULUS:
        w[w == MODULUS] = 0
    if size & (size - 1):
        np.multiply(w, size, out=w)
        np.right_shift(w, 31, out=w)
    else:
        np.right_shift(w, 32 - size.bit_length(), out=w)
    return w


def _keys(b: np.ndarray, seed: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The two keys of each resample in a block."""
    u = _mod(b * 48271 + seed)
    u2 = _mod(u * u)
    e = _mod(u2 + block * 16807 + 12345)
    first = _mod(e * e + u)
    return first.astype(np.uint64), (_mod(first * 69621 + u2) // 4).astype(np.uint64)


def _block_places(first: np.ndarray, second: np.ndarray, draws: np.ndarray, size: int, room: Sequence[np.ndarray] | None = None) -> np.ndarray:
    """Places of all draws, one row per resample, with as many columns as the one with most draws has; those that another
    lacks lie beside the block's units, at ``size``."""
    at = _places(first, second, int(draws.max()), size, room).view(np.int64)
    for k, d in enumerate(draws.tolist()):
        at[k, d:] = size
    return at


def _weights(at: np.ndarray, size: int) -> np.ndarray:
    """How often each place occurs in each row; ``at`` is used up."""
    wide = size + 1
    at += (np.arange(len(at), dtype=np.int64) * wide)[:, None]
    return np.bincount(at.ravel(), minlength=len(at) * wide).reshape(len(at), wide)[:, :size]


def block_weights(b: np.ndarray, n: int, seed: int, block: int) -> np.ndarray:
    """How often each unit of the block is drawn, one row per resample of ``b``."""
    size = min(n - block * BLOCK, BLOCK)
    return _weights(_block_places(*_keys(b, seed, block), block_draws(b, n, seed, block), size), size)


def block_totals(values: np.ndarray, b: np.ndarray, n: int, seed: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the drawn units (one row per resample of ``b``) of each column of ``values`` (one row per unit of the block),
    and the numbers of draws that have a value."""
    size, width = values.shape
    draws = block_draws(b, n, seed, block)
    first, second = _keys(b, seed, block)
    known = ~np.isnan(values)
    whole = bool(known.all())  # then every draw has a value
    sparse = known.mean() < 0.5
    sums, counts = np.empty((len(b), width)), np.empty((len(b), width))
    if whole:
        counts[:] = draws[:, None]
    step, most = max(1, (1 << 15) // size), int(draws.max())  # so many draws stay in a core's cache
    room = [np.empty(step * most, dtype=np.uint64) for _ in range(2)]
    if whole and width == 1:  # the drawn values themselves are added up
        padded, drawn = np.append(values[:, 0], 0.0), np.empty(step * most)
    elif sparse:  # each column from the units that have it, brought side by side
        column, order = np.nonzero(known.T)
        own, ends = values[order, column], np.searchsorted(column, np.arange(width + 1))
    else:
        both = np.ascontiguousarray((values if whole else np.concatenate([np.where(known, values, 0.0), known], axis=1)).T)
    for i in range(0, len(b), step):
        part = slice(i, i + step)
        at = _block_places(first[part], second[part], draws[part], size, room)
        if whole and width == 1:
            x = drawn[:at.size].reshape(at.shape)
            np.take(padded, at, out=x, mode="clip")  # this mode needs no copy; all places are valid
            x.sum(axis=1, out=sums[part, 0])
            continue
        weights = _weights(at, size)
        # einsum, unlike a matrix product, starts no threads of its own beside Spark's tasks
        if sparse:
            w = np.take(weights, order, axis=1, mode="clip").astype(np.float64)
            for k in range(width):
                x = w[:, ends[k]:ends[k + 1]]
                sums[part, k] = np.einsum("ij,j->i", x, own[ends[k]:ends[k + 1]])
                counts[part, k] = x.sum(axis=1)
        else:
            x = np.einsum("ij,kj->ik", weights.astype(np.float64), both)
            sums[part] = x[:, :width]
            if not whole:
                counts[part] = x[:, width:]
    return sums, counts


def _block_sums(by: Sequence[str], width: int, n_boot: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                values = np.asarray(row["_values"], dtype=np.float64).reshape(-1, width)
                b = np.arange(row["_first"], min(row["_first"] + RESAMPLES, n_boot), dtype=np.int64)
                sums, counts = block_totals(values, b, row["_n"], row["_seed"], row["_c"])
                out = pd.DataFrame({c: [row[c]] * len(b) for c in by})
                out["_b"] = b.astype(np.int32)
                for k in range(width):
                    out[f"_s{k}"] = sums[:, k]
                    out[f"_k{k}"] = counts[:, k]
                yield out

    return run


def resample(values: DataFrame, by: Sequence[str], unit: str, data: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """One row per group and resample ``_b``: for every column of ``data`` its sum over the drawn units, ``s_<column>``, and
    the number of draws that have a value, ``k_<column>``.

    ``values`` holds one row per (group, unit).  A block of units is one row, and its resamples are dealt to tasks in runs.
    """
    by, data = list(by), list(data)
    numbered = number_units(values, by, unit).select(*by, "_i", "_n", F.array(*[F.col(c).cast("double") for c in data]).alias("_v"))
    blocks = numbered.groupBy(*by, F.floor(F.col("_i") / BLOCK).alias("_c")).agg(
        F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_rows"))
    blocks = cut_lineage(blocks.select(*by, "_c", "_n", seed_column(seed, *[F.col(c) for c in by]).alias("_seed"), F.flatten("_rows._v").alias("_values")))
    tasks = max(8, values.sparkSession.sparkContext.defaultParallelism * 2)
    runs = blocks.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(RESAMPLES)))).repartition(tasks)
    types = {f.name: f.dataType for f in blocks.schema}
    schema = T.StructType([T.StructField(c, types[c]) for c in by] + [T.StructField("_b", T.IntegerType())] + [
        T.StructField(f"_{x}{k}", T.DoubleType()) for k in range(len(data)) for x in "sk"])
    sums = runs.mapInPandas(_block_sums(by, len(data), n_boot), schema)
    return sums.groupBy(*by, "_b").agg(*[F.sum(f"_{x}{k}").alias(f"{x}_{c}") for k, c in enumerate(data) for x in "sk"])


def mean_of(column: str) -> Column:
    """Mean over the draws that have a value."""
    return F.try_divide(F.col(f"s_{column}"), F.col(f"k_{column}"))


def interval(col: str, low: float = 0.025, high: float = 0.975) -> tuple[Column, Column]:
    """Percentile interval over resamples (at most the number of resamples per group)."""
    p = F.percentile(F.col(col), F.array(F.lit(low), F.lit(high)))
    return p[0].alias(f"{col}_low"), p[1].alias(f"{col}_high")


def bootstrap_mean(facts: DataFrame, by: Sequence[str], unit: str, metric: str, n_boot: int, seed: int) -> DataFrame:
    """Mean and percentile interval per group; no interval below two values."""
    v = cut_lineage(facts.where(F.col(metric).isNotNull()).select(*by, unit, F.col(metric).cast("double").alias("_m")))
    point = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_m").alias("mean"))
    r = resample(v, by, unit, ["_m"], n_boot, seed).withColumn("mean_b", mean_of("_m"))
    ci = r.groupBy(*by).agg(*interval("mean_b"))
    few = F.col("n") < 2
    return point.join(ci, list(by)).select(
        *by, "n", "mean", F.when(~few, F.col("mean_b_low")).alias("ci_low"),
        F.when(~few, F.col("mean_b_high")).alias("ci_high"))


def paired_values(
    facts: DataFrame,
    comparisons: Sequence[tuple[str, str]],
    metric: str = "checklist_score",
    tokens: str = "context_tokens",
    unit: str = "scenario_id",
    model: str = "model_key",
    pooled: str = "common",
    extra: Sequence[str] = (),
    min_pairs: int = 5,
    each: bool = True,
) -> DataFrame:
    """Pairs of every comparison: (model, *extra, a, b, unit, d, ta, tb, n_pairs).

    ``pooled``: ``none``, ``common`` (average within the unit over the models that
    scored both arms) or ``any`` (over whatever models there are).  Without ``each``
    there are pooled pairs only.
    """
    side = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("_arm"), F.lit(i).alias("_s"))
                     for a, b in comparisons for s, i in ((a, 0), (b, 1))])
    hit = facts.select(F.col(model).alias("_mk"), *extra, unit, F.col(metric).alias("_q"), F.col(tokens).alias("_t"),
                       F.explode(F.filter(side, lambda x: x["_arm"] == F.col("method_label"))).alias("_c"))
    flat = hit.select("_mk", *extra, unit, "_q", "_t", "_c.a", "_c.b", F.col("_c._s").alias("_s"))
    labels = [F.col("_mk")] if each else []
    if pooled == "any":
        labels.append(F.lit("pooled"))
    elif pooled == "common":
        flat = cut_lineage(flat)
        # a few rows per comparison, written so that the join knows its size
        ok = cut_lineage(flat.groupBy("a", "b", *extra, "_mk").agg(
            (F.max(F.when(F.col("_s") == 0, F.col("_q"))).isNotNull()
             & F.max(F.when(F.col("_s") == 1, F.col("_q"))).isNotNull()).alias("_ok")))
        flat = flat.join(ok, ["a", "b", *extra, "_mk"])
        labels.append(F.when(F.col("_ok"), F.lit("pooled")))
    flat = flat.withColumn("model", F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())))
    on = lambda s, c: F.avg(F.when(F.col("_s") == s, F.col(c)))
    pairs = flat.groupBy("model", *extra, "a", "b", unit).agg(
        on(0, "_q").alias("_qa"), on(1, "_q").alias("_qb"), on(0, "_t").alias("ta"), on(1, "_t").alias("tb"))
    pairs = pairs.where("_qa is not null and _qb is not null").select(
        "model", *extra, "a", "b", unit, (F.col("_qa") - F.col("_qb")).alias("d"), "ta", "tb")
    pairs = cut_lineage(pairs)
    # as many rows as the comparison table; written, so that its size is known
    size = cut_lineage(pairs.groupBy("model", *extra, "a", "b").agg(F.count(F.lit(1)).alias("n_pairs")))
    big_enough = size.where(F.col("n_pairs") >= min_pairs).select("model", *extra, "a", "b")
    return pairs.join(big_enough, ["model", *extra, "a", "b"], "left_semi")


def pooled_models(facts: DataFrame, comparisons: Sequence[tuple[str, str]], metric: str = "checklist_score",
                  model: str = "model_key") -> DataFrame:
    """Models that scored both arms, per comparison: (a, b, pooled_models, n_models)."""
    from convgraph.operators.facts import pair_arms

    have = facts.where(F.col(metric).isNotNull()).select(
        F.col(model).alias("_m"), "method_label", F.lit(1).alias("_x")).distinct()
    both = pair_arms(have, comparisons, ["_m"], ["_x"])
    return both.groupBy("a", "b").agg(
        F.array_join(F.sort_array(F.collect_set("_m")), ",").alias("pooled_models"), F.count(F.lit(1)).alias("n_models"))


def compare(pairs: DataFrame, unit: str, n_boot: int, seed: int, margin: float, extra: Sequence[str] = (), tokens: bool = True) -> DataFrame:
    """All comparisons in one job: difference, interval, non-inferiority, token ratio, the latter's interval only with ``tokens``."""
    by = ["model", *extra, "a", "b"]
    point = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("q_diff"),
        (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.avg(F.col("ta") - F.col("tb")).alias("tok_diff"), (F.avg("ta") / F.avg("tb")).alias("tok_ratio"))
    data = pairs.select(*by, unit, "d", *(["ta", "tb", (F.col("ta") - F.col("tb")).alias("td")] if tokens else []))
    r = resample(data, by, unit, data.columns[len(by) + 1:], n_boot, seed)
    extra_means = [mean_of("td").alias("tok_diff_b"), F.try_divide(mean_of("ta"), mean_of("tb")).alias("tok_ratio_b")] if tokens else []
    r = r.select(*by, F.round(mean_of("d"), 9).alias("q"), *extra_means)
    p = lambda c: F.percentile(F.col(c), F.array(F.lit(0.025), F.lit(0.975)))
    ci = r.groupBy(*by).agg(
        p("q").alias("_q"), F.avg(F.when(F.col("q") <= margin, 1.0).otherwise(0.0)).alias("p_noninferior"),
        *([p("tok_diff_b").alias("_d"), p("tok_ratio_b").alias("_r")] if tokens else []))
    ends = lambda c, name: [F.col(c)[0].alias(f"{name}_ci_low"), F.col(c)[1].alias(f"{name}_ci_high")] if tokens else []
    return point.join(ci, by).select(
        *by, "n", "q_diff", F.col("_q")[0].alias("q_ci_low"), F.col("_q")[1].alias("q_ci_high"), "se", "p_noninferior",
        (F.col("_q")[0] >= margin).alias("noninferior_ci"), "tok_diff", *ends("_d", "tok_diff"), "tok_ratio", *ends("_r", "tok_ratio"))


def retention(facts: DataFrame, arm: str, dag: str, full: str, n_boot: int, seed: int) -> DataFrame:
    """(arm - full) / (dag - full) per model, with interval; near-zero denominators drop out."""
    s = lambda lab: F.avg(F.when(F.col("method_label") == lab, F.col("checklist_score")))
    wide = facts.groupBy("model_key", "scenario_id").agg(s(arm).alias("c"), s(dag).alias("g"), s(full).alias("f"))
    v = cut_lineage(wide.where("c is not null and g is not null and f is not null").select(
        "model_key", "scenario_id", (F.col("c") - F.col("f")).alias("num"), (F.col("g") - F.col("f")).alias("den")))
    safe = lambda n, d: F.when(F.abs(d) > 1e-9, n / d)
    point = v.groupBy("model_key").agg(F.count(F.lit(1)).alias("n"), F.avg("num").alias("num"), F.avg("den").alias("den"))
    r = resample(v, ["model_key"], "scenario_id", ["num", "den"], n_boot, seed)
    r = r.select("model_key", mean_of("num").alias("num_b"), mean_of("den").alias("den_b")).withColumn("ratio_b", safe(F.col("num_b"), F.col("den_b")))
    ci = r.groupBy("model_key").agg(*interval("ratio_b"), *interval("den_b"))
    return point.join(ci, "model_key").select(
        F.col("model_key").alias("model"), "n", (100 * F.col("num")).alias("cand_minus_full_pp"),
        (100 * F.col("den")).alias("dag_minus_full_pp"), (100 * safe(F.col("num"), F.col("den"))).alias("retention_pct"),
        (100 * F.col("ratio_b_low")).alias("retention_ci_low"), (100 * F.col("ratio_b_high")).alias("retention_ci_high"),
        ((F.col("den_b_low") <= 0) & (F.col("den_b_high") >= 0)).alias("denominator_ci_spans_zero"))


def variance_parts(pairs: DataFrame, by: Sequence[str], unit: str, n_boot: int, seed: int) -> DataFrame:
    """Decoder and scenario variance from pairs of identical prompts (``diff``, ``score``)."""
    pairs = cut_lineage(pairs)
    parts = {"dec": F.var_samp("diff") / 2, "tot": F.var_samp("score")}
    point = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), parts["dec"].alias("dec"), parts["tot"].alias("tot"), F.avg("diff").alias("mean_diff"), F.avg("score").alias("mean_score"),
        F.count_if(F.col("diff") == 0).alias("identical_score_pairs"))
    # moments about the group's mean, which is near that of any resample
    about = point.select(*by, F.col("mean_diff").alias("_md"), F.col("mean_score").alias("_ms"))
    c = pairs.join(about, list(by)).select(*by, unit, (F.col("diff") - F.col("_md")).alias("d1"), (F.col("score") - F.col("_ms")).alias("s1"))
    r = resample(c.withColumns({"d2": F.col("d1") * F.col("d1"), "s2": F.col("s1") * F.col("s1")}), by, unit, ["d1", "d2", "s1", "s2"], n_boot, seed)

    def variance(x: str) -> Column:
        k, s1 = F.col(f"k_{x}1"), F.col(f"s_{x}1")
        return F.when(k > 1, F.greatest(F.lit(0.0), F.round((F.col(f"s_{x}2") - s1 * s1 / k) / (k - 1), 12)))

    r = r.select(*by, (variance("d") / 2).alias("dec_b"), variance("s").alias("tot_b"))
    r = r.withColumn("sc_b", F.col("tot_b") - F.col("dec_b")).withColumn(
        "share_b", F.try_divide(F.col("dec_b"), F.col("tot_b")))
    ci = r.groupBy(*by).agg(*interval("dec_b"), *interval("tot_b"), *interval("sc_b"), *interval("share_b"))
    return point.join(ci, list(by)).select(
        *by, "n_pairs", F.col("dec").alias("sigma2_decoder"), F.col("dec_b_low").alias("decoder_low"),
        F.col("dec_b_high").alias("decoder_high"), F.col("tot").alias("sigma2_total"),
        F.col("tot_b_low").alias("total_low"), F.col("tot_b_high").alias("total_high"),
        (F.col("tot") - F.col("dec")).alias("sigma2_scenario"), F.col("sc_b_low").alias("scenario_low"),
        F.col("sc_b_high").alias("scenario_high"), F.try_divide(F.col("dec"), F.col("tot")).alias("decoder_share"),
        F.col("share_b_low").alias("share_low"), F.col("share_b_high").alias("share_high"), "identical_score_pairs")


def contrast_errors(
    scores: DataFrame, contrasts: Mapping[str, tuple[str, str]], n_boot: int, seed: int, unit: str = "key"
) -> DataFrame:
    """Per judge and contrast: error against the reference, its standard error and interval.

    ``scores(judge, unit, method_label, ref_score, cand_score)``.  A resample in
    which any of the judge's methods is missing does not count; the standard
    error has ddof 0.
    """
    v = cut_lineage(scores.select("judge", unit, "method_label", (F.col("cand_score") - F.col("ref_score")).alias("e")))
    names = sorted({m for ab in contrasts.values() for m in ab})
    mean = {m: F.avg(F.when(F.col("method_label") == m, F.col("e"))) for m in names}
    have = F.count_distinct("method_label")
    err = F.array(*[F.struct(F.lit(c).alias("contrast"), (mean[a] - mean[b]).alias("err"))
                    for c, (a, b) in contrasts.items()])
    point = v.groupBy("judge").agg(err.alias("_e"), have.alias("_m")).select("judge", "_m", F.inline("_e"))
    # a method's values as a column of its own, null elsewhere
    wide = v.select("judge", unit, *[F.when(F.col("method_label") == m, F.col("e")).alias(f"m{k}") for k, m in enumerate(names)])
    r = resample(wide, ["judge"], unit, [f"m{k}" for k in range(len(names))], n_boot, seed)
    r = r.select("judge", F.map_from_arrays(F.array(*[F.lit(m) for m in names]), F.array(*[mean_of(f"m{k}") for k in range(len(names))])).alias("_by"))
    full = r.where(F.forall(F.map_values("_by"), lambda x: x.isNotNull()))
    per = full.select("judge", F.inline(F.array(*[
        F.struct(F.lit(c).alias("contrast"), (F.col("_by")[a] - F.col("_by")[b]).alias("e")) for c, (a, b) in contrasts.items()])))
    ci = per.groupBy("judge", "contrast").agg(
        F.count(F.lit(1)).alias("n_resamples"), F.stddev_pop("e").alias("se"), *interval("e"))
    return point.drop("_m").join(ci, ["judge", "contrast"]).select(
        "judge", "contrast", "err", "n_resamples", "se", F.col("e_low").alias("err_low"), F.col("e_high").alias("err_high"),
        ((F.col("e_low") > 0) | (F.col("e_high") < 0)).alias("excludes_zero"))
