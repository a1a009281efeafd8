"""Cluster bootstrap intervals and paired tests.

A draw is `hash(seed, key, draw, slot) mod number-of-clusters`, so it is the same on every engine and
partitioning, and the two runs of a paired test share their draws.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigeval.functions.columns import as_col, ratio
from sigeval.functions.hashing import numbered_seeds
from sigeval.functions.pvalues import mcnemar_exact, normal_two_sided
from sigeval.operators.metrics import auc_aggregate, rate_columns, score_points
from sigeval.operators.ordering import EVERY, cut_points, ordered_totals, row_index, with_range
from sigeval.session import stage

ROWS_PER_SALT = 65536
CHUNK = 64  # draws that share a join key, at most
SLOTS_OF_TASK = 1 << 14  # slots whose picks are hashed at once
SLOTS_OF_PART = 1 << 15  # slots whose picks are counted at once


# ---------------------------------------------------------------- draws
def _width(n_boot: int) -> int:
    """Draws of a chunk: at most CHUNK, and no more than needed to deal n_boot draws over as few chunks."""
    return -(-n_boot // -(-n_boot // CHUNK))


def _chunks(n_boot: int) -> Column:
    """Numbers of the draw chunks, as rows. A chunk is part of every join key, so a small table or a large
    cluster with many draws still spreads over all tasks."""
    return F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // _width(n_boot))))


def multiplicities(df: DataFrame, keys: Sequence[str], cluster: str, n_boot: int, seed: int, every: int = EVERY) -> DataFrame:
    """(keys, cluster, chunk, m): array of how often each draw of a chunk picked a cluster, for the clusters it picked.

    As many slots as there are clusters are filled with replacement for each draw. Callers that resample the same
    clusters more than once stage the result and pass it on.
    """
    keys, width = list(keys), _width(n_boot)
    # numbering reads the cluster list several times, so it is written once
    names = stage(df.select(*keys, cluster).distinct())
    clusters = row_index(names, keys, [cluster], "slot", every)
    last = F.floor((F.col("_g") - 1) / SLOTS_OF_TASK).cast("int")
    prefix = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])  # as in stable_seed
    blocks = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g"))
    blocks = blocks.select(*keys, "_g", prefix.alias("_prefix"), F.explode(F.sequence(F.lit(0), last)).alias("_block"))
    # a fixed number of partitions: these few small rows stand for many hashes each, and AQE would merge them by size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.select("*", _chunks(n_boot).alias("chunk")).repartition(tasks, *keys, "_block", "chunk")
    types = dict(df.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in keys)
    picks = blocks.mapInPandas(_picks(keys, width, n_boot), f"{head}chunk int, _part int, n int, gaps binary")
    counts = picks.repartition(tasks, *keys, "chunk", "_part").groupBy(*keys, "chunk", "_part").applyInArrow(
        _picked(keys, width), f"{head}chunk int, slot long, m array<tinyint>"
    )
    # the estimate for counts is the size of the few rows they came from, for which they would be broadcast
    return counts.hint("merge").join(clusters, [*keys, "slot"]).select(*keys, cluster, "chunk", "m")


def _picks(keys: Sequence[str], width: int, n_boot: int):
    """The picks that a block of slots makes in the draws of a chunk, one row per SLOTS_OF_PART picked slots.

    A pick is the number `slot * width + draw of the chunk` within its part; sorted picks leave as gaps of one, two or four bytes.
    """

    def rows(r: dict):
        first, g, span = r["_block"] * SLOTS_OF_TASK, int(r["_g"]), SLOTS_OF_PART * width
        draws = range(r["chunk"] * width, min((r["chunk"] + 1) * width, n_boot))
        seeds = [numbered_seeds(f"{r['_prefix']}|{b}|".encode(), first, min(first + SLOTS_OF_TASK, g) - 1) for b in draws]
        picks = np.sort(np.concatenate([x % g * width + at for at, x in enumerate(seeds)]))
        parts = np.arange(-(-g // SLOTS_OF_PART) + 1)
        cuts = np.searchsorted(picks, parts * span)
        for part, lo, hi in zip(parts, cuts[:-1], cuts[1:], strict=False):
            if hi > lo:
                gaps = np.diff(picks[lo:hi], prepend=part * span)
                yield {**{k: r[k] for k in keys}, "chunk": r["chunk"], "_part": part, "n": hi - lo, "gaps": gaps.astype(np.min_scalar_type(gaps.max())).tobytes()}

    def run(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                yield pd.DataFrame(list(rows(r)))

    return run


def _picked(keys: Sequence[str], width: int):
    """All picks of one part and chunk to the multiplicities of its slots."""

    def run(table: pa.Table) -> pa.Table:
        sets = zip(table["n"].to_pylist(), table["gaps"].to_pylist(), strict=True)
        picks = np.concatenate([np.cumsum(np.frombuffer(gaps, dtype=f"u{len(gaps) // n}"), dtype=np.int64) for n, gaps in sets])
        m = np.bincount(picks, minlength=(picks.max() // width + 1) * width)
        if m.max() > 127:  # for g slots below 1 / 128!, and m <= g
            raise ValueError("a draw picked one cluster more than 127 times")
        m = m.astype(np.int8).reshape(-1, width)
        at = np.flatnonzero(m.any(axis=1))
        out = _same(table, (*keys, "chunk"), len(at))
        out["slot"] = pa.array(at + table["_part"][0].as_py() * SLOTS_OF_PART)
        out["m"] = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * width, pa.array(m[at].ravel()))
        return pa.table(out)

    return run


def _same(table: pa.Table, names: Sequence[str], n: int) -> dict[str, pa.Array]:
    """The first row's values n times."""
    return {c: table[c].combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64))) for c in names}


def _by_draw(drawn: DataFrame, n_boot: int) -> DataFrame:
    """Rows with an array `m` of a chunk once per draw `b` that picked them, with its multiplicity `m`."""
    others = [c for c in drawn.columns if c != "m"]
    each = drawn.select(*others, F.posexplode("m").alias("_at", "m")).where("m > 0").withColumn("m", F.col("m").cast("int"))
    return each.withColumn("b", F.col("chunk") * _width(n_boot) + F.col("_at")).select(*others, "b", "m")


def cluster_draws(df: DataFrame, keys: Sequence[str], cluster: str, n_boot: int, seed: int, every: int = EVERY) -> DataFrame:
    """(keys, cluster, chunk, b, m): how often each draw b picked a cluster, for the clusters it picked."""
    return _by_draw(multiplicities(df, keys, cluster, n_boot, seed, every), n_boot)


def resample(
    df: DataFrame, keys: Sequence[str], cluster: str, spread: Column, draws: DataFrame, n_boot: int
) -> DataFrame:
    """Rows of `df` once per draw that picked their cluster, with `b` and the multiplicity `m`.

    A cluster with many rows is salted by its row count, so that no task multiplies more than about
    ROWS_PER_SALT rows of one cluster and chunk.
    """
    on = [*keys, cluster]
    sizes = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    salts = sizes.select(*on, (F.floor(F.col("_rows") / ROWS_PER_SALT) + 1).cast("int").alias("_salts"))
    left = df.join(salts, on).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))
    left = left.withColumn("chunk", _chunks(n_boot)).drop("_salts")
    right = draws.join(salts, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return left.join(right, [*on, "_salt", "chunk"]).drop("_salt", "chunk")


def percentile_ci(values: DataFrame, keys: Sequence[str], stats: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval, mean and number of defined draws per statistic (at most n_boot values each)."""
    aggs = []
    for s in stats:
        aggs += [
            F.percentile(s, F.lit(alpha / 2)).alias(f"{s}_lo"),
            F.percentile(s, F.lit(1 - alpha / 2)).alias(f"{s}_hi"),
            F.avg(s).alias(f"{s}_mean"),
            F.count(s).alias(f"{s}_draws"),
        ]
    return values.groupBy(*keys).agg(*aggs)


def bootstrap_ranking(
    df: DataFrame,
    keys: Sequence[str],
    cluster: str,
    label: str,
    score: str,
    n_boot: int = 2000,
    seed: int = 0,
    series: Sequence[str] = (),
    every: int = EVERY,
    draws: DataFrame | None = None,
) -> DataFrame:
    """AUC and EER of every draw: one row per (keys, series, b). `draws` are staged `multiplicities` of the same clusters.

    Rows are first collapsed to (cluster, score) counts, and each is joined once per chunk of draws to an array of its
    cluster's multiplicities. Inside a range of scores the draws of a chunk are the columns of a matrix: running sums
    over the scores, plus those of the ranges before, give every draw's curve. Columns in `series` (for example the
    run) share the draws of their key.
    """
    keys, series = list(keys), list(series)
    by, y = [*keys, *series], as_col(label)
    counts = df.groupBy(*by, cluster, score).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("_p"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("_n")
    )
    counts = stage(with_range(counts, by, score, cut_points(df, by, score, every)).withColumnRenamed(score, "_s"))
    # a score that many clusters share makes a large range; its parts are summed first. One row per range: at most the cuts + keys
    sizes = counts.groupBy(*by, "_range").agg((F.floor(F.count(F.lit(1)) / ROWS_PER_SALT) + 1).alias("_parts"))
    part = F.pmod(F.xxhash64(cluster), F.col("_parts"))
    rows = counts.join(F.broadcast(sizes), [*by, "_range"]).withColumn("_part", part).withColumn("chunk", _chunks(n_boot))
    draws = multiplicities(df, keys, cluster, n_boot, seed, every) if draws is None else draws
    rows = rows.join(draws, [*keys, cluster, "chunk"])
    types = dict(df.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in by)

    place = [*by, "chunk", "_range"]
    blocks = rows.select(*place, "_part", F.col("_s").cast("double"), "_p", "_n", "m").groupBy(*place, "_part").applyInArrow(
        _score_block(place, _width(n_boot)), f"{head}chunk int, _range int, s array<double>, p binary, n binary, tp binary, tn binary"
    )
    blocks = stage(blocks)
    before = blocks.select(*place, "tp", "tn").groupBy(*by, "chunk").applyInPandas(
        _sums_before(place, _width(n_boot)), f"{head}chunk int, _range int, bp binary, bn binary, ap binary, an binary"
    )
    found = (
        blocks.groupBy(*place)
        .cogroup(before.groupBy(*place))
        .applyInPandas(_curve_part(place, _width(n_boot)), f"{head}chunk int, auc array<double>, eer array<double>")
    )
    each = found.select(*by, "chunk", F.posexplode(F.arrays_zip("auc", "eer")).alias("at", "x"))
    b = (F.col("chunk") * _width(n_boot) + F.col("at")).alias("b")
    return each.groupBy(*by, b).agg(F.sum("x.auc").alias("auc"), F.max("x.eer").alias("eer")).where(F.col("b") < n_boot)


def _head(pdf: pd.DataFrame, names: Sequence[str]) -> dict:
    return {c: [pdf[c].iloc[0]] for c in names}


def _matrix(values, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.int64).reshape(-1, width)


def _counts(value: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(value, dtype=f"u{len(value) // (n * width)}").reshape(n, width).astype(np.int64)


def _score_block(place: Sequence[str], width: int):
    """Rows of one range (or a part of it) to its distinct scores with weighted counts per draw, and their totals."""

    def run(table: pa.Table) -> pa.Table:
        score, own = np.unique(table["_s"].to_numpy(), return_inverse=True)
        m = table["m"].combine_chunks().flatten().to_numpy().reshape(-1, width).astype(np.int64)
        out = _same(table, place, 1) | {"s": pa.array([score])}
        for c in "pn":
            x = _summed(m * table[f"_{c}"].to_numpy()[:, None], own, len(score))
            out |= {c: pa.array([_small(x)]), f"t{c}": pa.array([x.sum(axis=0).tobytes()])}
        return pa.table(out).select([*place, "s", "p", "n", "tp", "tn"])

    return run


def _small(values: np.ndarray) -> bytes:
    """Counts in as few bytes as hold the largest."""
    return values.astype(np.min_scalar_type(values.max())).tobytes()


def _sums_before(place: Sequence[str], width: int):
    """Totals of the ranges of one chunk to the sums of earlier ranges and of all; as many ranges as cuts at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range", kind="stable", ignore_index=True)
        first = np.flatnonzero(~pdf["_range"].duplicated())
        out = pdf.loc[first, list(place)].reset_index(drop=True)
        for c in "pn":
            total = np.add.reduceat(_matrix(pdf[f"t{c}"], width), first, axis=0)
            before = np.cumsum(total, axis=0) - total
            out[f"b{c}"], out[f"a{c}"] = [x.tobytes() for x in before], total.sum(axis=0).tobytes()
        return out

    return run


def _curve_part(place: Sequence[str], width: int):
    """A range's part of every draw's area, and its equal error rate where the curve crosses inside the range.

    At a score the false positives are the negatives from it upwards, the misses the positives below it; at the next
    higher score both exclude its own counts. The rate is interpolated between these two points.
    """

    def run(blocks: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        names = [c for c in place if c != "_range"]
        scores = np.concatenate(blocks["s"].to_numpy())
        score, own = np.unique(scores, return_inverse=True)
        (pos, pos_before, pos_all), (neg, neg_before, neg_all) = (
            (x, np.cumsum(x, axis=0) - x + _matrix(before[f"b{c}"], width), _matrix(before[f"a{c}"], width)[0])
            for c in "pn"
            for x in [_summed(np.concatenate([_counts(v, len(s), width) for v, s in zip(blocks[c], blocks["s"], strict=True)]), own, len(score))]
        )
        both = (pos_all > 0) & (neg_all > 0)
        some_p, some_n = np.maximum(pos_all, 1), np.maximum(neg_all, 1)
        area = (pos * (neg_before + neg / 2.0)).sum(axis=0) / (some_p * some_n.astype(float))
        fpr, fnr = (neg_all - neg_before) / some_n, pos_before / some_p
        p_fpr, p_fnr = (neg_all - neg_before - neg) / some_n, (pos_before + pos) / some_p
        here, above = fnr - fpr, p_fnr - p_fpr
        cross = (here <= 0) & (above > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            rate = np.where(cross, p_fpr + above / (above - here) * (fpr - p_fpr), np.nan)
        hit = cross.any(axis=0) & both
        eer = [float(rate[cross[:, k], k][0]) if hit[k] else None for k in range(width)]
        auc = [float(a) if ok else None for a, ok in zip(area, both, strict=True)]
        return pd.DataFrame({**_head(blocks, names), "auc": [auc], "eer": [eer]})

    return run


def _summed(values: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(own, kind="stable")
    return np.add.reduceat(values[order], np.searchsorted(own[order], np.arange(n)), axis=0)


def bootstrap_counts(
    df: DataFrame, keys: Sequence[str], cluster: str, label: str, predicted: Column, n_boot: int = 2000, seed: int = 0,
    series: Sequence[str] = (), every: int = EVERY, draws: DataFrame | None = None,
) -> DataFrame:
    """Confusion rates of every draw, from per-cluster confusion counts. `draws` are staged `multiplicities` of the same clusters."""
    keys, series = list(keys), list(series)
    y = as_col(label)
    flags = {
        "tp": (y == 1) & predicted,
        "tn": (y == 0) & ~predicted,
        "fp": (y == 0) & predicted,
        "fn": (y == 1) & ~predicted,
    }
    per_cluster = df.groupBy(*keys, *series, cluster).agg(
        *[F.sum(F.when(c, 1).otherwise(0)).alias(f"_{n}") for n, c in flags.items()]
    )
    draws = multiplicities(df, keys, cluster, n_boot, seed, every) if draws is None else draws
    drawn = _by_draw(per_cluster.withColumn("chunk", _chunks(n_boot)).join(draws, [*keys, cluster, "chunk"]), n_boot)
    counts = drawn.groupBy(*keys, *series, "b").agg(*[F.sum(F.col(f"_{n}") * F.col("m")).alias(n) for n in flags])
    rates = rate_columns()
    positive = ratio(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return counts.select(
        *keys, *series, "b", rates["accuracy"].alias("accuracy"), rates["f1_macro"].alias("f1_macro"),
        positive.alias("frac_pred_spoof"),
    )


def bootstrap_statistic(
    df: DataFrame, keys: Sequence[str], cluster: str, statistic, n_boot: int = 2000, seed: int = 0, every: int = EVERY
) -> DataFrame:
    """Any statistic given as a function of the weight column that returns one aggregate Column.

    The statistic sees every resampled row once with its multiplicity as weight.
    """
    draws = cluster_draws(df, keys, cluster, n_boot, seed, every)
    rows = resample(df, keys, cluster, F.struct(*df.columns), draws, n_boot)
    return rows.groupBy(*keys, "b").agg(statistic(F.col("m")).alias("value"))


def paired_deltas(draws: DataFrame, keys: Sequence[str], series: str, a: str, b: str, stats: Sequence[str]) -> DataFrame:
    """Difference a - b of each statistic within each draw (the two runs share the draw)."""
    def pick(which, s):
        return F.max(F.when(F.col(series) == which, F.col(s)))

    return draws.groupBy(*keys, "b").agg(*[(pick(a, s) - pick(b, s)).alias(f"delta_{s}") for s in stats])


# ---------------------------------------------------------------- paired tests
def mcnemar(df: DataFrame, keys: Sequence[str], right_a: Column, right_b: Column) -> DataFrame:
    """Discordant counts and the exact two-sided p-value."""
    counts = df.groupBy(*keys).agg(
        F.count(F.when(right_a & ~right_b, 1)).alias("a_right_b_wrong"),
        F.count(F.when(~right_a & right_b, 1)).alias("a_wrong_b_right"),
    )
    return counts.withColumn("mcnemar_p", mcnemar_exact("a_right_b_wrong", "a_wrong_b_right"))


def _placements(
    df: DataFrame, rows: DataFrame, keys: Sequence[str], label: str, score: str, name: str, every: int
) -> DataFrame:
    """Add to `rows` the share of the other class in `df` that a row beats (positives) or is beaten by (negatives)."""
    points = score_points(df, keys, label, score, every=every)
    below = ratio(F.col("neg_before") + F.col("neg") / 2.0, F.col("neg_total"))
    above = ratio(F.col("pos_total") - F.col("pos_before") - F.col("pos") / 2.0, F.col("pos_total"))
    table = points.select(*keys, score, below.alias("_below"), above.alias("_above"))
    joined = rows.join(table, [*keys, score])  # AQE splits the partition of a score shared by many rows
    return joined.withColumn(name, F.when(as_col(label) == 1, F.col("_below")).otherwise(F.col("_above"))).drop(
        "_below", "_above"
    )


def delong(df: DataFrame, keys: Sequence[str], label: str, score_a: str, score_b: str, every: int = EVERY) -> DataFrame:
    """DeLong test of two correlated AUCs on the same items; z is NULL when the variance is not positive."""
    v = df.withColumns({"_sa": F.col(score_a), "_sb": F.col(score_b)}).select(*keys, label, "_sa", "_sb")
    v = _placements(v, v, keys, label, "_sa", "_va", every)
    v = _placements(df.withColumn("_sb", F.col(score_b)), v, keys, label, "_sb", "_vb", every)
    y = as_col(label)

    def on(cls, c):
        return F.when(y == cls, F.col(c))

    agg = v.groupBy(*keys).agg(
        F.avg(on(1, "_va")).alias("auc_a"),
        F.avg(on(1, "_vb")).alias("auc_b"),
        F.count(on(1, "_va")).alias("_m"),
        F.count(on(0, "_va")).alias("_n"),
        *[F.var_samp(on(c, s)).alias(f"_var{c}{s}") for c in (1, 0) for s in ("_va", "_vb")],
        *[F.covar_samp(on(c, "_va"), on(c, "_vb")).alias(f"_cov{c}") for c in (1, 0)],
    )
    var = (F.col("_var1_va") + F.col("_var1_vb") - 2 * F.col("_cov1")) / F.col("_m") + (
        F.col("_var0_va") + F.col("_var0_vb") - 2 * F.col("_cov0")
    ) / F.col("_n")
    # identical scores leave rounding noise of the summed components instead of an exact zero
    parts = (F.col("_var1_va") + F.col("_var1_vb")) / F.col("_m") + (F.col("_var0_va") + F.col("_var0_vb")) / F.col("_n")
    z = (F.col("auc_a") - F.col("auc_b")) / F.sqrt(F.when(var > parts * 1e-12, var))
    return agg.select(*keys, "auc_a", "auc_b", z.alias("z")).withColumn("p_value", normal_two_sided("z"))


def holm(df: DataFrame, family: Sequence[str], p: str, name: str = "p_holm") -> DataFrame:
    """Holm step-down adjustment within each family; rows without a p-value keep NULL.

    A running maximum over the ordered p-values. The largest adjusted value seen in earlier ranges is
    carried by the range table, so a family is not one task. The adjusted values are matched to their rows by p, so `df`
    is staged: evaluated again, sums that meet in another order give a p with other last digits, which matches none.
    """
    df = stage(df)
    tested = df.where(F.col(p).isNotNull())
    points = ordered_totals(tested, family, p, {"_n": F.lit(1)})
    # k tests below, m in all: the first of equal p-values has the largest multiplier, so it sets the value
    step = F.least(F.lit(1.0), (F.col("_n_total") - F.col("_n_before")) * F.col(p))
    stepped = points.select(*family, p, step.alias("_step"))
    return df.join(_running_max(stepped, family, p, "_step", name), [*family, p], "left")


def _running_max(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    ranged = with_range(df, keys, order, cut_points(df, keys, order))
    upto = Window.partitionBy(*keys, "_range").orderBy(order)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        ranged.groupBy(*keys, "_range")
        .agg(F.max(value).alias("_top"))
        .select(*keys, "_range", F.max("_top").over(earlier).alias("_before"))
    )
    rows = ranged.withColumn("_here", F.max(value).over(upto))
    return rows.join(tops, [*keys, "_range"]).select(
        *keys, order, F.greatest("_here", F.coalesce("_before", "_here")).alias(name)
    )


# ---------------------------------------------------------------- two-sample tests
def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, value: str, every: int = EVERY) -> DataFrame:
    """U of group 1 and the two-sided p (normal law, tie and continuity corrected).

    Always the normal law; with more than two rows on each side, else NULL.
    """
    points = score_points(df.where(F.col(value).isNotNull()), keys, group, value, every=every)
    t = (F.col("pos") + F.col("neg")).cast("double")
    agg = points.groupBy(*keys).agg(
        F.max("pos_total").alias("n1"),
        F.max("neg_total").alias("n2"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("u"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    top = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    z = F.when((n1 > 2) & (n2 > 2) & (sd > 0), (top - n1 * n2 / 2.0 - 0.5) / sd)
    return agg.select(*keys, "n1", "n2", "u", z.alias("z")).withColumn(
        "p_value", normal_two_sided(F.greatest("z", F.when(F.col("z").isNotNull(), F.lit(0.0))))
    )


def proportion_z(hits_a, n_a, hits_b, n_b) -> Column:
    """Pooled two-proportion z statistic."""
    a, m, b, n = (as_col(c).cast("double") for c in (hits_a, n_a, hits_b, n_b))
    pooled = (a + b) / (m + n)
    sd = F.sqrt(pooled * (1 - pooled) * (1 / m + 1 / n))
    return (a / m - b / n) / F.when(sd > 0, sd)
