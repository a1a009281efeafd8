"""Nearest neighbours above a cosine threshold, and the near-duplicate candidates built from them.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c). Some vectors, chosen by hash, are pivots; the home of a vector is the cell
of its nearest pivot. If two such vectors have different homes, the segment between them crosses the plane halfway between the
two pivots, so one of them lies within r / 2 of it. Each vector is compared with the members of its own cell and of the cells
whose plane is that near. Nothing is missed, whatever the pivots; they are taken far apart, and so many that a vector reaches few cells.

Identical vectors are one group, represented by its smallest item while vectors are compared; a group's smallest items
then stand for it in the neighbour lists, and every member gets its own list. A crowded cell is cut into blocks,
compared block against block in separate tasks, and each block returns at most k neighbours per
vector, so a cluster of near copies never becomes a list of all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sigeval.operators.components import components
from sigeval.session import stage

BLOCK_ROWS = 4096
PAIR_BLOCK_ROWS = 2048  # where all pairs of a block are returned at once
PROBE_ROWS = 256  # rows of a block that are compared at a time
PIVOTS = 2048  # at most so many vectors are collected and broadcast
REACH = 12.0  # fewer pivots are used if a vector would be compared with more cells on average


def distinct_vectors(df: DataFrame, item: str, vec: str) -> DataFrame:
    """One row per distinct vector: its smallest item and its number of copies."""
    return df.groupBy(vec).agg(F.min(item).alias(item), F.count(F.lit(1)).alias("copies"))


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _reached(u: np.ndarray, pivots: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home of each vector, and which cells it is compared with."""
    s = u @ pivots.T
    home, row = s.argmax(axis=1), np.arange(len(u))
    near = s[row, home][:, None] - s <= gaps[home]
    near[row, home] = True
    return home, near


def _gaps(pivots: np.ndarray, r: float) -> np.ndarray:
    """Largest difference of the products with two pivots that lies within r / 2 of the plane between them."""
    return r / 2 * np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0)) + 1e-9


def _pivots(one_each: DataFrame, r: float, most: int) -> np.ndarray:
    """Unit vectors more than 2r apart, of the vectors with the smallest hashes; the next ones try how many cells are reached."""
    most = min(most, one_each.count() // 16 + 1)
    rows = one_each.orderBy(F.xxhash64("item"), "item").limit(2 * most).select("v").toPandas()
    if rows.empty:
        return np.empty((0, 0))
    u = _unit(rows["v"])
    u = u[np.isfinite(u).all(axis=1)]
    tried, found = u[most:], u[:0]
    close = 1.0 - 2.0 * r * r
    for x in u[:most]:
        if not (found @ x >= close).any():
            found = np.vstack([found, x])
    while len(found) > 1 and len(tried) and _reached(tried, found, _gaps(found, r))[1].sum() > REACH * len(tried):
        found = found[: len(found) // 2]
    return found


def _cells(pivots, r: float):
    """Kernel that gives each vector its own cell and the cells it reaches."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pivots.value
        gaps = _gaps(known, r)
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                u = _unit(part["v"])
                home, near = _reached(u, known, gaps) if len(known) else (np.zeros(len(u), np.int64), np.ones((len(u), 1), bool))
                reach = [np.flatnonzero(x).astype(np.int32) for x in near]
                yield pd.DataFrame({"item": part["item"].to_numpy(), "u": list(u), "home": home.astype(np.int32), "reach": reach})

    return kernel


def _best(item: np.ndarray, neighbour: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k rows of each item with the largest cosine, then the smallest neighbour."""
    order = np.lexsort((neighbour, -cosine, item))
    item, neighbour, cosine = item[order], neighbour[order], cosine[order]
    _, first, sizes = np.unique(item, return_index=True, return_counts=True)
    keep = np.arange(len(item)) - np.repeat(first, sizes) < k
    return item[keep], neighbour[keep], cosine[keep]


def _compare(k: int | None, threshold: float):
    """Pairs of a block: each once, at its larger item, or with k the k best of each probe and of each home in it.

    Members of the same cell meet as home and probe in both orders, and only one of them counts.
    """

    def kernel(key, homes: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        h, h_id = (np.stack(homes["u"].to_numpy()), homes["item"].to_numpy()) if len(homes) else (None, None)
        for lo in range(0, len(probes) if h is not None else 0, PROBE_ROWS):
            part = probes.iloc[lo : lo + PROBE_ROWS]
            p_id, own = part["p_item"].to_numpy(), part["p_own"].to_numpy().astype(bool)
            cos = np.stack(part["p_u"].to_numpy()) @ h.T
            row, col = np.nonzero(cos >= threshold)
            a, b = p_id[row], h_id[col]
            once = np.where(own[row], a > b, a != b)
            a, b, cosine = a[once], b[once], cos[row, col][once]
            if k is None:
                out.append((np.maximum(a, b), np.minimum(a, b), cosine))
            else:
                out += [_best(a, b, cosine, k), _best(b, a, cosine, k)]
        item, neighbour, cosine = (np.concatenate(x) for x in zip(*out))
        if k is not None:
            item, neighbour, cosine = _best(item, neighbour, cosine, k)
        return pd.DataFrame({"item": item, "neighbour": neighbour, "cosine": cosine})

    return kernel


def _one_each(df: DataFrame, item: str, vec: str) -> DataFrame:
    return stage(distinct_vectors(df, item, vec).select(F.col(item).cast("long").alias("item"), F.col(vec).alias("v"), "copies"))


def _compared(one_each: DataFrame, threshold: float, k: int | None, pivots: int, block_rows: int) -> DataFrame:
    """(item, neighbour, cosine) of distinct vectors: at least the k best of each item, or all pairs at their larger item."""
    r = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-9
    known = one_each.sparkSession.sparkContext.broadcast(_pivots(one_each, r, pivots))
    base = stage(one_each.select("item", "v").mapInPandas(_cells(known, r), "item long, u array<double>, home int, reach array<int>"))
    homes = base.select("item", "u", F.col("home").alias("cell"))
    probes = base.select("item", "u", "home", F.explode("reach").alias("cell")).select("item", "u", "cell", (F.col("home") == F.col("cell")).alias("own"))
    found = _by_cells(homes, probes, threshold, k, block_rows, F.broadcast)  # a row for each pivot at most
    return found.groupBy("item", "neighbour").agg(F.max("cosine").alias("cosine"))  # near a plane both may reach the other's cell


def _by_cells(homes: DataFrame, probes: DataFrame, threshold: float, k: int | None, block_rows: int, hint=lambda sizes: sizes) -> DataFrame:
    """The pairs of a home (item, u, cell) and a probe (also own: a home of the cell) of the same cell, in blocks of a cell."""

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(name))

    sizes = hint(blocks(homes.select("cell"), "_nh").join(blocks(probes.select("cell"), "_np"), "cell"))
    h = (
        homes.join(sizes, "cell")
        .withColumn("hb", F.pmod(F.xxhash64("item"), F.col("_nh")))
        .withColumn("pb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_np").cast("long") - 1)))
    )
    p = (
        probes.join(sizes, "cell")
        .withColumn("pb", F.pmod(F.xxhash64("item"), F.col("_np")))
        .withColumn("hb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nh").cast("long") - 1)))
    )
    block = ["cell", "hb", "pb"]
    p = p.select(*[F.col(c).alias(f"p_{c}") for c in (*block, "item", "u", "own")])
    return (
        h.select(*block, "item", "u")
        .groupBy(*block)
        .cogroup(p.groupBy(*[f"p_{c}" for c in block]))
        .applyInPandas(_compare(k, threshold), "item long, neighbour long, cosine double")
    )


def neighbours(
    df: DataFrame, item: str, vec: str, dim: int, threshold: float, k: int = 6, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The k nearest items with cosine >= threshold, copies of the same vector included: (item, neighbour, cosine, rank)."""
    one_each = _one_each(df, item, vec)
    found = _compared(one_each, threshold, k, pivots, block_rows)
    near = stage(_ranked(found, k))

    # members of groups; a list of k needs at most k + 1 of each (one of them may be the item itself)
    groups = one_each.where("copies > 1").select(F.col("item").alias("rep"), "v")
    member = df.select(F.col(item).cast("long").alias("item"), F.col(vec).alias("v")).join(groups, "v").select("item", "rep")
    few = member.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("item"))).where(F.col("at") <= k + 1)
    few = stage(few.select(F.col("rep").alias("neighbour"), F.col("item").alias("member")))
    own = few.select(F.col("neighbour").alias("item"), F.col("member").alias("neighbour"), F.lit(1.0).alias("cosine"))
    others = near.join(few, "neighbour", "left").select("item", F.coalesce("member", "neighbour").alias("neighbour"), "cosine")
    lists = _ranked(own.unionByName(others), k + 1).select(F.col("item").alias("rep"), "neighbour", "cosine")
    items = one_each.where("copies = 1").select("item", F.col("item").alias("rep")).unionByName(member)
    return _ranked(items.join(lists, "rep").where("item <> neighbour").select("item", "neighbour", "cosine"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("cosine"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def all_pairs(df: DataFrame, item: str, vec: str, dim: int, threshold: float, pivots: int = PIVOTS, block_rows: int = PAIR_BLOCK_ROWS) -> DataFrame:
    """Every pair of distinct vectors with cosine >= threshold, each by its smallest item: (item_a, item_b, cosine).

    No list is cut, however many neighbours or copies a vector has; `copies` gives the other items of a vector.
    """
    found = _compared(_one_each(df, item, vec), threshold, None, pivots, block_rows)
    return found.select(F.col("neighbour").alias("item_a"), F.col("item").alias("item_b"), "cosine")


def copies(df: DataFrame, item: str, vec: str) -> DataFrame:
    """(representative, member) for each item of a vector that occurs more than once, the representative included."""
    groups = distinct_vectors(df, item, vec).where("copies > 1").select(F.col(item).alias("representative"), vec)
    return df.select(F.col(item).alias("member"), vec).join(groups, vec).select("representative", "member")


def _polytopes(dim: int, tables: int, width: int, seed: int):
    """Kernel that gives each vector its cells: per table the corners of `width` turned cross-polytopes it is nearest to."""
    turns = np.linalg.qr(np.random.default_rng(seed).normal(size=(tables, width, dim, dim)))[0]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            cells = []
            for table in range(tables):
                code = np.full(len(u), table, dtype=np.int64)
                for turn in turns[table]:
                    y = u @ turn.T
                    at = np.abs(y).argmax(axis=1)
                    code = code * (2 * dim) + 2 * at + (y[np.arange(len(u)), at] < 0)
                cells.append(code)
            yield pd.DataFrame({"item": pdf["item"].to_numpy(), "u": list(u), "cells": list(np.stack(cells, axis=1).astype(str))})

    return kernel


def lsh_pairs(
    df: DataFrame, item: str, vec: str, dim: int, threshold: float, tables: int = 8, width: int = 2, block_rows: int = BLOCK_ROWS, seed: int = 1
) -> DataFrame:
    """Pairs of distinct vectors with cosine >= threshold, found by cross-polytope hashing: (item_a, item_b, cosine).

    For thresholds at which the cells of `all_pairs` prune nothing. Vectors meet if `width` hashes of one of `tables` tables agree; what
    meets is compared exactly, so nothing wrong is returned, but a pair that meets in no table is missed. Two unit vectors at distance t
    agree in one hash with a probability of about dim ** (-t^2 / (4 - t^2)); more hashes make smaller cells for more vectors, more
    tables raise the recall. No list is cut: a crowded cell is compared in blocks.
    """
    one_each = _one_each(df, item, vec)
    hashed = stage(one_each.select("item", "v").mapInPandas(_polytopes(dim, tables, width, seed), "item long, u array<double>, cells array<string>"))
    cells = hashed.select("item", "u", F.explode("cells").alias("cell"))
    found = _by_cells(cells, cells.withColumn("own", F.lit(True)), threshold, None, block_rows)
    return found.groupBy(F.col("neighbour").alias("item_a"), F.col("item").alias("item_b")).agg(F.max("cosine").alias("cosine"))


def clusters(df: DataFrame, item: str, vec: str, links: DataFrame) -> DataFrame:
    """One row per item: item, representative (smallest item of its vector), cluster (smallest item that links reach), n_links.

    `links` are pairs (item_a, item_b) of representatives, as of `all_pairs` or `lsh_pairs`; `n_links` counts those of the
    representative. Copies are members of their vector and not expanded into pairs.
    """
    reps = distinct_vectors(df, item, vec).select(F.col(item).alias("representative"), vec)
    own = df.select(F.col(item).alias("item"), vec).join(reps, vec).select("item", "representative")
    ends = links.select(F.explode(F.array("item_a", "item_b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = components(links).join(ends, "node").withColumnRenamed("node", "representative")
    out = own.join(known, "representative", "left")
    return out.select("item", "representative", F.coalesce("component", "representative").alias("cluster"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def link_counts(members: DataFrame, links: DataFrame, by: dict[str, str]) -> DataFrame:
    """One row: confirmed pairs of items, and for each name in `by` those whose items differ in that column.

    `members` has (representative, item) with the columns, `links` pairs of representatives. Pairs of items are counted from the sizes of
    the groups: copies of a vector are linked to each other and to the copies of a linked vector.
    """

    def pairs_of(columns: list[str]) -> DataFrame:
        """Linked pairs of items that agree in the columns."""
        sizes = members.groupBy("representative", *columns).agg(F.count(F.lit(1)).alias("n"))
        inside = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n"))
        a = sizes.select(F.col("representative").alias("item_a"), *columns, F.col("n").alias("na"))
        b = sizes.select(F.col("representative").alias("item_b"), *columns, F.col("n").alias("nb"))
        across = links.select("item_a", "item_b").join(a, "item_a").join(b, ["item_b", *columns]).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
        return inside.unionByName(across).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))

    out = members.agg(F.count(F.lit(1)).alias("n_items_checked"))
    whole = pairs_of([]).scalar()
    cols = {"confirmed_pairs": whole} | {name: whole - pairs_of([column]).scalar() for name, column in by.items()}
    return out.select("n_items_checked", *[c.alias(n) for n, c in cols.items()])


def candidate_pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs from the neighbour lists."""
    return (
        found.select(F.least("item", "neighbour").alias("item_a"), F.greatest("item", "neighbour").alias("item_b"), "cosine")
        .groupBy("item_a", "item_b")
        .agg(F.max("cosine").alias("cosine"))
    )


@F.pandas_udf(DoubleType())
def max_cross_correlation(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Largest normalised cross-correlation of two signals over all lags."""

    def one(a, b) -> float:
        a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
        a, b = a - a.mean(), b - b.mean()
        scale = math.sqrt(float(a @ a) * float(b @ b))
        if scale == 0.0:
            return 0.0
        n = 1 << (len(a) + len(b) - 2).bit_length()
        return float(np.max(np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)) / scale)

    for x, y in parts:
        yield pd.Series([one(a, b) for a, b in zip(x, y)], dtype="float64")


def confirm(pairs: DataFrame, signals: DataFrame, item: str, samples: str, threshold: float = 0.95) -> DataFrame:
    """Candidates with their cross-correlation and whether it confirms them. Signals are joined to candidates only."""
    a = signals.select(F.col(item).alias("item_a"), F.col(samples).alias("_a"))
    b = signals.select(F.col(item).alias("item_b"), F.col(samples).alias("_b"))
    x = pairs.join(a, "item_a").join(b, "item_b").withColumn("correlation", max_cross_correlation("_a", "_b"))
    return x.withColumn("confirmed", F.col("correlation") >= threshold).drop("_a", "_b")
