"""Seeded samples and group-disjoint splits.

Every choice is the order of a stable hash. A split is decided by comparing a row's own group hash with
one cut value, so rows are never joined back to a list of groups. The cuts, a row for each label, are broadcast: a
shuffle by label would put a label that holds most rows into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigeval.functions.columns import as_col
from sigeval.operators.ordering import ordered_totals


def order_hash(seed: int, value) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), as_col(value).cast("string")))


def seeded_sample(df: DataFrame, item: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same on every partitioning; items must be unique.

    The hash at position n is a scalar of the plan, and rows below it stay where they are.
    """
    work = df.withColumn("_h", order_hash(seed, item))
    cut = _cut_values(work.select("_h"), [], {"_c": F.lit(n)}).select("_c").scalar()
    return work.where(cut.isNull() | (F.col("_h") < cut)).select(*df.columns)


def stratified_sample(df: DataFrame, label: str, item: str, per_label: int, seed: int = 0) -> DataFrame:
    """Exactly `per_label` rows of each label (or all it has); items must be unique.

    The hash at position `per_label` is found by distributed running counts and rows below it are kept,
    so a label that holds most rows is not ranked in one task.
    """
    work = df.withColumn("_h", order_hash(seed, item))
    cuts = _cut_values(work.select(label, "_h"), [label], {"_c": F.lit(per_label)})
    return work.join(F.broadcast(cuts), label).where(F.col("_c").isNull() | (F.col("_h") < F.col("_c"))).select(*df.columns)


def first_per_class(df: DataFrame, label: str, item: str, n: int = 30) -> DataFrame:
    """First n rows of each label in item order; Spark applies a small rank limit before the shuffle."""
    w = Window.partitionBy(label).orderBy(item)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _cut_values(groups: DataFrame, keys: Sequence[str], positions: dict[str, Column]) -> DataFrame:
    """Hash at given 0-based positions of the hash order, per key, and the number of groups."""
    points = ordered_totals(groups, keys, "_h", {"_n": F.lit(1)})
    return points.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_n_before") == p, F.col("_h"))).alias(n) for n, p in positions.items()]
    )


def group_split(
    df: DataFrame, group: str, shares: Sequence[tuple[str, float]], seed: int = 0, name: str = "split", keys: Sequence[str] = ()
) -> DataFrame:
    """Split whole groups in exact proportions, e.g. [("train", .7), ("validation", .15), ("internal_test", .15)].

    The cut after a cumulative share c lies at position floor(c * groups) of the hash order.
    """
    work = df.withColumn("_h", order_hash(seed, group))
    total, cum, positions = F.col("_n_total"), 0.0, {}
    for i, (_, share) in enumerate(shares[:-1]):
        cum += share
        positions[f"_c{i}"] = F.floor(F.lit(round(cum, 10)) * total)
    cuts = _cut_values(work.select(*keys, "_h").distinct(), keys, positions)
    # without keys the cuts are scalars of the plan: a join on a constant has no key to hash by
    out = work.join(F.broadcast(cuts), list(keys)) if keys else work.withColumns({c: cuts.select(c).scalar() for c in positions})
    split = None
    for i, (label, _) in enumerate(shares[:-1]):
        # no group at that position: every group lies before the cut
        before = F.col(f"_c{i}").isNull() | (F.col("_h") < F.col(f"_c{i}"))
        split = F.when(before, label) if split is None else split.when(before, label)
    return out.select(*df.columns, split.otherwise(shares[-1][0]).alias(name))


def stratified_split(
    df: DataFrame, label: str, parent: str, test_share: float = 0.15, seed: int = 0, name: str = "split"
) -> DataFrame:
    """Parent-level split with the held-out share exact in each label; a parent must have one label."""
    return group_split(df, parent, [("validation", test_share), ("train", 1 - test_share)], seed, name, [label])
