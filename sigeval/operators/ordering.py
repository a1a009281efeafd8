"""Running sums, ranks and exact quantiles over a sort order, without one task per key.

`Window.partitionBy(key).orderBy(x)` puts a whole key into one task, and here a key is a data split
or a corpus: a few keys, each holding a large share of all rows. The functions below cut every key
into ranges of the order column, run the window inside a range, and add the totals of the ranges
before it.

The cut points are the distinct (key, value) pairs with the smallest hashes, at most `max_cuts` of
them over all keys: two for each shuffle partition, and MAX_CUTS at least. That makes them a
function of the data alone (a recomputed task sees the same cuts), gives a key cuts in proportion to its distinct values, and bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CUTS = 4096
EVERY = 512  # one distinct value in so many is a candidate cut


def max_cuts(df: DataFrame) -> int:
    return max(MAX_CUTS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, keys: Sequence[str], order: str, every: int = EVERY) -> DataFrame:
    """One row per key with a sorted array of at most `max_cuts` cut points over all keys together."""
    return _cut_points(df.where(F.pmod(F.xxhash64(*keys, order), F.lit(every)) == 0).select(*keys, order).distinct(), keys, order)


def _cut_points(values: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    picked = values.orderBy(F.xxhash64(*keys, order), *keys, order).limit(max_cuts(values))
    return picked.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_cuts"))


def _count_up_to(cuts: Column, x: Column, most: int) -> Column:
    """Number of cuts <= x by binary search over at most `most`: each step moves on or keeps the position."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= x, at + step).otherwise(at)
    )


def with_range(df: DataFrame, keys: Sequence[str], order: str, cuts: DataFrame) -> DataFrame:
    """Add `_range`, the index of the row's range within its key; without keys the cuts are a scalar of the plan."""
    if keys:
        joined = df.join(F.broadcast(cuts), list(keys), "left")  # at most `max_cuts` rows by construction
    else:
        joined = df.withColumn("_cuts", cuts.select("_cuts").scalar())
    return joined.withColumn(
        "_range", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(_count_up_to(F.col("_cuts"), F.col(order), max_cuts(df)))
    ).drop("_cuts")


def ordered_totals(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], every: int = EVERY
) -> DataFrame:
    """Collapse to one row per (keys, order) and add running totals in ascending order.

    For each value v: `v` (sum at this order value), `v_before` (sum below it), `v_total` (sum of the
    key) and `v_prev` (sum at the next lower order value, NULL at the lowest). Keys and order values
    must not be NULL. If `df` already has `_range` (a non-decreasing function of the order value within
    each key), it is used as it is; bootstrap draws share the ranges of their data that way.
    """
    keys = list(keys)
    names = list(values)
    sums = [F.sum(values[n]).alias(n) for n in names]
    if "_range" in df.columns:
        ranged = df.groupBy(*keys, "_range", order).agg(*sums)
    else:
        collapsed = df.groupBy(*keys, order).agg(*sums)
        # the condition also reads the totals (adding zero), which keeps this branch on the shuffle of
        # `collapsed`: a condition on the keys alone would be pushed below it and compute `df` again
        h = F.xxhash64(*keys, order) + sum(F.col(n).isNull().cast("int") for n in names)
        cuts = _cut_points(collapsed.where(F.pmod(h, F.lit(every)) == 0), keys, order)
        ranged = with_range(collapsed, keys, order, cuts)

    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select(
        *keys,
        "_range",
        order,
        *names,
        *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"_in_{n}") for n in names],
        *[F.lag(n).over(inside).alias(f"_lag_{n}") for n in names],
    )
    per_range = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(n).alias(f"_s_{n}") for n in names],
        *[F.max_by(n, order).alias(f"_e_{n}") for n in names],
    )
    # at most (cuts of the key + 1) rows per key
    by_range = Window.partitionBy(*keys).orderBy("_range")
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(Window.partitionBy(*keys)).alias(f"{n}_total") for n in names],
        *[F.lag(f"_e_{n}").over(by_range).alias(f"_tail_{n}") for n in names],
    )
    return rows.join(offsets, [*keys, "_range"]).select(
        *keys,
        order,
        *names,
        *[(F.col(f"_off_{n}") + F.col(f"_in_{n}")).alias(f"{n}_before") for n in names],
        *[F.col(f"{n}_total") for n in names],
        *[F.coalesce(f"_lag_{n}", f"_tail_{n}").alias(f"{n}_prev") for n in names],
    )


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx", every: int = EVERY, total: str | None = None
) -> DataFrame:
    """Add the 0-based position of each row within its key, in the order of a unique column tuple."""
    keys, order = list(keys), list(order)
    if len(order) == 1:
        tagged, by = df, order[0]
    else:
        tagged, by = df.withColumn("_ord", F.struct(*order)), "_ord"
    ranged = with_range(tagged, keys, by, cut_points(tagged, keys, by, every))
    rows = ranged.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(by)) - 1)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    out = rows.join(offsets, [*keys, "_range"]).withColumn(name, (F.col("_off") + F.col("_in")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, name, *([total] if total else []))


def midranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "midrank", every: int = EVERY) -> DataFrame:
    """Average rank of each row's value within its key.

    The rank is computed per distinct value and joined back; AQE splits the partition of a value that
    many rows share.
    """
    points = ordered_totals(df, keys, value, {"_n": F.lit(1)}, every)
    ranks = points.select(*keys, value, (F.col("_n_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, [*keys, value])


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], every: int = EVERY
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of `probs`, plus `n`.

    Spark's `percentile` keeps every distinct value of a key in one task; here each quantile is the
    pair of values at two positions, taken from the running counts by plain aggregates.
    """
    points = ordered_totals(df.where(F.col(value).isNotNull()), keys, value, {"_n": F.lit(1)}, every)
    aggs = [F.max("_n_total").alias("n")]
    for name, q in probs.items():
        pos = (F.col("_n_total") - 1) * F.lit(float(q))
        aggs += [
            F.max(F.when(F.col("_n_before") <= F.floor(pos), F.col(value))).cast("double").alias(f"_lo_{name}"),
            F.max(F.when(F.col("_n_before") <= F.ceil(pos), F.col(value))).cast("double").alias(f"_hi_{name}"),
        ]
    out = points.groupBy(*keys).agg(*aggs)
    cols = []
    for name, q in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, "n", *cols)
