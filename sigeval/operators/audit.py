"""Corpus audit: inventories, descriptive tables, separability, duplicates and leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigeval.functions.columns import as_col
from sigeval.operators.errors import unpivot
from sigeval.operators.metrics import auc_aggregate, score_points
from sigeval.operators.ordering import quantiles


def class_crosstab(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Counts per class with zeros for absent classes, and the ratio of class 1 to class 0."""
    t = df.groupBy(*keys).agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("class_0"), F.count(F.when(F.col(label) == 1, 1)).alias("class_1")
    )
    return t.withColumn("ratio", F.col("class_1") / F.when(F.col("class_0") > 0, F.col("class_0")))


def corpus_counts(df: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), (F.sum(seconds) / 3600.0).alias("hours"))


def census(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))


def distribution(df: DataFrame, keys: Sequence[str], value: str, limit: float) -> DataFrame:
    """Mean, sample SD, median, extremes, 5 % and 95 % quantiles and the share of values <= limit."""
    v = F.col(value)
    moments = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg((v <= limit).cast("int")).alias("frac_le_limit"),
    )
    q = quantiles(df, keys, value, {"median": 0.5, "p05": 0.05, "p95": 0.95}).drop("n")
    return moments.join(q, list(keys))


def descriptor_stats(df: DataFrame, keys: Sequence[str], descriptors: Sequence[str]) -> DataFrame:
    """Median and quartiles of each descriptor, one row per (keys, descriptor)."""
    long = unpivot(df, keys, descriptors)
    return quantiles(long, [*keys, "descriptor"], "value", {"median": 0.5, "q25": 0.25, "q75": 0.75})


def profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median, extremes, distinct values and mode (the lowest of tied values)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    base = counts.groupBy(*keys).agg(
        F.sum("_n").alias("count"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(F.lit(1)).alias("distinct"),
        F.max_by(F.col(value), F.struct(F.col("_n"), -F.col(value))).alias("mode"),
    )
    return base.join(quantiles(df, keys, value, {"median": 0.5}).drop("n"), list(keys))


def separability(df: DataFrame, keys: Sequence[str], label: str, descriptors: Sequence[str]) -> DataFrame:
    """AUC of every raw descriptor against the label; separability is max(AUC, 1 - AUC)."""
    by = [*keys, "descriptor"]
    long = unpivot(df.where(F.col(label).isNotNull()), [*keys, label], descriptors).where(F.col("value").isNotNull())
    pts = score_points(long, by, label, "value")
    a = pts.groupBy(*by).agg(auc_aggregate().alias("auc"), (F.max("pos_total") + F.max("neg_total")).alias("n"))
    return a.where(F.col("auc").isNotNull()).select(
        *by,
        F.col("auc").alias("auc_spoof_high"),
        F.greatest("auc", 1 - F.col("auc")).alias("separability"),
        F.when(F.col("auc") >= 0.5, "higher=>spoof").otherwise("lower=>spoof").alias("direction"),
        "n",
    )


def id_number(name, pattern: str = r"(\d+)") -> Column:
    """First number in an id, NULL if there is none."""
    return F.nullif(F.regexp_extract(as_col(name), pattern, 1), F.lit("")).cast("double")


def duplicate_groups(df: DataFrame, digest: str, label: str, source: str, item: str) -> DataFrame:
    """One row per content hash shared by more than one item. Copies are counted, never paired."""
    return (
        df.groupBy(digest)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.min(item).alias("first_item"),
            (F.min(label) != F.max(label)).alias("cross_label"),
            (F.min(source) != F.max(source)).alias("cross_source"),
        )
        .where(F.col("files") > 1)
    )


def duplicate_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files_in_groups"),
        F.count(F.lit(1)).alias("groups"),
        F.count(F.when(F.col("cross_label"), 1)).alias("cross_label_groups"),
        F.count(F.when(F.col("cross_source"), 1)).alias("cross_source_groups"),
    )


def split_overlap(df: DataFrame, split: str, kinds: dict[str, Column]) -> DataFrame:
    """Number of key values of each kind that two splits share, for every pair of splits, zeros included.

    A key value is reduced to the set of splits it occurs in (as many entries as there are splits), so
    a value held by very many rows costs one row after the map-side aggregation.
    """
    keyed = df.select(
        split, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()]))
    ).where(F.col("key").isNotNull())
    sets = keyed.groupBy("kind", "key").agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = sets.select("kind", F.explode("s").alias("split_a"), "s").select(
        "kind", "split_a", F.explode(F.filter("s", lambda x: x > F.col("split_a"))).alias("split_b")
    )
    shared = pairs.groupBy("split_a", "split_b").pivot("kind", list(kinds)).count()
    names = df.agg(F.array_sort(F.collect_set(split)).alias("s"))  # the few split names
    every = names.select(F.explode("s").alias("split_a"), "s").select(
        "split_a", F.explode(F.filter("s", lambda x: x > F.col("split_a"))).alias("split_b")
    )
    return every.join(shared, ["split_a", "split_b"], "left").na.fill(0, list(kinds)).select(
        "split_a", "split_b", *[F.col(k).alias(f"shared_{k}") for k in kinds]
    )


def id_pairing(df: DataFrame, keys: Sequence[str], item_id: str, label: str) -> DataFrame:
    """Ids per class, ids in both classes and the numeric range of each class."""
    per_id = df.groupBy(*keys, item_id).agg(
        F.max((F.col(label) == 0).cast("int")).alias("_r"), F.max((F.col(label) == 1).cast("int")).alias("_f")
    )
    real, fake = F.col("_r") == 1, F.col("_f") == 1
    return per_id.groupBy(*keys).agg(
        F.count(F.when(real, 1)).alias("real_ids"),
        F.count(F.when(fake, 1)).alias("fake_ids"),
        F.count(F.when(real & fake, 1)).alias("ids_in_both"),
        F.min(F.when(real, F.col(item_id))).alias("real_min"),
        F.max(F.when(real, F.col(item_id))).alias("real_max"),
        F.min(F.when(fake, F.col(item_id))).alias("fake_min"),
        F.max(F.when(fake, F.col(item_id))).alias("fake_max"),
    )


def top_components(df: DataFrame, path: str, n: int = 50) -> DataFrame:
    """Most common path components, ties by name."""
    parts = df.select(F.explode(F.split(path, "/")).alias("component"))
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(n)


def timing_summary(df: DataFrame, keys: Sequence[str], seconds: str, audio_seconds: str, windows: str) -> DataFrame:
    """Mean, sample SD, median, 95 % quantile, cost per window and real-time factor of a timing table."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(seconds).alias("mean"),
        F.stddev_samp(seconds).alias("sd"),
        (F.sum(seconds) / F.sum(windows)).alias("per_window"),
        (F.sum(seconds) / F.sum(audio_seconds)).alias("real_time_factor"),
    )
    return base.join(quantiles(df, keys, seconds, {"median": 0.5, "p95": 0.95}).drop("n"), list(keys))


# ---------------------------------------------------------------- feature vectors
def norm_stats(df: DataFrame, features: str) -> DataFrame:
    """Mean and population SD of every position of a feature array."""
    return df.select(F.posexplode(features).alias("pos", "x")).groupBy("pos").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n")
    )


def normalised(df: DataFrame, features: str, stats: DataFrame, name: str = "z") -> DataFrame:
    """Adds (x - mean) / (SD + 1e-8) of every position. The statistics are one row per position and enter the plan as
    one scalar array, so no cell is joined."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("s")).scalar()
    z = F.zip_with(features, "_stats", lambda x, s: (x - s["mean"]) / (s["std"] + F.lit(1e-8)))
    return df.withColumn("_stats", one).withColumn(name, z).drop("_stats")


def channel_stats(df: DataFrame, keys: Sequence[str], channels: str) -> DataFrame:
    """Mean and population SD per channel of an array<array<array<float>>> feature over all its cells.

    Cells stay in the map task: what is shuffled is a (count, mean, squared deviations) triple for each key and channel,
    which merge without the cancellation of E[x^2] - E[x]^2. NULL cells are not counted.
    """
    cells = df.select(*keys, F.posexplode(channels).alias("channel", "_m")).select(
        *keys, "channel", F.posexplode(F.flatten("_m")).alias("_at", "_x")
    )
    x = F.col("_x").cast("double")
    return cells.groupBy(*keys, "channel").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n_cells"), F.count(F.when(F.col("_at") == 0, 1)).alias("n_windows")
    )


def channel_normalised(df: DataFrame, keys: Sequence[str], channels: str, stats: DataFrame, name: str = "z") -> DataFrame:
    """Adds (x - mean) / (SD + 1e-8) of every cell by the statistics of its key and channel, in the shape of the feature.

    Statistics are one row for each key and channel, far fewer than windows. A key or channel without any gives NULL.
    """
    one = stats.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "std")))).alias("_stats"))

    def scaled(cells, channel):
        s = F.try_element_at("_stats", channel)
        return F.transform(cells, lambda row: F.transform(row, lambda x: (x.cast("double") - s["mean"]) / (s["std"] + F.lit(1e-8))))

    joined = df.join(one, list(keys), "left")
    return joined.withColumn(name, F.transform(channels, scaled)).drop("_stats")


def class_residual(df: DataFrame, features: str, label: str) -> DataFrame:
    """Class means, absolute mean gap and variance of every position of a feature array."""
    cells = df.select(label, F.posexplode(features).alias("pos", "x"))
    t = cells.groupBy("pos").agg(
        F.avg(F.when(F.col(label) == 0, F.col("x"))).alias("mean_0"),
        F.avg(F.when(F.col(label) == 1, F.col("x"))).alias("mean_1"),
        F.var_pop("x").alias("variance"),
    )
    return t.withColumn("residual", F.abs(F.col("mean_0") - F.col("mean_1")))


def feature_sanity(df: DataFrame, keys: Sequence[str], features: str) -> DataFrame:
    """Shapes, extremes, undefined values, and mean and SD over all cells."""
    x = F.col(features)
    rows = df.select(
        *keys,
        F.size(x).alias("_d"),
        F.array_min(x).alias("_lo"),
        F.array_max(x).alias("_hi"),
        F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))).alias("_bad"),
        F.aggregate(x, F.lit(0.0), lambda s, v: s + v).alias("_s"),
        F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v).alias("_q"),
    )
    t = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_d").alias("dim_min"),
        F.max("_d").alias("dim_max"),
        F.min("_lo").cast("double").alias("min"),
        F.max("_hi").cast("double").alias("max"),
        F.count(F.when(F.col("_bad"), 1)).alias("n_undefined"),
        F.sum("_s").alias("_s"),
        F.sum("_q").alias("_q"),
        F.sum("_d").alias("_c"),
    )
    mean = F.col("_s") / F.col("_c")
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("_c") - mean * mean, F.lit(0.0)))
    return t.withColumns({"mean": mean, "sd": sd}).drop("_s", "_q", "_c")
