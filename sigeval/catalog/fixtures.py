"""The engine's input tables, derived from the test tables by plain DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigeval.functions.columns import cluster_id, stable_seed
from sigeval.operators.metrics import one_value
from sigeval.operators.ordering import row_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantised(x):
    """Multiples of 1/1024, whose sums are exact in any order."""
    return F.floor(x * 1024) / F.lit(1024.0)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window scores: a line item is a window, its order the item, its customer the speaker."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    h = F.conv(F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 8), 16, 10).cast("long") % 10
    split = (
        F.when(F.col("r_name") == "ASIA", "external_A")
        .when(F.col("r_name") == "EUROPE", "external_B")
        .when(h < 6, "train")
        .when(h < 8, "validation")
        .otherwise("internal_test")
    )
    homes = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    items = o.join(homes, o.o_custkey == homes.c_custkey).select(
        F.col("o_orderkey").alias("item"),
        F.col("o_custkey").alias("speaker_id"),
        F.col("r_name").alias("dataset_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("text_group"),
        (F.col("o_orderpriority") < "3").cast("int").alias("label"),
        split.alias("split"),
    )
    lines = li.select(
        F.col("l_orderkey").alias("item"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_shipdate",
        quantised(F.col("l_extendedprice") / 10000 - F.col("l_quantity") * F.col("l_discount")).alias("logit"),
        quantised(F.col("l_extendedprice") / 10000 + F.col("l_quantity") * F.col("l_tax")).alias("logit_b"),
        F.col("l_discount").alias("pad_fraction"),
    )
    return lines.join(items, "item")


ITEM_COLUMNS = ("label", "dataset_id", "speaker_id", "text_group", "split")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item scores of two detectors on the same items, with their resampling cluster."""
    pooled = windows(spark, sf_dir).groupBy("item").agg(
        *[one_value(c).alias(c) for c in ITEM_COLUMNS],
        F.avg("logit").alias("score"),
        F.avg("logit_b").alias("score_b"),
        F.count(F.lit(1)).alias("n_windows"),
        F.max("pad_fraction").alias("max_pad_fraction"),
    )
    return pooled.withColumn("cluster", cluster_id("dataset_id", "speaker_id", "text_group", speaker_corpus="ASIA"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-format signals: the values of a user in time order."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rec"), "ts", "event_id", (F.col("value") + F.lit(0.0)).alias("v")
    )
    return row_index(e, ["rec"], ["ts", "event_id"], "i").select(
        "rec", "i", "v", (F.col("rec") % 2).alias("label"), (F.col("rec") % 3).alias("dataset_id")
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("item"),
        F.col("toxic").alias("label"),
        "quality",
        "lang",
        "source",
        "n_chars",
        "text",
        F.sha2("text", 256).alias("h"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item"), "embedding", "label", (F.col("label") < 5).cast("int").alias("binary")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items of many runs: every line item belongs to the run of its part's brand."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    s = stable_seed("l_suppkey") % 3
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.regexp_replace("p_brand", "Brand#", "model").alias("model"),
        F.when(F.col("l_linestatus") == "O", "P1").otherwise("P2").alias("protocol"),
        F.when(s == 0, 42).when(s == 1, 123).otherwise(2026).alias("seed"),
        F.when(F.col("l_returnflag") == "A", "internal_test")
        .when(F.col("l_returnflag") == "N", "external_A")
        .otherwise("external_B")
        .alias("split"),
        (F.col("l_tax") > 0.04).cast("int").alias("label"),
        quantised(F.col("l_extendedprice") / 10000 - F.col("l_quantity") * F.col("l_discount")).alias("score"),
    )
