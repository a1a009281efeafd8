"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A group of copies can hold a third of all rows, so grouping by digest alone would put them into one task.
A Misra-Gries summary finds the digests that may be that frequent, one exact count over the candidates
verifies them, and the winners are broadcast: their rows are resolved on the map side and never shuffled.
All other digests take an ordinary aggregation with map-side combining and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, filled, stage

COUNTERS = 8192  # counters of the Misra-Gries summary
SHARE = 1 / 2048  # a digest with this share of the rows is heavy; at most 2,048 digests can be
MERGERS = 64  # tasks that merge the summaries of single partitions before the last merge


def normalised(text: str) -> Column:
    return F.regexp_replace(filled(text), SPACES, " ")


def frequent(rows: DataFrame, item: Column, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` items, among them every one with over 7 / 16,384 of the rows (at 8,192 counters).

    Spark's `approx_top_k` functions keep the mergeable Misra-Gries summary that decrements in batches; its
    error is at most 3.5 / 16,384 of the rows, and an item above twice the error is always reported.
    """
    parts = rows.select((F.spark_partition_id() % MERGERS).alias("part"), item.alias("item"))
    merged = parts.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(item, {counters})").alias("summary"))
    # grouped by a constant, because without a key empty tasks would hand in summaries that cannot be merged
    one = merged.groupBy(F.col("part") * 0).agg(F.expr("approx_top_k_combine(summary)").alias("summary"))
    return one.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {counters})")).alias("hit")).select("hit.item")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after every run of ASCII white space became one space. NULL texts are empty, and
    empty texts are a group like any other. Of equal texts the row with the smallest key stays, NULL keys last; of
    rows that also repeat the key, one stays. An empty table gives an empty result. Other columns are not read.
    """
    rows = stage(
        docs.select(
            F.col(key).alias("doc_id"),
            F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    group = [F.count(F.lit(1)).alias("group_size"), first.alias("first")]

    hashed = F.xxhash64("digest")
    likely = frequent(rows, hashed).withColumnRenamed("item", "h")
    total = rows.agg(F.count(F.lit(1))).scalar()
    heavy = stage(
        rows.withColumn("h", hashed)
        .join(F.broadcast(likely), "h")  # at most COUNTERS longs
        .groupBy("digest")
        .agg(*group)
        .where(F.col("group_size") >= total * F.lit(SHARE))
    )

    split = rows.join(F.broadcast(heavy), "digest", "left")  # at most 1 / SHARE rows
    hot = split.where(F.col("group_size").isNotNull())
    cold = split.where(F.col("group_size").isNull()).select(*rows.columns)
    cold = cold.join(cold.groupBy("digest").agg(*group), "digest")
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
