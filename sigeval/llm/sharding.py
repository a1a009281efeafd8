"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Packing is sequential, so it must see a bounded list. Equal texts form a group. A group with over one part in
`BUNDLES` per shard of all bytes, tokens or rows is large (there are at most three times shards x BUNDLES of them);
all others are hashed into shards x BUNDLES bundles. Large groups and bundles are placed one by one, the largest first,
where the dot product of their vector with the residual capacity is highest. A group that alone exceeds a
shard's share is split into pieces that are placed on their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, stage, word_count

BUNDLES = 256
OVERHEAD = 16  # bytes of a row besides its text


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector (rows of `vectors`, columns are resources), in the given order.

    Vectors and capacities are in shares of a shard. Among the shards in which a vector fits it goes where the dot
    product with the residual capacity is highest; if it fits nowhere, all shards compete. The lowest number wins a tie.
    """
    total = vectors.sum(axis=0)
    scaled = vectors / np.where(total > 0, total, 1.0) * shards
    residual = np.ones((shards, vectors.shape[1]))
    out = np.empty(len(vectors), dtype=np.int32)
    for i, v in enumerate(scaled):
        score = residual @ v
        fits = (residual >= v).all(axis=1)
        out[i] = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        residual[out[i]] -= v
    return out


def _pack(shards: int):
    def run(batches):
        units = [b for b in batches if len(b)]
        if not units:
            return
        units = pd.concat(units, ignore_index=True).sort_values(["item", "unit", "piece"], ignore_index=True)
        items = units.groupby("item", sort=True)[["bytes", "tokens", "rows"]].sum()
        vectors = items.to_numpy(dtype=np.float64)
        total = vectors.sum(axis=0)
        largest = (vectors / np.where(total > 0, total, 1.0)).max(axis=1)
        order = np.lexsort((np.arange(len(items)), -largest))
        shard = np.empty(len(items), dtype=np.int32)
        shard[order] = place(vectors[order], shards)
        units["shard"] = units["item"].map(pd.Series(shard, index=items.index))
        units["base"] = units.groupby("shard")["rows"].cumsum() - units["rows"]
        yield units[["unit", "piece", "shard", "base"]]

    return run


def shard(
    docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", keep: bool = False, bundles: int = BUNDLES
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot (gapless from 0 within a shard).

    Size is the UTF-8 bytes of the text (NULL: none) plus 16; tokens are words between ASCII white space. NULL and empty
    texts are one group, with checksum 0. Rows that repeat key and text follow each other. An empty table gives an
    empty result. With `keep` the input columns are returned with a struct `sharded` of the above instead.
    """
    spark, count = docs.sparkSession, shards * bundles
    body = filled(text)
    own = [
        F.col(key).alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), word_count(text).alias("tokens"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"),
    ]
    # with `keep` the input is staged too, because the order of repeated rows must not change between two reads
    rows = stage(docs.select(*([F.struct(*docs.columns).alias("_row")] if keep else []), F.struct(*own).alias("own")))
    narrow = rows.select("own.*")
    total = narrow.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
    ).first()
    limit = {k: max(1.0, total[k] / count) for k in ("rows", "bytes", "tokens")}
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens")]

    groups = narrow.groupBy("digest").agg(*sums)
    over = F.greatest(*[F.col(k) / F.lit(v) for k, v in limit.items()])
    large = groups.withColumn("over", over).where(F.col("over") > 1.0)
    # at most 3 x shards x bundles rows: numbering them is one small task
    large = stage(
        large.select(
            "digest", (F.row_number().over(Window.orderBy("digest")) - 1 + count).cast("long").alias("unit"),
            F.ceil("over").cast("int").alias("pieces"), (F.col("over") > bundles).alias("split"),
        )
    )
    tagged = rows.join(F.broadcast(large), rows["own.digest"] == large["digest"], "left").drop("digest")
    tagged = tagged.select(
        *rows.columns,
        F.coalesce("unit", F.pmod(F.xxhash64("own.digest"), F.lit(count))).alias("unit"),
        F.coalesce(F.pmod(F.hash("own.doc_id"), F.col("pieces")), F.lit(0)).alias("piece"),
        F.coalesce("split", F.lit(False)).alias("split"),
    )
    # an item is what is placed as a whole: a bundle, a large group, or one piece of a split group
    item = F.col("unit") * (1 << 20) + F.when(F.col("split"), F.col("piece")).otherwise(0)
    units = tagged.select("own.*", "unit", "piece", item.alias("item")).groupBy("item", "unit", "piece").agg(*sums)
    # summed up before it is one task's: at most 7 x shards x bundles rows
    placed = stage(units).coalesce(1).mapInPandas(_pack(shards), "unit long, piece int, shard int, base long")
    placed = stage(placed)
    joined = tagged.join(F.broadcast(placed), ["unit", "piece"])  # at most 7 x shards x bundles rows
    inside = Window.partitionBy("unit", "piece").orderBy("own.doc_id", "own.digest")
    slot = F.col("base") + F.row_number().over(inside) - 1
    found = [F.col(f"own.{c}").alias(c) for c in ("doc_id", "size", "text_crc32")] + [F.col("shard"), slot.alias("slot")]
    out = joined.select(*rows.columns, F.struct(*found).alias("sharded"))
    return out.select("_row.*", "sharded") if keep else out.select("sharded.*")
