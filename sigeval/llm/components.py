"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (a, b): root is the smallest node of its component, itself included.

    Each round hangs a node's larger neighbours, then its smaller ones, on its smallest neighbour; the rounds grow
    with the logarithm of the longest path. Only minima are gathered, never a node's neighbours, and each round is
    written to the shared folder, so lost executors repeat one round at most. NULL ends are left out.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    stars = stage(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(b.alias("v"), a.alias("u")).distinct())
    state = _state(stars)
    while True:
        both = stars.select(F.col("v").alias("x"), F.col("u").alias("y")).union(stars.select("u", "v"))
        least = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        stars = stage(small.union(least.select("v", F.col("m").alias("u"))).distinct())
        last, state = state, _state(stars)
        if state == last:
            break
    roots = stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
