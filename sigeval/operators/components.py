"""Connected components of a link table.

Every node hangs on the smallest node it knows: in turn its larger neighbours and then its smaller ones move to the smallest of
its neighbourhood. Rounds grow with the logarithm of the longest path; each keeps only minima, so a node with a third of all links is no
list anywhere, and each is written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigeval.session import stage


def _mark(tree: DataFrame) -> tuple:
    return tuple(tree.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("child", "parent"))).first())


def components(links: DataFrame, a: str = "item_a", b: str = "item_b") -> DataFrame:
    """(node, component) for every end of a link; the component is its smallest node. Loops and NULL ends are left out."""
    ends = links.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"), F.col(a).isNull() | F.col(b).isNull()).toDF("child", "parent", "open")
    tree = stage(ends.where("NOT open AND child <> parent").select("child", "parent").distinct())
    mark = None
    while mark != (new := _mark(tree)):
        mark = new
        sides = tree.toDF("node", "other").union(tree.select("parent", "child"))
        lowest = sides.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
        moved = sides.where("other > node").join(lowest, "node").select(F.col("other").alias("child"), F.col("low").alias("parent")).distinct()
        top = moved.groupBy("child").agg(F.min("parent").alias("top"))
        others = moved.join(top, "child").where("parent <> top").select(F.col("parent").alias("child"), F.col("top").alias("parent"))
        tree = stage(others.union(top.select("child", F.col("top").alias("parent"))).distinct())
    tops = tree.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return tree.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(tops)
