"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a target in words. A document's expected number of copies is its source's target over the
source's size. The whole part is allocated for certain. For the rest, documents are ranked by the odds of a stable
random number over their inclusion odds (Rosen's Pareto order sampling), and each source takes its lowest ranks up
to the words that are left: a sample of fixed size with unequal inclusion probabilities.

No source is ever sorted. A rank is mapped to (0, 1) and cut twice by 4,096; two histograms with map-side sums find
the one cell in which a source's sample ends, and only that cell (about one row in 16 million) is ordered. What
comes out is one cut per source, so a row decides for itself and nothing is joined back by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, stage, word_count

CELLS = 4096


def uniform(key: str, text: str) -> Column:
    """Number in (0, 1) from 52 bits of a digest of key and text; the same in every run and on every engine."""
    parts = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(filled(text)))
    return (F.conv(F.substring(F.md5(parts), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def cyclic_weights(sizes: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Weights repeating over the sources in code-point order, NULL last. One row per source, so the window is small."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = (F.row_number().over(order) - 1) % len(cycle)
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), at + 1))


def targets(weighted: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets that share `share` times all sizes by weight; none exceeds `most` times its source's size.

    The excess of capped sources is dealt out again by weight until none is above. That fixed point is a water level:
    in the order of (cap / weight), a source is capped if the level without the earlier caps reaches its own cap.
    One row per source; weights are positive.
    """
    everywhere = Window.partitionBy()
    rising = Window.orderBy("full", F.col("source").isNull(), "source")
    earlier, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    rows = weighted.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("all", F.sum("source_size").over(everywhere) * F.lit(share))
    level = (F.col("all") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("capped", F.col("full") <= level)
    caps = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everywhere)
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(everywhere)
    rows = rows.withColumn(
        "target", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("all") - caps) / free * F.col("weight"))
    )
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(copies)).withColumn("fraction", copies - F.floor(copies))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    return rows.select("source", "source_size", "weight", "target", "whole", "fraction", left.alias("left"))


def _rank(u: Column, fraction: Column, appeal: Column) -> Column:
    """Pareto rank mapped to (0, 1]: random odds over inclusion odds, q, as q / (1 + q)."""
    q = (u / (1.0 - u)) / (fraction / (1.0 - fraction) * appeal)
    return F.when((fraction > 0) & (appeal > 0), q / (1.0 + q)).otherwise(1.0)


def _ending(cells: DataFrame, cell: str) -> DataFrame:
    """Per source the cell in which the running words pass what is left, and the words before it."""
    order = Window.partitionBy("source").orderBy(cell)
    run = cells.withColumn("up_to", F.sum("words").over(order)).withColumn("below", F.col("up_to") - F.col("words"))
    return run.where((F.col("below") <= F.col("left")) & (F.col("left") < F.col("up_to")))


def mix(
    docs: DataFrame, weigh=cyclic_weights, share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text",
    source: str = "source", appeal: Column | None = None,
) -> DataFrame:
    """The input rows with a struct `mixed` (size, source_size, target, copies, taken) added.

    `weigh` adds `weight` to one row per source (source, source_size). `appeal` multiplies a row's inclusion odds
    (default 1; 0 keeps the row out of the sampled part). A source's sample ends with the document that holds its
    last word if at least half of it fits. Rows that repeat key and text are taken or left together. NULL texts have
    size 0, NULL sources are one source, texts without words are taken with 0 words; an empty table gives an empty
    result. Columns of the input are kept; one named `mixed` is replaced.
    """
    appeal = F.lit(1.0) if appeal is None else appeal
    rows = stage(
        docs.select(
            F.col(source).alias("source"), word_count(text).alias("size"), uniform(key, text).alias("u"),
            appeal.cast("double").alias("appeal"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stage(targets(weigh(sizes), share, most))

    def ranked(df):
        joined = df.join(plan, df["source"].eqNullSafe(plan["source"])).drop(plan["source"])
        rank = _rank(F.col("u"), F.col("fraction"), F.col("appeal"))
        scaled = F.col("rank") * CELLS
        return (
            joined.withColumn("rank", rank).where(F.col("rank") < 1.0)
            .withColumn("cell", F.floor(scaled)).withColumn("inner", F.floor((scaled - F.floor(scaled)) * CELLS))
        )

    def inside(df, cut, *cols):
        return df.join(cut, df["source"].eqNullSafe(cut["in_source"]) & (df["cell"] == cut["in_cell"])).drop(*cols)

    words = F.sum("size").alias("words")
    outer = _ending(ranked(rows).groupBy("source", "left", "cell").agg(words), "cell")
    outer = stage(outer.select(F.col("source").alias("in_source"), F.col("cell").alias("in_cell"), F.col("below").alias("before")))
    near = inside(ranked(rows), outer).withColumn("left", F.col("left") - F.col("before"))
    cell = _ending(near.groupBy("source", "left", "before", "cell", "inner").agg(words), "inner")
    cell = stage(
        cell.select(
            F.col("source").alias("in_source"), F.col("cell").alias("in_cell"), F.col("inner").alias("in_inner"), "below",
            ((F.col("cell") + F.col("inner") / CELLS) / CELLS).alias("start"),
        )
    )
    last = inside(near, cell).where(F.col("inner") == F.col("in_inner"))
    last = last.groupBy("source", "left", "below", "rank").agg(words)
    before = F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("rank")) - F.col("words")
    last = last.withColumn("fits", before + F.col("words") / 2 <= F.col("left")).where("fits")
    last = last.groupBy(F.col("source").alias("in_source")).agg(F.max("rank").alias("end"))

    # one row per source: everything below `start` is taken, and in the cell everything up to `end`; no cell, all
    cut = cell.join(last, cell["in_source"].eqNullSafe(last["in_source"]), "left").select(cell["in_source"], "start", "end")
    cut = plan.join(cut, plan["source"].eqNullSafe(cut["in_source"]), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "whole", "fraction",
        F.coalesce("start", F.lit(1.0)).alias("start"), F.coalesce("end", F.lit(-1.0)).alias("end"),
    )
    cut = stage(cut).select(F.struct("*").alias("_cut"))
    kept = [c for c in docs.columns if c != "mixed"]
    sized = docs.select(
        *kept,
        F.struct(word_count(text).alias("size"), uniform(key, text).alias("u"), appeal.cast("double").alias("appeal")).alias("_own"),
    )
    both = sized.join(cut, F.col(source).eqNullSafe(F.col("_cut._source")))
    rank = _rank(F.col("_own.u"), F.col("_cut.fraction"), F.col("_own.appeal"))
    more = ((rank < F.col("_cut.start")) | (rank <= F.col("_cut.end"))) & (rank < 1.0)
    copies = F.col("_cut.whole") + more.cast("long")
    return both.select(
        *kept,
        F.struct(
            F.col("_own.size").alias("size"), F.col("_cut.source_size").alias("source_size"),
            F.col("_cut.target").alias("target"), copies.alias("copies"), (copies * F.col("_own.size")).alias("taken"),
        ).alias("mixed"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as it was taken, `mixed` dropped."""
    times = F.sequence(F.lit(1), F.col("mixed.copies").cast("int"))
    return mixed.where(F.col("mixed.copies") > 0).withColumn("_times", F.explode(times)).drop("mixed", "_times")
