"""Streaming forms of two batch operators. The batch engine this library follows has no streams; these
are extensions that keep the batch results for data that arrives in time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigeval.session import stage_root


def stream_confusion(scores: DataFrame, ts: str, size: str, watermark: str, threshold: float) -> DataFrame:
    """Confusion counts per tumbling window of event time, for append output."""
    y, hit = F.col("label"), F.col("score") >= threshold
    w = scores.withWatermark(ts, watermark).groupBy(F.window(ts, size))
    return w.agg(
        F.count(F.when((y == 1) & hit, 1)).alias("tp"),
        F.count(F.when((y == 0) & ~hit, 1)).alias("tn"),
        F.count(F.when((y == 0) & hit, 1)).alias("fp"),
        F.count(F.when((y == 1) & ~hit, 1)).alias("fn"),
    ).select(F.col("window.start").alias("start"), "tp", "tn", "fp", "fn")


def stream_windows(samples: DataFrame, ts: str, size: str, slide: str, watermark: str) -> DataFrame:
    """Overlapping windows of each signal with sample count, mean and peak.

    Windows are aligned to the epoch, not to the start of the signal as the batch windows are.
    """
    w = samples.withWatermark(ts, watermark).groupBy("rec", F.window(ts, size, slide))
    return w.agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max(F.abs("v")).alias("peak")
    ).select("rec", F.col("window.start").alias("start"), "n", "mean", "peak")


def drain(source: str, like: DataFrame, build: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Processes the files that have come to `source` since the last call, and stops.

    State, watermark and the list of files seen are in `checkpoint`; the sink's log holds what was committed. A call that was
    broken off is repeated from there, so that no row is lost or counted twice.
    """
    stream = like.sparkSession.readStream.schema(like.schema).parquet(source)
    writer = build(stream).writeStream.format("parquet").outputMode("append").option("path", sink)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def by_instalments(rows: DataFrame, instalments: Sequence, part: str, ts: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Result of the stream `build` over rows that arrive by instalments, the values of column `part` in the order given.

    Each instalment is processed before the next one comes; rows of windows that the watermark of earlier instalments has
    passed are late, and are dropped. At the end a row of NULLs a year after the last event closes all windows; its own
    windows stay open and never leave the stream. Files lie below `spark.checkpoint.dir`.
    """
    root = f"{stage_root(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    source, sink, checkpoint = (f"{root}/{name}" for name in ("arrived", "results", "checkpoint"))
    plain = rows.drop(part)
    last = plain.agg((F.max(ts) + F.expr("INTERVAL 365 DAYS")).alias(ts))
    end = last.select(*[(F.col(c) if c == ts else F.lit(None).cast(t)).alias(c) for c, t in plain.dtypes])
    for arrived in [*(rows.where(F.col(part) == k).drop(part) for k in instalments), end]:
        arrived.write.mode("append").parquet(source)
        drain(source, plain, build, sink, checkpoint)
    return rows.sparkSession.read.parquet(sink)


def late_rows(rows: DataFrame, counted: DataFrame, ts: str, size: str) -> DataFrame:
    """Rows that arrived, rows that the stream counted (start, n) and rows that came too late, per tumbling window."""
    arrived = rows.groupBy(F.window(ts, size).alias("w")).agg(F.count(F.lit(1)).alias("arrived"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    both = arrived.select(F.col("w.start").alias("start"), "arrived").join(counted.select("start", "n"), "start", "left")
    return both.select("start", "arrived", n.alias("counted"), (F.col("arrived") - n).alias("late"))
