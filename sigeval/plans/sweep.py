"""The perturbation sweep from signals to one score per recording and condition."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigeval.operators import signal as G
from sigeval.operators import sweep as W
from sigeval.operators.probes import score_windows
from sigeval.session import spread, stage, tasks_for


def condition_scores(
    sig: DataFrame, items: DataFrame, conditions: Sequence[str], score: Callable[[np.ndarray], np.ndarray],
    scheme: str = "controlled", win: int = 96000, overlap: float = 0.10, frame: int = 400, frame_hop: int = 160,
    top_db: float = 40.0, rate: int = 16000, seed: int = 0,
) -> DataFrame:
    """(rec, columns of `items`, condition, score, input_changed, input_max_abs_diff, clipped).

    Recordings and conditions are one key, so the whole sweep is one job. The first condition must be
    `clean`; the windows of every other condition are compared with the clean ones.
    """
    if not conditions or conditions[0] != "clean":
        raise ValueError("conditions are compared with 'clean', which comes first")
    peaks = G.signal_stats(sig).select("rec", "peak")
    y = W.perturb(sig, conditions, rate, frame, frame_hop, top_db, seed)
    keyed = stage(y.select(F.struct("rec", "condition").alias("rec"), "i", "v"))
    # dither depends on the recording and window alone, so that clean and changed inputs share it
    w = G.segment(spread(keyed, "rec"), "original" if scheme == "original" else "trim_repeat", win, overlap, frame, frame_hop, top_db)
    w = w.select(F.col("rec.rec").alias("rec"), F.col("rec.condition").alias("condition"), "window", "start", "pad_fraction", "pos", "v")
    if scheme == "controlled":
        mean = G.window_mean("rec", "condition", "window")
        w = w.withColumn("v", F.col("v") - mean + F.lit(1e-3) * G.hash_normal(F.lit(str(seed)), "rec", "window", "pos"))
    tasks = tasks_for(keyed)  # windows hold about as many samples as the signals
    arrays = stage(
        w.repartition(tasks, "rec", "condition", "window").groupBy("rec", "condition", "window")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s"))
        .select("rec", "condition", "window", F.transform("_s", lambda s: s.v).alias("samples"))
    )
    scored = score_windows(arrays, "samples", score).groupBy("rec", "condition").agg(F.avg("logit").alias("score"))
    clean = arrays.where("condition = 'clean'").select("rec", "window", "samples")
    wanted = clean.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    both = arrays.select(F.struct("rec", "condition").alias("rec"), "window", "samples")
    same = wanted.select(F.struct("rec", "condition").alias("rec"), "window", "samples")
    diff = G.input_difference(both.repartition(tasks, "rec", "window"), same.repartition(tasks, "rec", "window")).select("rec.rec", "rec.condition", "input_max_abs_diff")
    out = scored.join(diff, ["rec", "condition"]).join(peaks, "rec").join(items, "rec")
    return out.withColumns(
        {
            "input_changed": F.col("input_max_abs_diff") > 0,
            "clipped": W.clipped_flag(F.col("condition"), F.col("peak"), conditions),
        }
    ).drop("peak")
