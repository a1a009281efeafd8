"""Perturbation sweeps over long-format signals, and the comparison of every condition with the clean one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigeval.functions.columns import as_col, hash_normal, ratio, stable_seed
from sigeval.operators.metrics import auc_eer, score_points, with_rates
from sigeval.operators.signal import signal_stats, trim_bounds

#: Kinds of condition and the unit that follows the number in a name.
UNITS = {"noise_snr": "", "clip_": "dB", "dither_": "dBFS", "append_silence_": "", "speed_": "", "reverb_rt": ""}


def parsed(name: str) -> tuple[str, float | None]:
    """Kind of a condition and its number, if the kind has one: `clip_+6dB` is ("clip_", 6.0)."""
    for kind, unit in UNITS.items():
        if name.startswith(kind) and name.endswith(unit):
            return kind, float(name[len(kind) : len(name) - len(unit)])
    return name, None


def amplitude(decibel: float) -> float:
    return 10.0 ** (decibel / 20.0)


def _pointwise(name: str, seed: int) -> Column | None:
    """Sample expression of a condition that keeps the sample count; reads the signal's statistics."""
    v = F.col("v")
    noise = hash_normal(F.lit(str(seed)), "rec", F.lit(name), "i")
    kind, number = parsed(name)
    if kind in ("clean", "append_silence_"):
        return v
    if kind == "noise_snr":
        return v + noise * F.sqrt((F.col("power") + F.lit(1e-12)) / F.lit(10.0 ** (number / 10.0)))
    if kind == "clip_":  # full scale lowered by the gain
        g = amplitude(-number)
        return F.greatest(F.least(v, F.lit(g)), F.lit(-g))
    if name == "trim_trailing":
        return F.when(F.col("i") < F.col("end"), v)
    if name == "add_dc_neg":
        return v - F.lit(0.001) * F.col("peak")
    if name == "remove_dc":
        return v - F.col("mean")
    if kind == "dither_":
        return v + F.lit(amplitude(number)) * noise
    return None


def perturb(
    sig: DataFrame, conditions: Sequence[str], rate: int = 16000, frame: int = 400, hop: int = 160, top_db: float = 40.0, seed: int = 0
) -> DataFrame:
    """Every signal under every condition: (rec, condition, i, v). The other columns of `sig` are dropped.

    Conditions that act on samples are expanded from one scan; speed and reverberation have their own plans.
    """
    sig = sig.select("rec", "i", "v")
    simple = [c for c in conditions if parsed(c)[0] not in ("speed_", "reverb_rt")]
    if unknown := [c for c in simple if _pointwise(c, seed) is None]:
        raise ValueError(f"conditions without a rule: {unknown}")
    parts = []
    if simple:
        stats = signal_stats(sig)
        if "trim_trailing" in simple:
            stats = stats.join(trim_bounds(sig, frame, hop, top_db, trailing_only=True).select("rec", "end"), "rec")
        rows = F.array(*[F.struct(F.lit(c).alias("condition"), _pointwise(c, seed).alias("v")) for c in simple])
        parts.append(
            sig.join(stats, "rec").select("rec", "i", F.inline(rows)).where(F.col("v").isNotNull()).select("rec", "condition", "i", "v")
        )
        for c in simple:
            if parsed(c)[0] == "append_silence_":
                extra = int(parsed(c)[1] * rate)
                if extra:
                    more = F.sequence(F.col("n"), F.col("n") + (extra - 1))
                    parts.append(
                        stats.select("rec", F.lit(c).alias("condition"), F.explode(more).alias("i"), F.lit(0.0).alias("v"))
                    )
    for c in conditions:
        kind, number = parsed(c)
        if kind == "speed_":
            parts.append(change_speed(sig, number).select("rec", F.lit(c).alias("condition"), "i", "v"))
        elif kind == "reverb_rt":
            y = reverberate(sig, number, rate, seed)
            parts.append(y.select("rec", F.lit(c).alias("condition"), "i", "v"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def change_speed(sig: DataFrame, factor: float) -> DataFrame:
    """Play at `factor` times the speed by linear interpolation.

    Output j lies at input position j * factor. Each sample is sent to the outputs on both of its sides
    with its interpolation weight, and the outputs are summed, so no signal is held in one task.
    """
    n = sig.groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    i = F.col("i")
    first = F.greatest(F.floor((i - 1) / F.lit(factor)), F.lit(0)).cast("long")
    last = F.ceil((i + 1) / F.lit(factor)).cast("long")
    spread = sig.join(n, "rec").select("rec", "i", "v", "n", F.explode(F.sequence(first, last)).alias("j"))
    at = F.col("j") * F.lit(factor)
    weight = F.lit(1.0) - F.abs(at - i)
    out = spread.where((weight > 0) & (at <= F.col("n") - 1)).withColumn("_w", weight)
    return out.groupBy("rec", F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def room_response(rt60: float, rate: int, seed: int, rec: str = "rec") -> Column:
    """Response of a room of its own for each recording: the direct sound, then noise whose level falls by 60 dB in
    `rt60` seconds; all of it scaled to unit energy. The noise is a stable hash of recording and tap."""
    taps = max(int(rt60 * rate), 1)
    late = F.array().cast("array<double>")
    if taps > 1:
        noise = lambda k: hash_normal(F.lit(str(seed)), rec, F.lit(f"reverb_rt{rt60:g}"), k)
        late = F.transform(F.sequence(F.lit(1), F.lit(taps - 1)), lambda k: noise(k) * F.pow(F.lit(amplitude(-60.0 / taps)), k))
    # the energy is summed once, so it is a column of its own
    return F.transform(
        F.array(F.concat(F.array(F.lit(1.0)), late)),
        lambda h: F.struct(h.alias("h"), F.sqrt(F.aggregate(h, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")),
    )[0]


def reverberate(sig: DataFrame, rt60: float, rate: int = 16000, seed: int = 0, block: int = 16384) -> DataFrame:
    """Convolve every recording with its room response; the peak stays that of the dry recording.

    Overlap-add: fixed-size blocks of a signal are convolved independently and their outputs summed.
    """

    def convolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ys = []
            for x, h in zip(pdf["x"], pdf["h"], strict=True):
                n = 1 << (len(x) + len(h) - 2).bit_length()
                ys.append(np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x) + len(h) - 1])
            yield pd.DataFrame({"rec": pdf["rec"], "first": pdf["first"], "y": ys})

    rec_type = dict(sig.dtypes)["rec"]
    blocks = (
        sig.groupBy("rec", F.floor(F.col("i") / block).alias("_b"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s"))
        .select("rec", (F.col("_b") * block).cast("long").alias("first"), F.transform("_s", lambda s: s.v).alias("x"))
    )
    room = sig.select("rec").distinct().withColumn("room", room_response(rt60, rate, seed))
    room = room.select("rec", F.transform("room.h", lambda x: x / F.col("room.norm")).alias("h"))
    wet = blocks.join(room, "rec").mapInPandas(convolve, f"rec {rec_type}, first long, y array<double>")
    cells = wet.select("rec", "first", F.posexplode("y").alias("k", "y"))
    y = cells.groupBy("rec", (F.col("first") + F.col("k")).alias("i")).agg(F.sum("y").alias("y"))
    stats = signal_stats(sig).select("rec", "n", "peak")
    kept = y.join(stats, "rec").where(F.col("i") < F.col("n"))
    top = kept.groupBy("rec").agg(F.max(F.abs("y")).alias("_top"))
    level = F.when(F.col("_top") > 0, F.col("peak") / F.col("_top")).otherwise(0.0)
    return kept.join(top, "rec").select("rec", "i", (F.col("y") * level).alias("v"))


def clipped_flag(condition: Column, peak: Column, conditions: Sequence[str]) -> Column:
    """Whether a recording's peak exceeds the level of its clip condition; false for other conditions."""
    out = F.lit(False)
    for c in conditions:
        kind, number = parsed(c)
        if kind == "clip_":
            out = F.when(condition == c, peak > amplitude(-number)).otherwise(out)
    return out


# ---------------------------------------------------------------- comparison with clean
def with_clean(df: DataFrame, keys: Sequence[str], item: str, score: str = "score") -> DataFrame:
    """Add the item's clean score; an item without one is an error."""
    on = [*keys, item]
    clean = df.where(F.col("condition") == "clean").select(*on, F.col(score).alias("_c"))
    missing = F.raise_error(F.concat(F.lit("no clean score for "), F.col(item).cast("string"))).cast("double")
    return df.join(clean, on, "left").withColumn("clean_score", F.coalesce("_c", missing)).drop("_c")


def condition_shift(df: DataFrame, keys: Sequence[str], item: str, threshold) -> DataFrame:
    """Score shift and decision flip of every row against the clean row of its item."""
    t = as_col(threshold)
    x = with_clean(df, keys, item)
    return x.withColumns(
        {
            "shift": F.col("score") - F.col("clean_score"),
            "flipped": (F.col("score") >= t) != (F.col("clean_score") >= t),
        }
    )


def robustness_summary(df: DataFrame, keys: Sequence[str], item: str, threshold) -> DataFrame:
    """One row per (keys, condition): quality at the threshold, score shifts, flips and input changes.

    `df` has label, condition, score, input_changed and clipped.
    """
    by = [*keys, "condition"]
    t = as_col(threshold)
    x = condition_shift(df, keys, item, threshold)
    y, hit = F.col("label"), F.col("score") >= t
    flip, changed = F.col("flipped").cast("int"), F.col("input_changed")
    clip = F.when(F.col("condition").startswith("clip_"), F.col("clipped").cast("int"))
    counts = x.groupBy(*by).agg(
        F.count(F.when((y == 1) & hit, 1)).alias("tp"),
        F.count(F.when((y == 0) & ~hit, 1)).alias("tn"),
        F.count(F.when((y == 0) & hit, 1)).alias("fp"),
        F.count(F.when((y == 1) & ~hit, 1)).alias("fn"),
        F.avg(F.when(y == 0, F.col("shift"))).alias("mean_score_shift_bonafide"),
        F.avg(F.when(y == 1, F.col("shift"))).alias("mean_score_shift_spoof"),
        F.avg(flip).alias("decision_flip_rate"),
        F.avg(changed.cast("int")).alias("share_input_changed"),
        F.avg(F.when(changed, flip)).alias("decision_flip_rate_changed"),
        F.avg(F.when(y == 0, clip)).alias("share_clipped_bonafide"),
        F.avg(F.when(y == 1, clip)).alias("share_clipped_spoof"),
    )
    ranking = auc_eer(score_points(df, by, "label", "score"), by, "score").drop("eer_threshold")
    return with_rates(counts).join(ranking, by).select(
        *by, "n", "auc", "eer", "accuracy",
        F.col("recall_spoof_sensitivity").alias("sensitivity"),
        F.col("specificity_bonafide_recall").alias("specificity"),
        "mean_score_shift_bonafide", "mean_score_shift_spoof", "decision_flip_rate", "share_input_changed",
        "decision_flip_rate_changed", "share_clipped_bonafide", "share_clipped_spoof",
    )


def robustness_delta(summary: DataFrame, model: Sequence[str], split: str, splits: Sequence[str]) -> DataFrame:
    """AUC and its change from clean, one row per (model, condition), two columns per split."""
    clean = summary.where(F.col("condition") == "clean").select(*model, split, F.col("auc").alias("_clean"))
    d = summary.join(clean, [*model, split]).withColumn("delta", F.col("auc") - F.col("_clean"))
    wide = d.groupBy(*model, "condition").pivot(split, list(splits)).agg(F.first("auc").alias("auc"), F.first("delta").alias("delta"))
    return wide


# ---------------------------------------------------------------- band masking
def band_mask(features, item, prob: Column) -> Column:
    """Array of (keep, x): whole positions are zeroed with probability `prob`, by a hash of item and position."""

    def cell(x, j):
        keep = (prob == 0.0) | (stable_seed(as_col(item), j) / F.lit(4294967296.0) > prob)
        return F.struct(keep.alias("keep"), F.when(keep, x.cast("double")).otherwise(F.lit(0.0)).alias("x"))

    return F.transform(as_col(features), cell)
