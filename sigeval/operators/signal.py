"""Long-format signals (rec, i, v): frames, trimming, windows, conditioning and descriptors.

A signal may be far longer than one task can hold, so nothing groups by `rec` alone except aggregates
with a map-side part. Samples reach their frames and windows by an explode of the few indices that
contain them, which turns the overlap condition into an equi-join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigeval.functions.columns import hash_normal
from sigeval.session import spread, stage

EPS = 1e-12


def decibel(power: Column) -> Column:
    return F.lit(10.0) * F.log10(power + F.lit(EPS))


def signal_stats(sig: DataFrame) -> DataFrame:
    """Length, peak, mean and mean power of each signal."""
    v = F.col("v")
    return sig.groupBy("rec").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(v)).alias("peak"), F.avg(v).alias("mean"), F.avg(v * v).alias("power")
    )


def scale_to_peak(sig: DataFrame) -> DataFrame:
    """Divide each signal by its largest absolute sample; silence stays silent."""
    s = signal_stats(sig).select("rec", "peak")
    return sig.join(s, "rec").withColumn("v", F.when(F.col("peak") > 0, F.col("v") / F.col("peak")).otherwise(F.col("v"))).drop("peak")


def _frames_of(i: Column, win: int, hop: int) -> Column:
    """Indices of the frames [f * hop, f * hop + win) that contain sample i."""
    last = F.floor(i / hop).cast("long")
    first = F.greatest(F.ceil((i - (win - 1)) / F.lit(hop)).cast("long"), F.lit(0).cast("long"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def frame_energy(sig: DataFrame, win: int, hop: int, keys: tuple[str, ...] = ("rec",), index: str = "i") -> DataFrame:
    """Energy in dB of every whole frame."""
    v = F.col("v")
    framed = sig.select(*keys, F.explode(_frames_of(F.col(index), win, hop)).alias("frame"), v)
    sums = framed.groupBy(*keys, "frame").agg(F.sum(v * v).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return sums.where(F.col("_n") == win).select(*keys, "frame", decibel(F.col("_s") / F.lit(float(win))).alias("energy_db"))


def active_range(sig: DataFrame, win: int, hop: int, top_db: float) -> DataFrame:
    """First and last frame within top_db of the loudest one, the share of such frames, and the last frame."""
    e = frame_energy(sig, win, hop)
    top = e.groupBy("rec").agg(F.max("energy_db").alias("_top"))
    active = F.col("energy_db") > F.col("_top") - top_db
    return e.join(top, "rec").groupBy("rec").agg(
        F.min(F.when(active, F.col("frame"))).alias("first"),
        F.max(F.when(active, F.col("frame"))).alias("last"),
        F.avg(active.cast("int")).alias("activity_ratio"),
        F.max("frame").alias("last_frame"),
    )


def trim_bounds(sig: DataFrame, win: int, hop: int, top_db: float = 40.0, trailing_only: bool = False) -> DataFrame:
    """Kept sample range [start, end) of each signal; signals of at most one frame are kept whole.

    With `trailing_only` the start is untouched, and a signal that ends in sound keeps its last samples.
    """
    n = sig.groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    b = n.join(active_range(sig, win, hop, top_db), "rec", "left")
    zero, end = F.lit(0).cast("long"), F.least(F.col("n"), F.col("last") * hop + win)
    whole = F.col("first").isNull() | (F.col("n") <= win)
    if trailing_only:
        start, end = zero, F.when(F.col("last") == F.col("last_frame"), F.col("n")).otherwise(end)
    else:
        start = F.col("first") * hop
    return b.select(
        "rec", "n", F.when(whole, zero).otherwise(start).alias("start"), F.when(whole, F.col("n")).otherwise(end).alias("end")
    )


def cut_to(sig: DataFrame, bounds: DataFrame) -> DataFrame:
    """Samples inside the bounds, renumbered from 0."""
    b = bounds.select("rec", "start", "end")
    inside = (F.col("i") >= F.col("start")) & (F.col("i") < F.col("end"))
    return sig.join(b, "rec").where(inside).withColumn("i", F.col("i") - F.col("start")).drop("start", "end")


def trim_silence(sig: DataFrame, win: int, hop: int, top_db: float = 40.0) -> DataFrame:
    return cut_to(sig, trim_bounds(sig, win, hop, top_db))


# ---------------------------------------------------------------- windows
def hop_of(win: int, overlap: float) -> int:
    return int(win * (1.0 - overlap))


def cut_windows(sig: DataFrame, win: int, overlap: float = 0.10, repeat: bool = False) -> DataFrame:
    """Windows as rows (rec, window, start, pad_fraction, pos, v).

    A signal of at most one window gives window 0, filled with zeros or (with `repeat`) by repeating the
    signal. Longer signals give a window every hop; an incomplete tail is dropped, or (with `repeat`)
    covered by one more window that ends at the signal's end.
    """
    hop = hop_of(win, overlap)
    lengths = sig.groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    i, n = F.col("i"), F.col("n")
    zero = F.lit(0).cast("long")
    short = n <= win
    regular = F.floor((n - win) / hop).cast("long") + 1
    slot = lambda w, s, p: F.struct(w.alias("window"), s.alias("start"), p.alias("pos"))

    copies = F.sequence(i, F.lit(win - 1).cast("long"), n) if repeat else F.array(i)
    short_slots = F.transform(copies, lambda p: slot(zero, zero, p))
    long_slots = F.transform(
        F.filter(_frames_of(i, win, hop), lambda w: w < regular), lambda w: slot(w, w * hop, i - w * hop)
    )
    if repeat:
        tail = ((regular - 1) * hop + win < n) & (i >= n - win)
        extra = F.when(tail, F.array(slot(regular, n - win, i - (n - win)))).otherwise(
            F.array().cast("array<struct<window:bigint,start:bigint,pos:bigint>>")
        )
        long_slots = F.concat(long_slots, extra)
    pad = F.when(short, F.lit(1.0) - n / F.lit(float(win))).otherwise(F.lit(0.0))
    cut = sig.join(lengths, "rec").select(
        "rec", pad.alias("pad_fraction"), "v", F.explode(F.when(short, short_slots).otherwise(long_slots)).alias("s")
    )
    out = cut.select("rec", "s.window", "s.start", "pad_fraction", "s.pos", "v")
    if repeat:
        return out
    zeros = lengths.where(n < win).select(
        "rec",
        zero.alias("window"),
        zero.alias("start"),
        pad.alias("pad_fraction"),
        F.explode(F.sequence(n, F.lit(win - 1).cast("long"))).alias("pos"),
        F.lit(0.0).alias("v"),
    )
    return out.unionByName(zeros)


def _within() -> Window:
    return Window.partitionBy("rec", "window")  # one window holds a fixed number of samples


def normalise_windows(w: DataFrame) -> DataFrame:
    """Scale each window to a peak of 1; an all-zero window stays zero."""
    peak = F.max(F.abs("v")).over(_within())
    return w.withColumn("_p", peak).withColumn("v", F.when(F.col("_p") > 0, F.col("v") / F.col("_p")).otherwise(F.col("v"))).drop("_p")


def window_mean(*keys: str) -> Column:
    """Mean of a window's samples, summed in sample order so that equal inputs give equal bits."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return F.avg("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def condition_windows(w: DataFrame, dither_dbfs: float | None = -60.0, seed: int = 0, remove_dc: bool = True) -> DataFrame:
    """Subtract the window mean and add seeded white noise of the given RMS level."""
    if remove_dc:
        w = w.withColumn("v", F.col("v") - window_mean("rec", "window"))
    if dither_dbfs is not None:
        level = 10.0 ** (dither_dbfs / 20.0)
        w = w.withColumn("v", F.col("v") + F.lit(level) * hash_normal(F.lit(str(seed)), "rec", "window", "pos"))
    return w


def segment(
    sig: DataFrame, scheme: str, win: int, overlap: float = 0.10, frame: int = 400, frame_hop: int = 160,
    top_db: float = 40.0, dither_dbfs: float = -60.0, seed: int = 0,
) -> DataFrame:
    """Windows by scheme: `original`, `trim_repeat` or `controlled` (trim_repeat, then mean removal and dither)."""
    if scheme == "original":
        return normalise_windows(cut_windows(scale_to_peak(sig), win, overlap))
    if scheme not in ("trim_repeat", "controlled"):
        raise ValueError(f"no such windowing: {scheme}")
    # every step joins and sorts by recording: in one plan they share a task, and its memory is the sum of all of them
    scaled = stage(scale_to_peak(sig))
    bounds = stage(trim_bounds(spread(scaled, "rec"), frame, frame_hop, top_db))
    trimmed = stage(cut_to(spread(scaled, "rec"), bounds))
    w = normalise_windows(cut_windows(spread(trimmed, "rec"), win, overlap, repeat=True))
    return condition_windows(w, dither_dbfs, seed) if scheme == "controlled" else w


def window_arrays(w: DataFrame) -> DataFrame:
    """One row per window with its samples as an array (a fixed number of elements)."""
    g = w.groupBy("rec", "window", "start", "pad_fraction").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s"))
    return g.withColumn("samples", F.transform("_s", lambda s: s.v)).drop("_s")


def input_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest absolute sample difference between two window lists per signal; infinite if the counts differ."""
    x = a.select("rec", "window", F.col("samples").alias("_a")).join(
        b.select("rec", "window", F.col("samples").alias("_b")), ["rec", "window"], "full"
    )
    d = F.array_max(F.zip_with("_a", "_b", lambda p, q: F.abs(p - q)))
    d = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit(float("inf"))).otherwise(d)
    return x.groupBy("rec").agg(F.max(d).alias("input_max_abs_diff"))


# ---------------------------------------------------------------- descriptors
def signal_descriptors(sig: DataFrame, win: int, hop: int, top_db: float = 40.0, full_scale: float = 1.0) -> DataFrame:
    """Time-domain recording descriptors.

    clip_ratio: share of samples at 99.9 % of full scale or more. leading/trailing: samples outside the
    trim bounds. snr_proxy_db: loudest minus quietest frame. zcr: sign changes of the mean-free signal
    per pair of neighbours.
    """
    v = F.col("v")
    base = sig.groupBy("rec").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(v)).alias("peak_abs"),
        F.avg((F.abs(v) >= 0.999 * full_scale).cast("int")).alias("clip_ratio"),
        F.avg((v == 0).cast("int")).alias("exact_zero_ratio"),
        F.avg(v).alias("dc_offset"),
        decibel(F.avg(v * v)).alias("rms_dbfs"),
    )
    bounds = trim_bounds(sig, win, hop, top_db).select("rec", "start", "end")
    act = active_range(sig, win, hop, top_db).select("rec", "activity_ratio")
    snr = frame_energy(sig, win, hop).groupBy("rec").agg((F.max("energy_db") - F.min("energy_db")).alias("snr_proxy_db"))
    centred = sig.join(base.select("rec", "dc_offset"), "rec").select("rec", "i", F.signum(v - F.col("dc_offset")).alias("s"))
    following = centred.select("rec", (F.col("i") - 1).alias("i"), F.col("s").alias("s2"))
    zcr = centred.join(following, ["rec", "i"]).groupBy("rec").agg(F.avg((F.col("s") * F.col("s2") < 0).cast("int")).alias("zcr"))
    out = base.join(bounds, "rec", "left").join(act, "rec", "left").join(snr, "rec", "left").join(zcr, "rec", "left")
    return out.withColumns({"leading_silence": F.col("start"), "trailing_silence": F.col("n") - F.col("end")}).drop("start", "end")


def window_descriptors(
    w: DataFrame, win: int, hop: int, floor_db: float = -60.0, quiet_db: float = 30.0, clip: float = 0.999
) -> DataFrame:
    """Content-free descriptors of each window from its frames and samples.

    floor frame: energy at most floor_db. quiet frame: more than quiet_db below the loudest frame.
    noise_floor_db: 10 % quantile of the frame energies.
    """
    keys = ("rec", "window")  # a window has a fixed number of frames, so these windows and quantiles are bounded
    e = frame_energy(w, win, hop, keys, "pos").withColumn("_top", F.max("energy_db").over(_within()))
    loud = F.when(F.col("energy_db") > floor_db, F.col("frame"))
    frames = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_f"),
        F.avg((F.col("energy_db") <= floor_db).cast("int")).alias("floor_frame_ratio"),
        F.min(loud).alias("_first"),
        F.max(loud).alias("_last"),
        F.avg((F.col("energy_db") < F.col("_top") - quiet_db).cast("int")).alias("quiet_frame_ratio"),
        F.percentile("energy_db", F.lit(0.1)).alias("noise_floor_db"),
    )
    samples = w.groupBy(*keys).agg(
        F.max("pad_fraction").alias("pad_fraction"),
        F.avg("v").alias("dc"),
        F.avg((F.abs("v") >= clip).cast("int")).alias("clip_ratio"),
    )
    n = F.col("_f")
    return (
        samples.join(frames, list(keys), "left")
        .withColumns(
            {
                "lead_floor_frac": F.coalesce(F.col("_first"), n) / n,
                "trail_floor_frac": (n - 1 - F.coalesce(F.col("_last"), F.lit(-1))) / n,
            }
        )
        .drop("_f", "_first", "_last")
    )
