"""Pooling, confusion rates, exact ROC, AUC, equal error rate, thresholds and calibration.

Scores are collapsed to (key, score, positives, negatives) with running totals once
(`score_points`); every ranking metric is then a plain aggregate over those points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigeval.functions.columns import as_col, equal_width_bin, ratio, sigmoid
from sigeval.operators.ordering import ordered_totals


def one_value(c: str) -> Column:
    """The value of a column that must be constant in the group; an error if it is not."""
    return F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(
        F.raise_error(F.lit(f"column {c} differs inside one group"))
    )


def pool_scores(windows: DataFrame, item: str, score: str = "logit", first: Sequence[str] = ("label",)) -> DataFrame:
    """Mean of the window scores of each item, with the window count and largest padding share."""
    return windows.groupBy(item).agg(
        *[one_value(c).alias(c) for c in first],
        F.avg(score).alias("score"),
        F.count(F.lit(1)).alias("n_windows"),
        F.max("pad_fraction").alias("max_pad_fraction"),
    )


# ---------------------------------------------------------------- confusion
def confusion(df: DataFrame, keys: Sequence[str], label: str, predicted: Column, weight: Column | None = None) -> DataFrame:
    """tp, tn, fp, fn per key, optionally weighted."""
    one = F.lit(1).cast("long") if weight is None else weight
    y = as_col(label)

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, one)), F.lit(0)).cast("long")

    return df.groupBy(*keys).agg(
        total((y == 1) & predicted).alias("tp"),
        total((y == 0) & ~predicted).alias("tn"),
        total((y == 0) & predicted).alias("fp"),
        total((y == 1) & ~predicted).alias("fn"),
    )


def rate_columns() -> dict[str, Column]:
    """Rates of a confusion row. Undefined rates are NULL; F1 comes from the counts, so it is 0 when a
    class is present and never predicted correctly."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    pos, neg = tp + fn, tn + fp
    both = (pos > 0) & (neg > 0)
    sens, spec = ratio(tp, pos), ratio(tn, neg)
    f1_pos, f1_neg = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fn + fp)
    return {
        "n": pos + neg,
        "n_spoof": pos,
        "n_bonafide": neg,
        "accuracy": ratio(tp + tn, pos + neg),
        "balanced_accuracy": F.when(both, (sens + spec) * 0.5),
        "precision_spoof": ratio(tp, tp + fp),
        "recall_spoof_sensitivity": sens,
        "specificity_bonafide_recall": spec,
        "f1_spoof": f1_pos,
        "f1_macro": F.when(both, (f1_pos + f1_neg) * 0.5),
        "fpr": ratio(fp, neg),
        "fnr": ratio(fn, pos),
    }


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(rate_columns())


def binary_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, threshold) -> DataFrame:
    """Counts and rates at `score >= threshold`."""
    return with_rates(confusion(df, keys, label, as_col(score) >= as_col(threshold)))


def confusion_percent(counts: DataFrame) -> DataFrame:
    """Row-normalised confusion in percent."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns(
        {
            "pct_tn": ratio(tn, tn + fp) * 100,
            "pct_fp": ratio(fp, tn + fp) * 100,
            "pct_fn": ratio(fn, tp + fn) * 100,
            "pct_tp": ratio(tp, tp + fn) * 100,
        }
    )


# ---------------------------------------------------------------- ranking
def score_points(
    df: DataFrame, keys: Sequence[str], label: str, score: str, weight: Column | None = None, **cuts
) -> DataFrame:
    """Distinct scores per key with the positives and negatives at and below each of them."""
    w = F.lit(1).cast("long") if weight is None else weight
    y = as_col(label)
    return ordered_totals(
        df, keys, score, {"pos": F.when(y == 1, w).otherwise(F.lit(0)), "neg": F.when(y == 0, w).otherwise(F.lit(0))}, **cuts
    )


def auc_aggregate() -> Column:
    """Mann-Whitney AUC with ties at one half, as an aggregate over score points; NULL for one class."""
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return wins / F.when(pairs > 0, pairs)


def auc(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(auc_aggregate().alias("auc"))


def roc_columns(points: DataFrame, score: str) -> DataFrame:
    """Add tp, fp, fpr, tpr at each threshold, and `kept`: not in the middle of a straight stretch.

    A point is collinear with both neighbours exactly when it holds as many positives and negatives
    as the next lower score. The highest and lowest score are always kept.
    """
    highest = (F.col("pos_before") + F.col("pos") == F.col("pos_total")) & (
        F.col("neg_before") + F.col("neg") == F.col("neg_total")
    )
    corner = (F.col("pos") != F.col("pos_prev")) | (F.col("neg") != F.col("neg_prev"))
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    return points.withColumns(
        {
            "threshold": F.col(score),
            "tp": tp,
            "fp": fp,
            "tpr": ratio(tp, F.col("pos_total")),
            "fpr": ratio(fp, F.col("neg_total")),
            "kept": highest | F.col("pos_prev").isNull() | corner,
        }
    )


def roc_curve(points: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """ROC points of two-class keys, starting at (+infinity, 0, 0), collinear points dropped."""
    both = points.where((F.col("pos_total") > 0) & (F.col("neg_total") > 0))
    body = roc_columns(both, score).where("kept").select(*keys, "threshold", "tp", "fp", "tpr", "fpr")
    zero = F.lit(0).cast("long")
    start = both.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold")).select(
        *keys, "threshold", zero.alias("tp"), zero.alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    )
    return body.unionByName(start)


def eer_aggregates(score: str) -> dict[str, Column]:
    """Aggregates over `roc_columns` that hold the two kept points around FNR = FPR.

    FNR - FPR never rises as the threshold falls, so the crossing is the lowest kept threshold with
    FNR > FPR and the highest kept threshold with FNR <= FPR.
    """
    d = (F.lit(1.0) - F.col("tpr")) - F.col("fpr")
    point = F.struct(F.col("fpr").alias("fpr"), (F.lit(1.0) - F.col("tpr")).alias("fnr"), F.col(score).alias("thr"))
    return {
        "_hi": F.min_by(F.when(F.col("kept") & (d > 0), point), F.when(F.col("kept") & (d > 0), F.col(score))),
        "_lo": F.max_by(F.when(F.col("kept") & (d <= 0), point), F.when(F.col("kept") & (d <= 0), F.col(score))),
    }


def eer_from(hi: str = "_hi", lo: str = "_lo") -> tuple[Column, Column]:
    """(EER, threshold) by linear interpolation between the two points; above the highest score the
    curve starts at (0, 0), and the threshold is then that of the lower point."""
    hi_fpr = F.coalesce(F.col(f"{hi}.fpr"), F.lit(0.0))
    hi_d = F.coalesce(F.col(f"{hi}.fnr") - F.col(f"{hi}.fpr"), F.lit(1.0))
    lo_d = F.col(f"{lo}.fnr") - F.col(f"{lo}.fpr")
    w = hi_d / (hi_d - lo_d)
    eer_value = hi_fpr + w * (F.col(f"{lo}.fpr") - hi_fpr)
    thr = F.when(F.col(hi).isNull(), F.col(f"{lo}.thr")).otherwise(
        F.col(f"{hi}.thr") + w * (F.col(f"{lo}.thr") - F.col(f"{hi}.thr"))
    )
    return eer_value, thr


def eer(points: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Equal error rate and its threshold per key; NULL where only one class is present."""
    agg = roc_columns(points, score).groupBy(*keys).agg(*[c.alias(n) for n, c in eer_aggregates(score).items()])
    value, thr = eer_from()
    return agg.select(*keys, value.alias("eer"), thr.alias("threshold"))


def auc_eer(points: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """AUC, EER and EER threshold in one pass over the points."""
    agg = roc_columns(points, score).groupBy(*keys).agg(
        auc_aggregate().alias("auc"), *[c.alias(n) for n, c in eer_aggregates(score).items()]
    )
    value, thr = eer_from()
    return agg.select(*keys, "auc", value.alias("eer"), thr.alias("eer_threshold"))


def eer_nearest(points: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """The point nearest to FNR = FPR, ties to the highest threshold: its FPR, and the mean of both rates.

    The start (0, 0) has distance 1 and wins only against points that are no nearer.
    """
    fnr = F.lit(1.0) - F.col("tpr")
    gap = F.abs(fnr - F.col("fpr"))
    point = F.struct(F.col("fpr").alias("fpr"), fnr.alias("fnr"), gap.alias("gap"))
    best = (
        roc_columns(points, score)
        .where("kept")
        .groupBy(*keys)
        .agg(F.min_by(point, F.struct(gap, -F.col(score))).alias("p"))
    )
    start = F.col("p.gap") >= 1.0
    return best.select(
        *keys,
        F.when(start, F.lit(0.0)).otherwise(F.col("p.fpr")).alias("eer_fpr"),
        F.when(start, F.lit(0.5)).otherwise((F.col("p.fpr") + F.col("p.fnr")) / 2).alias("eer_mean"),
    )


# ---------------------------------------------------------------- thresholds
def balanced_threshold(points: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Distinct score with the best balanced accuracy, the lowest one on ties (compared in integers)."""
    tp = F.col("pos_total") - F.col("pos_before")
    tn = F.col("neg_before")
    gain = tp.cast("decimal(38,0)") * F.col("neg_total") + tn.cast("decimal(38,0)") * F.col("pos_total")
    ba = (ratio(tp, F.col("pos_total")) + ratio(tn, F.col("neg_total"))) * 0.5
    return points.groupBy(*keys).agg(
        F.max_by(F.col(score), F.struct(gain, -F.col(score))).alias("threshold"),
        F.max_by(ba, F.struct(gain, -F.col(score))).alias("balanced_accuracy"),
    )


def select_threshold(df: DataFrame, keys: Sequence[str], label: str, score: str, rule: str = "eer", **cuts) -> DataFrame:
    """Threshold per key from validation rows, as a small table to join back."""
    points = score_points(df, keys, label, score, **cuts)
    if rule == "eer":
        return eer(points, keys, score).select(*keys, "threshold")
    if rule == "balanced_acc":
        return balanced_threshold(points, keys, score).select(*keys, "threshold")
    raise ValueError(rule)


GRID = tuple(round(0.30 + 0.02 * i, 2) for i in range(21))


def threshold_grid(df: DataFrame, keys: Sequence[str], label: str, prob: str, grid: Sequence[float] = GRID) -> DataFrame:
    """Grid search of 0.7 * macro F1 + 0.3 * accuracy with a strict `prob > threshold`; first best wins.

    One pass: a probability above grid value k counts for thresholds 0..k, so each row is reduced to the
    number of grid values below it, and the confusion counts follow from a table of that size.
    """
    p, y = as_col(prob), as_col(label)
    below = sum([(p > F.lit(t)).cast("int") for t in grid[1:]], (p > F.lit(grid[0])).cast("int"))
    hist = df.groupBy(*keys, below.alias("_k")).agg(
        F.sum(y.cast("long")).alias("_p"), F.sum((1 - y).cast("long")).alias("_n")
    )
    thresholds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(grid)])
    wide = hist.withColumn("_g", F.explode(thresholds))
    hit = F.col("_k") > F.col("_g.i")
    counts = wide.groupBy(*keys, F.col("_g.t").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, 0).otherwise(F.col("_n"))).alias("tn"),
        F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("_p"))).alias("fn"),
    )
    objective = F.round(F.col("f1_macro") * 0.7 + F.col("accuracy") * 0.3, 12)
    return (
        with_rates(counts)
        .withColumn("objective", objective)
        .groupBy(*keys)
        .agg(
            F.max_by(
                F.struct("threshold", "objective", "f1_macro", "accuracy"), F.struct("objective", -F.col("threshold"))
            ).alias("_b")
        )
        .select(*keys, "_b.*")
    )


# ---------------------------------------------------------------- calibration
def brier_aggregate(label: str, prob) -> Column:
    d = as_col(prob) - as_col(label)
    return F.avg(d * d)


def reliability(df: DataFrame, keys: Sequence[str], label: str, prob: str, n_bins: int = 15) -> DataFrame:
    """Reliability table: one row per non-empty bin with its mean prediction and positive share."""
    return (
        df.groupBy(*keys, equal_width_bin(prob, n_bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(prob).alias("mean_pred"),
            F.avg(as_col(label).cast("double")).alias("frac_spoof"),
        )
        .withColumns({"lo": F.col("bin") * F.lit(1.0 / n_bins), "hi": (F.col("bin") + 1) * F.lit(1.0 / n_bins)})
    )


def ece(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected calibration error from a reliability table."""
    gap = F.abs(F.col("frac_spoof") - F.col("mean_pred"))
    return table.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def calibration(df: DataFrame, keys: Sequence[str], label: str, score: str, n_bins: int = 15) -> DataFrame:
    """Brier score and ECE of the sigmoid of the scores, in one pass."""
    p = df.withColumn("_p", sigmoid(score))
    d = F.col("_p") - as_col(label)
    bins = p.groupBy(*keys, equal_width_bin("_p", n_bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_p").alias("_sp"),
        F.sum(as_col(label).cast("double")).alias("_sy"),
        F.sum(d * d).alias("_sq"),
    )
    return bins.groupBy(*keys).agg(
        (F.sum("_sq") / F.sum("_n")).alias("brier"), (F.sum(F.abs(F.col("_sy") - F.col("_sp"))) / F.sum("_n")).alias("ece")
    )
