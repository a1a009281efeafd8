"""Evaluation of runs: the validation threshold applied to every split, and the reports built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigeval.functions.columns import as_col, ratio
from sigeval.operators import inference as I
from sigeval.operators import metrics as M
from sigeval.plans.runs import status_rollup
from sigeval.session import stage


def split_rows(df: DataFrame, column: str, split: str, check: bool = True) -> DataFrame:
    """Rows of one split; an empty split is an error. The check runs a one-row job."""
    rows = df.where(F.col(column) == split)
    if check and rows.isEmpty():
        raise ValueError(f"split {split!r} is empty in {column}")
    return rows


def pair_runs(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """Two runs on the items both of them scored."""
    return a.withColumnRenamed("score", "score_a").join(b.select(item, F.col("score").alias("score_b")), item)


def with_threshold(df: DataFrame, validation: DataFrame, keys: Sequence[str] = (), rule: str = "eer") -> DataFrame:
    """Add the threshold selected on validation rows, per run key or as one scalar; it never leaves the plan."""
    if keys:
        return df.join(M.select_threshold(validation, keys, "label", "score", rule), list(keys), "left")
    one = M.select_threshold(validation.withColumn("_run", F.lit(1)), ["_run"], "label", "score", rule)
    return df.withColumn("threshold", one.select("threshold").scalar())


def split_report(
    scores: DataFrame, keys: Sequence[str] = (), validation: str = "validation", n_boot: int = 0, seed: int = 0,
    rule: str = "eer",
) -> DataFrame:
    """Full report per (run keys, split): rates at the validation threshold, number of resampling clusters and, with
    n_boot > 0, cluster-bootstrap intervals.

    A split with both classes has AUC, EER, Brier, ECE and intervals of AUC, EER, accuracy and macro F1. A split with one
    class has the share of positive decisions, `frac_pred_spoof`, and its interval instead; the others are NULL.

    `scores` has label, score, split and cluster columns and is staged once, because the threshold,
    the ranking metrics and the resampling all read it.
    """
    by = [*keys, "split"]
    base = stage(scores.select(*by, "label", "score", "cluster"))
    t = with_threshold(base, base.where(F.col("split") == validation), keys, rule)
    counts = t.groupBy(*by).agg(
        *[
            F.count(F.when(c, 1)).alias(n)
            for n, c in {
                "tp": (F.col("label") == 1) & (F.col("score") >= F.col("threshold")),
                "tn": (F.col("label") == 0) & (F.col("score") < F.col("threshold")),
                "fp": (F.col("label") == 0) & (F.col("score") >= F.col("threshold")),
                "fn": (F.col("label") == 1) & (F.col("score") < F.col("threshold")),
            }.items()
        ],
        F.max("threshold").alias("threshold"),
    )
    ranking = M.auc_eer(M.score_points(base, by, "label", "score"), by, "score").drop("eer_threshold")
    clusters = base.groupBy(*by, "cluster").agg(F.lit(1).alias("_c")).groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"))
    out = M.with_rates(counts).join(ranking, by).join(M.calibration(base, by, "label", "score"), by).join(clusters, by)
    two = (F.col("n_spoof") > 0) & (F.col("n_bonafide") > 0)
    positive = ratio(F.col("tp") + F.col("fp"), F.col("n"))
    out = out.withColumns({c: F.when(two, F.col(c)) for c in ("brier", "ece")}).withColumn("frac_pred_spoof", F.when(~two, positive))
    if n_boot:
        draws = stage(I.multiplicities(base, by, "cluster", n_boot, seed))
        ranks = I.bootstrap_ranking(base, by, "cluster", "label", "score", n_boot, seed, draws=draws)
        rates = I.bootstrap_counts(t, by, "cluster", "label", F.col("score") >= F.col("threshold"), n_boot, seed, draws=draws)
        for values, stats in ((ranks, ("auc", "eer")), (rates, ("accuracy", "f1_macro", "frac_pred_spoof"))):
            ci = I.percentile_ci(values, by, stats).select(
                *by, *[F.col(f"{s}_{e}").alias(f"{s}_ci95_{e}") for s in stats for e in ("lo", "hi")]
            )
            out = out.join(ci, by, "left")
        own = {f"{s}_ci95_{e}": ~two if s == "frac_pred_spoof" else two for s in INTERVALS for e in ("lo", "hi")}
        out = out.withColumns({c: F.when(defined, F.col(c)) for c, defined in own.items()})
    return out


INTERVALS = ("auc", "eer", "accuracy", "f1_macro", "frac_pred_spoof")
REPORT_DOUBLES = (
    "accuracy", "balanced_accuracy", "precision_spoof", "recall_spoof_sensitivity", "specificity_bonafide_recall",
    "f1_spoof", "f1_macro", "fpr", "fnr", "threshold", "auc", "eer", "brier", "ece", "frac_pred_spoof",
    *(f"{s}_ci95_{e}" for s in INTERVALS for e in ("lo", "hi")),
)


def rounded(report: DataFrame, digits: int = 6) -> DataFrame:
    return report.withColumns({c: F.round(c, digits) for c in REPORT_DOUBLES if c in report.columns})


def tier_report(scores: DataFrame, tiers: dict[str, str], validation: str = "validation") -> DataFrame:
    """Compact table per tier: AUC, nearest-point EER, accuracy at the validation threshold."""
    names = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])
    base = stage(scores.select("split", "label", "score").where(F.col("split").isin([*tiers, validation])))
    t = with_threshold(base, base.where(F.col("split") == validation))
    hit = (F.col("score") >= F.col("threshold")).cast("int") == F.col("label")
    acc = t.groupBy("split").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(hit.cast("int")).alias("acc"),
        F.max("threshold").alias("thr"),
    )
    pts = M.score_points(base, ["split"], "label", "score")
    rank = M.auc(pts, ["split"]).join(M.eer_nearest(pts, ["split"], "score"), "split")
    return (
        acc.join(rank, "split")
        .where(F.col("split").isin(list(tiers)))
        .select(
            names[F.col("split")].alias("tier"),
            F.round("auc", 4).alias("auc"),
            F.round(F.col("eer_mean") * 100, 2).alias("eer_pct"),
            F.round(F.col("acc") * 100, 2).alias("accuracy_pct"),
            F.round("thr", 4).alias("threshold"),
            "sample_count",
        )
    )


def metrics_by_level(df: DataFrame, keys: Sequence[str], label: str, score: str, value: str, threshold: Column) -> DataFrame:
    """Accuracy and AUC per level; levels with one class or fewer than two rows are left out."""
    keys = list(keys)
    rows = df.where(F.col(keys[-1]).isNotNull())
    hit = (as_col(score) >= threshold).cast("int") == as_col(label)
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.avg(hit.cast("int")).alias("accuracy")
    )
    ranked = M.auc(M.score_points(rows, keys, label, score), keys).where(F.col("auc").isNotNull())
    return base.where(F.col("n") >= 2).join(ranked, keys)


def compact_report(windows: DataFrame, keys: Sequence[str], item: str, cluster: str, threshold: Column, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Report for outside window scores: pooled AUC and EER, AUC interval, accuracy and both recalls.

    An absent class gives a recall of 0, not NULL.
    """
    keys = list(keys)
    pooled = stage(
        windows.groupBy(*keys, item).agg(
            M.one_value("label").alias("label"), M.one_value(cluster).alias(cluster), F.avg("logit").alias("score")
        )
    )
    pred = F.col("score") >= threshold
    pos, neg = F.col("label") == 1, F.col("label") == 0
    acc = pooled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((pred.cast("int") == F.col("label")).cast("int")).alias("acc"),
        (F.count(F.when(~pred & neg, 1)) / F.greatest(F.count(F.when(neg, 1)), F.lit(1))).alias("spec"),
        (F.count(F.when(pred & pos, 1)) / F.greatest(F.count(F.when(pos, 1)), F.lit(1))).alias("sens"),
    )
    rank = M.auc_eer(M.score_points(pooled, keys, "label", "score"), keys, "score").drop("eer_threshold")
    draws = I.bootstrap_ranking(pooled, keys, cluster, "label", "score", n_boot, seed)
    ci = I.percentile_ci(draws, keys, ["auc"]).select(*keys, "auc_lo", "auc_hi")
    return acc.join(rank, keys).join(ci, keys, "left")


def paired_tests(
    pairs: DataFrame, keys: Sequence[str], cluster: str, threshold_a: str, threshold_b: str, n_boot: int = 2000, seed: int = 0
) -> DataFrame:
    """DeLong, McNemar and paired bootstrap for every pair key at once; Holm is applied by the caller.

    `pairs` has label, score_a, score_b, both thresholds and the cluster. One job serves all pairs.
    """
    keys = list(keys)
    base = stage(pairs)
    y = F.col("label")
    right_a = (F.col("score_a") >= F.col(threshold_a)).cast("int") == y
    right_b = (F.col("score_b") >= F.col(threshold_b)).cast("int") == y
    acc = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(right_a.cast("int")).alias("acc_a"),
        F.avg(right_b.cast("int")).alias("acc_b"),
    )
    long = base.select(
        *keys,
        cluster,
        "label",
        F.inline(
            F.array(
                F.struct(F.lit("a").alias("series"), F.col("score_a").alias("score")),
                F.struct(F.lit("b").alias("series"), F.col("score_b").alias("score")),
            )
        ),
    )
    eers = M.eer(M.score_points(long, [*keys, "series"], "label", "score"), [*keys, "series"], "score")
    eers = eers.groupBy(*keys).agg(
        F.max(F.when(F.col("series") == "a", F.col("eer"))).alias("eer_a"),
        F.max(F.when(F.col("series") == "b", F.col("eer"))).alias("eer_b"),
    )
    draws = I.bootstrap_ranking(long, keys, cluster, "label", "score", n_boot, seed, series=["series"])
    deltas = I.paired_deltas(draws, keys, "series", "a", "b", ["auc", "eer"])
    ci = I.percentile_ci(deltas, keys, ["delta_auc", "delta_eer"]).select(
        *keys, *[f"delta_{s}_{e}" for s in ("auc", "eer") for e in ("lo", "hi")]
    )
    test = I.delong(base, keys, "label", "score_a", "score_b").withColumnsRenamed({"z": "delong_z", "p_value": "delong_p"})
    return (
        test.withColumn("delta_auc", F.col("auc_a") - F.col("auc_b"))
        .join(I.mcnemar(base, keys, right_a, right_b), keys)
        .join(acc, keys)
        .join(eers, keys)
        .join(ci, keys, "left")
    )


def paired_table(
    comparisons: DataFrame, scores: DataFrame, status: DataFrame, validation: str = "validation", n_boot: int = 2000, seed: int = 0
) -> DataFrame:
    """One row per (protocol, split, run_a, run_b): both runs' status and, on their common items, the paired tests.

    `comparisons` has protocol, run_a, run_b; `scores` has run, protocol, split, item, cluster, label, score; `status` has run
    and status. Decisions use each run's own validation threshold. Where the runs have no common item or the items
    have one class, only the names and the status are filled. DeLong p-values are adjusted by Holm among the
    comparisons of the same protocol and split.
    """
    keys = ["protocol", "split", "run_a", "run_b"]
    cut = M.select_threshold(scores.where(F.col("split") == validation), ["run"], "label", "score").select("run", "threshold")
    own = scores.where(F.col("split") != validation).join(cut, "run")
    a = own.withColumnsRenamed({"run": "run_a", "score": "score_a", "threshold": "threshold_a"})
    b = own.select("protocol", "split", "item", *[F.col(c).alias(f"{c}_b") for c in ("run", "score", "threshold")])
    pairs = stage(comparisons.join(a, ["protocol", "run_a"]).join(b, ["protocol", "split", "item", "run_b"]))
    mixed = pairs.groupBy(*keys).agg(F.countDistinct("label").alias("_classes")).where("_classes = 2").select(*keys)
    tests = paired_tests(pairs.join(mixed, keys, "left_semi"), keys, "cluster", "threshold_a", "threshold_b", n_boot, seed)

    plan = comparisons.join(scores.where(F.col("split") != validation).select("protocol", "split").distinct(), "protocol").select(*keys)
    runs = plan.select(*keys, F.explode(F.array("run_a", "run_b")).alias("run")).join(status, "run", "left")
    worst = status_rollup(runs.na.fill("missing", ["status"]), keys).drop("n_runs")
    table = worst.join(tests, keys, "left")
    return I.holm(table, ["protocol", "split"], "delong_p", "delong_p_holm")
