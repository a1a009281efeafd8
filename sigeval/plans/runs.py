"""Many runs: registry, status, seed summaries, cross-corpus tables and calibration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigeval.functions.columns import run_name

METRICS = ("auc", "eer", "accuracy", "f1_macro", "recall_spoof_sensitivity", "specificity_bonafide_recall", "ece", "brier")
STATUS = ("real", "placeholder", "missing")  # from best to worst


def expected_runs(registry: DataFrame) -> DataFrame:
    """One row per registered run from (model, protocol, seeds array)."""
    r = registry.select("model", "protocol", F.explode("seeds").alias("seed"))
    return r.withColumn("run", run_name("model", "protocol", "seed"))


def run_status(expected: DataFrame, real: DataFrame, placeholder: DataFrame) -> DataFrame:
    """Status and path of each expected run. Real results win; a placeholder in the real store is an error.

    `real` has run, path and is_placeholder; `placeholder` has run and path.
    """
    bad = F.raise_error(F.concat(F.lit("placeholder data in the real store: "), F.col("_real"))).cast("string")
    r = real.select("run", F.col("path").alias("_real"), F.col("is_placeholder").alias("_flag"))
    p = placeholder.select("run", F.col("path").alias("_ph"))
    status = (
        F.when(F.col("_flag"), bad)
        .when(F.col("_real").isNotNull(), "real")
        .when(F.col("_ph").isNotNull(), "placeholder")
        .otherwise("missing")
    )
    x = expected.join(r, "run", "left").join(p, "run", "left")
    return x.select(*expected.columns, status.alias("status"), F.coalesce("_real", "_ph", F.lit("")).alias("path"))


def status_rollup(df: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Worst status per key: any missing, else any placeholder, else real."""
    order = F.array(*[F.lit(s) for s in STATUS])
    worst = df.groupBy(*keys).agg(F.max(F.array_position(order, F.col(status))).alias("_w"), F.count(F.lit(1)).alias("n_runs"))
    return worst.select(*keys, "n_runs", F.element_at(order, F.col("_w").cast("int")).alias("status"))


def pending_runs(expected: DataFrame, done: DataFrame) -> DataFrame:
    return expected.join(done, "run", "left_anti")


def comparison_plan(pairs: DataFrame, registered: DataFrame, protocols: Sequence[str], seed: int = 42) -> DataFrame:
    """Model pairs (a, b) per protocol, kept where both runs are registered."""
    x = pairs.withColumn("protocol", F.explode(F.array(*[F.lit(p) for p in protocols])))
    x = x.withColumns({"run_a": run_name("a", "protocol", F.lit(seed)), "run_b": run_name("b", "protocol", F.lit(seed))})
    x = x.join(registered.select(F.col("run").alias("run_a")), "run_a", "left_semi")
    return x.join(registered.select(F.col("run").alias("run_b")), "run_b", "left_semi").select("protocol", "run_a", "run_b")


def multiseed_summary(
    results: DataFrame, metrics: Sequence[str] = METRICS, ci_of: Sequence[str] = (), main_seed: int = 42,
    keys: Sequence[str] = ("model", "protocol", "split"),
) -> DataFrame:
    """Count, mean and sample SD of each metric over the seeds, and the interval of the main seed.

    Undefined values are left out; the SD of a single seed is NULL. Intervals come from the columns
    `<metric>_ci95_lo` and `_hi`.
    """
    aggs = [F.count_distinct("seed").alias("n_seeds")]
    for m in metrics:
        v = F.nanvl(F.col(m), F.lit(None).cast("double"))
        aggs += [F.count(v).alias(f"{m}_n"), F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_sd")]
    main = F.col("seed") == main_seed
    for m in ci_of:
        aggs += [F.max(F.when(main, F.col(f"{m}_ci95_{e}"))).alias(f"{m}_seed{main_seed}_ci_{n}") for e, n in (("lo", "low"), ("hi", "high"))]
    return results.groupBy(*keys).agg(*aggs)


def seed_table(
    results: DataFrame, status: DataFrame, splits: DataFrame, metrics: Sequence[str] = METRICS, ci_of: Sequence[str] = ()
) -> DataFrame:
    """Seed summary of every registered (model, protocol) on every split of its protocol, runs without results included.

    `status` has one row per expected run (run, model, protocol, seed, status), `splits` has protocol, split and corpus. Only
    available runs are summarised; the counts of a pair without any are 0 and its means NULL.
    """
    keys = ["model", "protocol"]
    expected = status_rollup(status, keys).withColumnRenamed("n_runs", "n_seeds_expected")
    available = results.join(status.where("status <> 'missing'").select("run"), "run", "left_semi")
    summary = multiseed_summary(available, metrics, ci_of)
    table = expected.join(splits, "protocol").join(summary, [*keys, "split"], "left")
    return table.na.fill(0, ["n_seeds", *[f"{m}_n" for m in metrics]])


def cross_corpus(summary: DataFrame, value: str, train: str, test: str, corpora: Sequence[str]) -> DataFrame:
    """One row per (model, training corpus) with a column per test corpus, and the worst status if the summary has one."""
    if "status" in summary.columns:
        return status_rollup(summary, ["model", train]).drop("n_runs").join(
            cross_corpus(summary.drop("status"), value, train, test, corpora), ["model", train]
        )
    t = summary.groupBy("model", train).pivot(test, list(corpora)).agg(F.first(value))
    return t.select("model", train, *[F.col(c).alias(f"test_{c}") for c in corpora])


def calibration_table(results: DataFrame, status: DataFrame) -> DataFrame:
    """Calibration of every available run and split."""
    s = status.where("status <> 'missing'").select("run", "status")
    cols = ["ece", "brier", "auc", "accuracy"]
    return results.where(F.col("ece").isNotNull()).join(s, "run").select("run", "split", "status", *cols)
