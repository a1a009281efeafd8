"""Nested result documents: one JSON file per run with a map of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = ("n", "n_spoof", "n_bonafide", "tp", "tn", "fp", "fn", "n_clusters")
DOUBLES = (
    "threshold", "accuracy", "balanced_accuracy", "precision_spoof", "recall_spoof_sensitivity",
    "specificity_bonafide_recall", "f1_spoof", "f1_macro", "auc", "eer", "fpr", "fnr", "brier", "ece", "frac_pred_spoof",
)
INTERVALS = ("auc_ci95", "eer_ci95", "accuracy_ci95", "f1_macro_ci95", "frac_pred_spoof_ci95")

SPLIT = T.StructType(
    [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField(c, T.DoubleType()) for c in DOUBLES]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in INTERVALS]
)
DOCUMENT = T.StructType(
    [
        T.StructField("threshold_rule", T.StringType()),
        T.StructField("threshold_logit", T.DoubleType()),
        T.StructField("PLACEHOLDER", T.BooleanType()),
        T.StructField("splits", T.MapType(T.StringType(), SPLIT)),
    ]
)


def parse(text: Column) -> Column:
    """Parse a document; bare NaN values are accepted."""
    return F.from_json(text, DOCUMENT, {"allowNonNumericNumbers": "true", "mode": "FAILFAST"})


def flatten(docs: DataFrame, run: str = "run", text: str = "value") -> DataFrame:
    """One row per (run, split); undefined numbers become NULL, intervals become two columns."""
    d = docs.select(F.col(run).alias("run"), parse(F.col(text)).alias("d"))
    rows = d.select("run", "d.threshold_rule", "d.threshold_logit", "d.PLACEHOLDER", F.explode("d.splits").alias("split", "m"))
    out = [F.nanvl(F.col(f"m.{c}"), F.lit(None).cast("double")).alias(c) for c in DOUBLES]
    for c in INTERVALS:
        out += [F.nanvl(F.col(f"m.{c}")[i], F.lit(None).cast("double")).alias(f"{c}_{e}") for i, e in enumerate(("lo", "hi"))]
    kept = rows.select("run", "threshold_rule", "threshold_logit", F.coalesce("PLACEHOLDER", F.lit(False)).alias("is_placeholder"), "split", "m")
    return kept.select("run", "threshold_rule", "threshold_logit", "is_placeholder", "split", *[F.col(f"m.{c}").alias(c) for c in COUNTS], *out)


def read(spark: SparkSession, pattern: str) -> DataFrame:
    """Result documents below a glob such as `runs/*/metrics.json`; the run is the folder name."""
    t = spark.read.option("wholetext", "true").text(pattern)
    return flatten(t.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"), "value"))


def as_json(results: DataFrame, columns: list[str], run: str = "run") -> DataFrame:
    """One JSON document per run from its split rows (a run has a handful of splits)."""
    entry = F.struct("split", F.struct(*columns).alias("m"))
    g = results.groupBy(run).agg(F.map_from_entries(F.collect_list(entry)).alias("splits"))
    return g.select(run, F.to_json(F.struct("splits")).alias("value"))


BARE = r'(?<=[:\[,])"(NaN|-?Infinity)"(?=[,}\]])'


def as_documents(results: DataFrame, run: str = "run", rule: str = "threshold_rule", logit: str = "threshold_logit", placeholder: str = "is_placeholder") -> DataFrame:
    """(run, value): the whole result document of each run from its split rows.

    Metrics are the columns of `results` that a document knows; the ends of an interval x, columns x_lo and x_hi, become a
    pair. Undefined numbers are written as bare NaN, absent ones (NULL) are left out. Rule, threshold and the placeholder flag are those of
    the run; rows of a run that disagree on them, or repeat a split, are an error. A run has a handful of splits, so a document is one row.
    """
    have = set(results.columns)
    entry = [F.col(c).cast("long").alias(c) for c in COUNTS if c in have] + [F.col(c).cast("double").alias(c) for c in DOUBLES if c in have]
    for c in INTERVALS:
        ends = [f"{c}_lo", f"{c}_hi"]
        if have.issuperset(ends):
            known = F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull()
            entry.append(F.when(known, F.array(*[F.col(e).cast("double") for e in ends])).alias(c))
    meta = F.struct(F.col(rule).alias("threshold_rule"), F.col(logit).cast("double").alias("threshold_logit"), F.col(placeholder).cast("boolean").alias("PLACEHOLDER"))
    g = results.groupBy(F.col(run).alias("run")).agg(
        F.min(meta).alias("_low"), F.max(meta).alias("_high"), F.map_from_entries(F.collect_list(F.struct("split", F.struct(*entry)))).alias("_splits")
    )
    same = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(F.raise_error(F.concat(F.lit("rows disagree on the threshold of run "), "run")))
    splits = F.regexp_replace(F.to_json("_splits"), BARE, "$1")
    head = F.regexp_replace(F.to_json(F.struct(same.alias("d"))), r'^\{"d":\{|\}\}$', "")
    return g.select("run", F.concat(F.lit("{"), head, F.when(head != "", F.lit(",")).otherwise(F.lit("")), F.lit('"splits":'), splits, F.lit("}")).alias("value"))


def write_runs(docs: DataFrame, path: str) -> None:
    """One file per run, `<path>/run=<run>/...`."""
    docs.select("run", "value").repartition("run").write.mode("overwrite").partitionBy("run").text(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the documents written by `write_runs`; names of runs stay text."""
    return flatten(spark.read.schema("value string, run string").option("wholetext", "true").text(path))


def write(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").text(path) if docs.columns == ["value"] else docs.write.mode("overwrite").json(path)
