"""Probes and baselines on top of features: linear and tree classifiers, mixture scores, user models.

Training is distributed (MLlib, or sums of sufficient statistics); only model parameters, whose size
does not depend on the data, are seen by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sigeval.operators.metrics import auc_eer, score_points, select_threshold
from sigeval.operators.sampling import order_hash
from sigeval.session import stage


FIT_ROWS = 500_000


def _log_odds(pred: DataFrame, name: str) -> DataFrame:
    """Log-odds of class 1 from the predicted probability, kept finite."""
    p = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - 1e-12)), F.lit(1e-12))
    return pred.withColumn(name, F.log(p / (1 - p))).drop("features_raw", "features", "rawPrediction", "probability", "prediction")


def _dealt(train: DataFrame, n: int) -> DataFrame:
    """The n rows in partitions of about FIT_ROWS: MLlib caches a partition as objects, and compressed files may hold many rows."""
    if n <= FIT_ROWS:
        return train
    return train.repartition(max(-(-n // FIT_ROWS), int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def linear_probe(train: DataFrame, test: DataFrame, features: str, label: str = "label", c: float = 1.0, name: str = "logit") -> DataFrame:
    """Standardise, fit L2 logistic regression of strength C, and add the log-odds to `test`.

    `features` is an array column.
    """
    n = train.count()
    stages = [
        StandardScaler(inputCol="features_raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol=label, regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=200),
    ]
    as_vector = lambda df: df.withColumn("features_raw", array_to_vector(F.col(features)))
    model = Pipeline(stages=stages).fit(as_vector(_dealt(train, n)))
    return _log_odds(model.transform(as_vector(test)), name)


def tree_probe(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "label", name: str = "logit", seed: int = 0, trees: int = 20) -> DataFrame:
    """Boosted trees on numeric columns; adds the log-odds to `test`."""
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep"),
        GBTClassifier(labelCol=label, maxIter=trees, maxDepth=5, seed=seed),
    ]
    model = Pipeline(stages=stages).fit(_dealt(train.select(label, *columns), train.count()))
    return _log_odds(model.transform(test), name)


def shortcut_probes(
    df: DataFrame, groups: dict[str, Sequence[str]], label: str = "label", split: str = "split", train: str = "train", trees: int = 10
) -> DataFrame:
    """How well cheap descriptors alone give the label away, per feature group and split.

    A logistic regression per group and boosted trees on all columns, fitted on the train split. Reports
    accuracy at the train EER threshold, AUC and EER, and the false-positive rate where only class 0
    occurs. Groups whose columns are constant in the train split are reported, not fitted.
    """
    columns = sorted({c for cols in groups.values() for c in cols})
    base = stage(df.select(split, F.col(label).alias("label"), *columns).na.drop(subset=columns))
    fit = base.where(F.col(split) == train)
    spread = fit.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    parts, notes = [], []
    for group, cols in groups.items():
        varying = [c for c in cols if (spread[c] or 0.0) > 0.0]
        if not varying:
            notes.append(group)
            continue
        wide = base.withColumn("x", F.array(*[F.col(c).cast("double") for c in varying]))
        scored = linear_probe(wide.where(F.col(split) == train), wide, "x")
        parts.append(scored.select(F.lit(group).alias("features"), F.lit("LogisticRegression").alias("model"), split, "label", "logit"))
    varying = [c for c in columns if (spread[c] or 0.0) > 0.0]
    if varying:
        scored = tree_probe(fit, base, varying, trees=trees)
        parts.append(scored.select(F.lit("all").alias("features"), F.lit("GBTClassifier").alias("model"), split, "label", "logit"))
    if not parts:
        raise ValueError("every feature is constant in the train split")
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    scores = stage(scores)
    by = ["features", "model"]
    thr = select_threshold(scores.where(F.col(split) == train), by, "label", "logit").withColumnRenamed("threshold", "_t")
    pred = F.col("logit") >= F.col("_t")
    # one threshold for each model: a shuffle by model would put all its scores into one task
    acc = scores.join(F.broadcast(thr), by).groupBy(*by, split).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("n_spoof"),
        F.avg((pred.cast("int") == F.col("label")).cast("int")).alias("acc_at_train_eer_thr"),
        F.when(F.max("label") == 0, F.avg(pred.cast("int"))).alias("false_positive_rate"),
    )
    ranks = auc_eer(score_points(scores, [*by, split], "label", "logit"), [*by, split], "logit").drop("eer_threshold")
    out = acc.join(ranks, [*by, split]).withColumn("note", F.lit(None).cast("string"))
    if notes:
        empty = base.sparkSession.createDataFrame([(g, "constant feature, not fitted") for g in notes], "features string, note string")
        out = out.unionByName(empty, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- user models
def score_windows(df: DataFrame, features: str, predict: Callable[[np.ndarray], np.ndarray], name: str = "logit") -> DataFrame:
    """Score windows in Arrow batches with a user function from a [n, d] matrix to n scores."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(np.asarray(predict(np.stack(x.to_numpy())), dtype="float64")) if len(x) else pd.Series([], dtype="float64")

    return df.withColumn(name, run(F.col(features)))


# ---------------------------------------------------------------- Gaussian mixtures
def _log_density(x: np.ndarray, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """[n, k] log of weight times diagonal normal density."""
    const = np.log(w) - 0.5 * (np.log(2 * math.pi * var).sum(axis=1) + (mu**2 / var).sum(axis=1))
    return const - 0.5 * (x**2) @ (1.0 / var).T + x @ (mu / var).T


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def fit_mixtures(df: DataFrame, features: str, label: str, components: int, iterations: int = 10, seed: int = 0, floor: float = 1e-4) -> dict:
    """Diagonal Gaussian mixture per label by expectation-maximisation: {label: (weights, means, variances)}.

    Tasks reduce their rows to k sums of responsibilities, values and squares; the driver sees only the
    total of those sums. Starts from `components` hash-chosen rows per label and the label's variance.
    """
    x = F.col(features)
    base = stage(df.select(F.col(label).cast("int").alias("y"), F.transform(x, lambda v: v.cast("double")).alias("x"), F.xxhash64(x).alias("h")))
    moments = base.select("y", F.posexplode("x").alias("j", "v")).groupBy("y", "j").agg(F.var_pop("v").alias("s")).collect()
    models = {}
    for y in sorted({m["y"] for m in moments}):
        start = base.where(F.col("y") == y).orderBy(order_hash(seed, F.col("h")), "h").limit(components).collect()
        mu = np.array([r["x"] for r in start], dtype=float)
        spread = np.array([m["s"] for m in sorted((m for m in moments if m["y"] == y), key=lambda m: m["j"])])
        models[y] = (np.full(len(mu), 1.0 / len(mu)), mu, np.tile(np.maximum(spread, floor), (len(mu), 1)))

    for _ in range(iterations):
        current = models

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict = {}
            for pdf in batches:
                for y, part in pdf.groupby("y"):
                    data = np.stack(part["x"].to_numpy())
                    ll = _log_density(data, *current[y])
                    resp = np.exp(ll - _log_sum(ll)[:, None])
                    got = np.hstack([resp.sum(axis=0)[:, None], resp.T @ data, resp.T @ data**2])
                    sums[y] = sums.get(y, 0.0) + got
            rows = [(int(y), k, j, float(v)) for y, m in sums.items() for k, line in enumerate(m) for j, v in enumerate(line)]
            yield pd.DataFrame(rows, columns=["y", "k", "j", "v"])

        total = base.select("y", "x").mapInPandas(expect, "y int, k int, j int, v double").groupBy("y", "k", "j").agg(F.sum("v").alias("v"))
        filled = {y: np.zeros((len(m[0]), 1 + 2 * m[1].shape[1])) for y, m in models.items()}
        for r in total.collect():  # labels x components x (1 + 2 * dimensions) numbers
            filled[r["y"]][r["k"], r["j"]] = r["v"]
        models = {}
        for y, m in filled.items():
            d = (m.shape[1] - 1) // 2
            n = np.maximum(m[:, :1], 1e-10)
            mu = m[:, 1 : 1 + d] / n
            models[y] = (n[:, 0] / n.sum(), mu, np.maximum(m[:, 1 + d :] / n - mu**2, floor))
    return models


def mixture_llr(df: DataFrame, features: str, models: dict, name: str = "logit") -> DataFrame:
    """Log-likelihood ratio of label 1 against label 0 for every row."""
    one, zero = models[1], models[0]
    return score_windows(df, features, lambda x: _log_sum(_log_density(x, *one)) - _log_sum(_log_density(x, *zero)), name)
