"""p-values that Spark SQL has no function for. They run on one row per test, as Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """2 * P(Z >= |z|), NULL for a missing z."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0))).astype("float64")


def _binomial_two_sided(k: int, n: int) -> float:
    if n == 0:
        return 1.0
    k = min(k, n - k)
    if 2 * k == n:
        return 1.0
    log_half = -n * math.log(2.0)
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + log_half
    # tail relative to its largest term; terms shrink geometrically below k < n/2
    total, term = 1.0, 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < 1e-18 * total:
            break
    return min(1.0, 2.0 * math.exp(top) * total)


@F.pandas_udf(DoubleType())
def mcnemar_exact(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact two-sided binomial p of the two discordant counts; 1 if there are none."""
    return pd.Series([_binomial_two_sided(int(x), int(x) + int(y)) for x, y in zip(a, b)], dtype="float64")
