"""Column expressions and staging shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigeval.session import drop_staged, stage, stage_root, staged_tables  # noqa: F401  (re-exported)

#: Fixed values of the contracts.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"


def filled(text: str) -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_count(text: str) -> Column:
    """Number of words between ASCII white space; 0 for NULL."""
    return F.regexp_count(filled(text), F.lit(NOT_SPACES)).cast("long")


def row_keys(key: str, text: str) -> list[Column]:
    """Two 64-bit hashes of (key, text), NULLs told apart: `k1` and `k2` join a row's results back to it.

    Rows that repeat both key and text share them, which is right for any result that only depends on the two.
    """
    nulls = F.col(key).isNull().cast("int") * 2 + F.col(text).isNull().cast("int")
    return [
        F.xxhash64(F.col(key), F.col(text), nulls).alias("k1"),
        F.xxhash64(F.lit(1), F.col(text), nulls, F.col(key)).alias("k2"),
    ]


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
