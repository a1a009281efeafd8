"""File manifests: listing a tree, reading labels from paths, and checking content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """One row per file below a folder; the content column is never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    return files.select("path", "length", "modificationTime")


def _first_match(path: Column, rules: Sequence[tuple[str, object]]) -> Column:
    out = None
    for text, value in rules:
        hit = F.contains(path, F.lit(text))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def classify_paths(
    paths: DataFrame, corpus: Sequence[tuple[str, str]], label: Sequence[tuple[str, int]], role_pattern: str, path: str = "path"
) -> DataFrame:
    """Corpus, role and label from the first rule whose text occurs in the path; unmatched paths are dropped."""
    p = F.col(path)
    return paths.select(
        p,
        _first_match(p, corpus).alias("corpus"),
        F.regexp_extract(p, role_pattern, 1).alias("role"),
        _first_match(p, label).alias("label"),
    ).where(F.col("corpus").isNotNull() & F.col("label").isNotNull())


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file below a folder, hashed by the tasks that read it."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    return files.select("path", F.sha2("content", 256).alias("actual"))


def checksum_mismatch(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of the manifest whose file is missing or has another hash."""
    return (
        expected.join(actual, key, "left")
        .where(F.col("actual").isNull() | (F.col("actual") != F.col("expected")))
        .select(key, F.when(F.col("actual").isNull(), "missing").otherwise("mismatch").alias("status"))
    )
