"""A training-data pipeline: stages that each apply one operator to all documents the stage before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigeval.llm import decontaminate, language, mixing, near_copies, sharding
from sigeval.llm.common import drop_staged, read_table, stage_root, staged_tables


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of which no language holds a main part."""
    return language.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (op6, or five-word shingles alike by 0.8), that with the smallest doc_id."""
    return near_copies.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a window of the benchmark."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents until each source has its share of the words."""
    return mixing.repeated(mixing.mix(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot."""
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = sharding.shard(docs, 40, keep=True)
    return placed.select(*own, F.col("sharded.shard").alias("shard"), F.col("sharded.slot").alias("slot"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shards),
]

#: No SQL: the language and near-duplicate stages are iterative. tests/llm checks run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    root = f"{stage_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, step) in enumerate(STAGES):
        path, before = f"{root}/{number}", staged_tables()
        step(spark, docs, sf_dir).write.parquet(path)
        drop_staged(before)
        docs = spark.read.parquet(path)
    return docs
