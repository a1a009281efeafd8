"""Tabular sources and sinks: metadata CSV, split lists, score tables and the keyed feature cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigeval.functions.columns import cache_key

STRINGS = (
    "dataset_id", "dataset_name", "source", "speaker_id", "set_id", "gender", "generator", "license", "utterance_key",
    "audio_path", "utterance_id", "language", "sha256", "container", "codec", "pcm_sha256", "error", "transcript", "text_group",
    "split_P1", "split_P2",
)
LONGS = ("label", "file_size_bytes", "sample_rate", "channels", "frames", "fingerprint_row")
DOUBLES = (
    "duration_sec", "peak_abs", "clip_ratio", "exact_zero_ratio", "dc_offset", "rms_dbfs", "lufs", "leading_silence_sec",
    "trailing_silence_sec", "activity_ratio", "snr_proxy_db", "rolloff95_hz", "rolloff99_hz", "band_edge_hz", "zcr",
)


def metadata_type(name: str) -> T.DataType:
    """Type of a metadata column; ids are strings even when they look like numbers."""
    for names, kind in ((STRINGS, T.StringType()), (LONGS, T.LongType()), (DOUBLES, T.DoubleType())):
        if name in names:
            return kind
    raise ValueError(f"unknown metadata column: {name}")


def read_metadata(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Metadata CSV with an explicit schema in the file's column order; NaN becomes NULL.

    A header that differs from `columns` is an error.
    """
    schema = T.StructType([T.StructField(c, metadata_type(c)) for c in columns])
    df = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns if c in DOUBLES})


def read_split_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line; blank lines are ignored."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where(F.col("item") != "")


def write_scores(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzip CSV score table, written in parallel; `append` adds to an existing one."""
    df.write.mode(mode).option("header", "true").option("compression", "gzip").csv(path)


# ---------------------------------------------------------------- feature cache
def cache_path(root: str, key: str, split: str) -> str:
    return f"{root}/cache_key={key}/split={split}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def manifest_key(files: DataFrame, item: str, settings: dict) -> str:
    """Cache key of the settings and the set of files: a hash of per-file hashes, summed by the tasks."""
    h = F.conv(F.substring(F.sha1(F.col(item)), 1, 15), 16, 10).cast("decimal(38,0)")
    row = files.agg(F.sum(h).cast("string").alias("s"), F.count(F.lit(1)).cast("string").alias("n"))
    return row.select(cache_key(settings, F.array(F.coalesce("s", F.lit("")), "n")).alias("k")).first()["k"]


def cached(features: DataFrame, root: str, key: str, split: str) -> DataFrame:
    """Features from the cache; written first unless a complete copy (with _SUCCESS) is there."""
    spark, path = features.sparkSession, cache_path(root, key, split)
    if not _exists(spark, f"{path}/_SUCCESS"):
        features.write.mode("overwrite").parquet(path)
    return spark.read.schema(features.schema).parquet(path)
