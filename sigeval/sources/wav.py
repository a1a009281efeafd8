"""PCM WAV ingest: files are listed and read by Spark, decoded in the tasks."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "path string, sample_rate int, channels int, sample_width int, frames long, duration_sec double"
BLOCK = 1 << 16
HEAD = 1 << 16  # bytes in which the header ends for most files; no more of these leaves the reader


def _files(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
    ).select("path", "content")


def _head() -> Column:
    """The first bytes if the header of the data chunk is among them, else the whole content (long chunks before it)."""
    at = f"""aggregate(sequence(1, 64), 13L, (p, i) -> CASE WHEN p + 7 > least({HEAD}, length(content)) THEN p
        WHEN substring(content, cast(p AS int), 4) = X'64617461' THEN p ELSE p + 8 + {_size("p")} + {_size("p")} % 2 END)"""
    found = f"at + 7 <= {HEAD} AND substring(content, cast(at AS int), 4) = X'64617461'"
    return F.expr(f"element_at(transform(array({at}), at -> CASE WHEN {found} THEN substring(content, 1, {HEAD}) ELSE content END), 1)")


def _size(p: str) -> str:
    """SQL for the little-endian length in the chunk header at byte p."""
    h = f"hex(substring(content, cast({p} AS int) + 4, 4))"
    return f"cast(conv(concat({', '.join(f'substring({h}, {k}, 2)' for k in (7, 5, 3, 1))}), 16, 10) AS long)"


def headers(spark: SparkSession, root: str) -> DataFrame:
    """Rate, channels, frames and duration per file, from its first bytes where they hold the header; unreadable files are dropped."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as f:
                        rows.append(
                            (path, f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes(), f.getnframes() / f.getframerate())
                        )
                except (wave.Error, EOFError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "sample_width", "frames", "duration_sec"])

    first = _files(spark, root).select("path", _head().alias("content"))
    return first.mapInPandas(read, HEADER)


def samples(spark: SparkSession, root: str) -> DataFrame:
    """Long-format mono samples (rec, i, v) of 16-bit PCM files, in [-1, 1).

    A file is emitted in blocks, so its exploded rows never exist at once in the Python worker.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(content)) as f:
                    if f.getsampwidth() != 2:
                        raise ValueError(f"{path}: only 16-bit PCM is supported")
                    start, width = 0, f.getnchannels()
                    while start < f.getnframes():
                        raw = np.frombuffer(f.readframes(BLOCK), dtype="<i2").astype(np.float64)
                        v = raw.reshape(-1, width).mean(axis=1) / 32768.0
                        yield pd.DataFrame({"rec": path, "i": np.arange(start, start + len(v)), "v": v})
                        start += len(v)

    return _files(spark, root).mapInPandas(decode, "rec string, i long, v double")
