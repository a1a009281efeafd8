"""Token counts from flat token files by a separator scan.

A token file is a sequence of little-endian token ids, documents one after another, each closed by an end-of-document
id; nothing says where a document begins. Files are cut into blocks that tasks read and search on their own. A block
only knows its separators; how many came before it and where the last one was follows from a prefix scan over the
blocks, done in two levels so that no task gets all blocks of a large file.
"""

from __future__ import annotations

import base64
import functools
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filled, stage, stage_root

BLOCK = 4 << 20  # bytes of a token file that are read at once
SPAN = 1024  # blocks whose summaries one task scans
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that goes with the vocabulary (of several languages, as the documents are), and its free id.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Long runs of white space (the characters that the pattern's \\s means), which the pattern's search would follow too deep.
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{256,}")


def encoded(own: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text. By the pattern a run of white space is one part, but for its last character if a text follows it."""
    out, at = [], 0
    for run in _RUN.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        out += own.encode_ordinary(text[at : run.start()])
        out += own._encode_single_piece(text[run.start() : last].encode())
        at = last
    return [*out, *own.encode_ordinary(text[at:])]


# ---------------------------------------------------------------- writing
def _written(root: str, vocabulary: str, end: int):
    def run(batches):
        own = encoder(vocabulary)
        files, folder = pyarrow.fs.FileSystem.from_uri(root)
        path, sink, ordinal = f"{folder}/{uuid.uuid4().hex}.tokens", None, 0
        try:
            for batch in batches:
                sink = sink or files.open_output_stream(path)
                for text in batch["text"]:
                    sink.write(np.array([*encoded(own, text.as_py()), end], dtype="<u2").tobytes())
                number = pa.array(np.arange(ordinal, ordinal + batch.num_rows))
                ordinal += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([path] * batch.num_rows), number, batch["doc_id"]], ["file", "ordinal", "doc_id"])
        finally:
            if sink is not None:
                sink.close()

    return run


def write_tokens(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Tokenises every text into flat files of 16-bit ids below `root`, one file per task, each text closed by `end`.

    Returns the order of the documents (file, ordinal, doc_id), written once. A task that is repeated writes a file of
    another name, and only the files in the returned table count. NULL texts are empty; text that spells a special token
    is ordinary text.
    """
    rows = docs.select(F.col(key).alias("doc_id"), filled(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return stage(rows.mapInArrow(_written(root, vocabulary, end), f"file string, ordinal long, doc_id {kind}"))


# ---------------------------------------------------------------- scanning
def _sized(root: str):
    def run(batches):
        files, _ = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = [x.size for x in files.get_file_info(batch["file"].to_pylist())] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(sizes, pa.int64())], ["file", "bytes"])

    return run


def _searched(root: str, width: int, end: int, block: int):
    def run(batches):
        files, _ = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for file, number in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), strict=True):
                with files.open_input_file(file) as source:
                    source.seek(number * block)
                    ids = np.frombuffer(source.read(block), dtype=f"<u{width}")
                found = np.flatnonzero(ids == end) + number * block // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([number]), pa.array([len(ids)]), pa.array([found], pa.list_(pa.int64()))], ["file", "block", "ids", "ends"]
                )

    return run


def scan(files: DataFrame, root: str, width: int = 2, end: int = END, block: int = BLOCK) -> DataFrame:
    """Documents of the token files in `files` (file), which lie in the file system of the URI `root`.

    Returns file, ordinal (from 0), start (token index in the file), n_tokens (without the end id) and closed. Ids after
    the last end id are one more document, not closed; an empty file has none. A file name that is listed twice is read
    once. The size of a file is a multiple of `width`, and `block` one of `width`.
    """
    sized = files.select("file").where(F.col("file").isNotNull()).distinct().mapInArrow(_sized(root), "file string, bytes long")
    count = F.ceil(F.col("bytes") / block)
    blocks = sized.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("block"))
    found = blocks.repartition("file", "block").mapInArrow(_searched(root, width, end, block), "file string, block long, ids long, ends array<long>")
    found = stage(found)

    # prefix scan: spans of blocks, then the blocks of a span
    own = found.select(
        "file", "block", F.floor(F.col("block") / SPAN).alias("span"), "ids", F.size("ends").cast("long").alias("n"),
        (F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1) + 1).alias("next"),
    )
    spans = own.groupBy("file", "span").agg(F.sum("n").alias("n"), F.max("next").alias("next"), F.sum("ids").alias("ids"))
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = spans.select(
        "file", "span", F.coalesce(F.sum("n").over(before), zero).alias("span_n"), F.coalesce(F.max("next").over(before), zero).alias("span_next"),
        F.sum("ids").over(Window.partitionBy("file")).alias("all"), F.max("next").over(Window.partitionBy("file")).alias("last"),
        F.sum("n").over(Window.partitionBy("file")).alias("closed"), F.row_number().over(Window.partitionBy("file").orderBy("span")).alias("nth"),
    )
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = own.join(spans, ["file", "span"]).select(
        "file", "block", (F.col("span_n") + F.coalesce(F.sum("n").over(inside), zero)).alias("first"),
        F.greatest("span_next", F.max("next").over(inside)).alias("begin"),
    )
    ends = found.where(F.size("ends") > 0).join(stitched, ["file", "block"])
    starts = F.transform("ends", lambda x, i: F.when(i == 0, F.col("begin")).otherwise(F.element_at("ends", F.greatest(i, F.lit(1))) + 1))
    docs = ends.select("file", "first", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))).alias("at", "d"))
    docs = docs.select(
        "file", (F.col("first") + F.col("at")).alias("ordinal"), F.col("d.start").alias("start"),
        (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    rest = spans.where("nth = 1").withColumn("from", F.coalesce("last", zero)).where(F.col("all") > F.col("from"))
    rest = rest.select("file", F.col("closed").alias("ordinal"), F.col("from").alias("start"), (F.col("all") - F.col("from")).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.unionByName(rest)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files below the shared folder, as a URI."""
    root = f"{stage_root(spark)}/tokens-{uuid.uuid4().hex}"
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    files, folder = pyarrow.fs.FileSystem.from_uri(root)
    files.create_dir(folder, recursive=True)
    return root
