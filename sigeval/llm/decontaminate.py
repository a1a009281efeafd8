"""Benchmark decontamination by a prefix-filtered set join.

A window is a number of consecutive words of a benchmark item, and a document that contains it contains all its
shingles. So it is enough to join the documents on one shingle of each window, and the rarest one gives the fewest
candidates (for full containment the necessary prefix has length one). The scan of the documents keeps only stretches of
words whose shingles may be in the benchmark, which a bitmap of fixed size tells, and drops stretches shorter than
the shortest window. A long stretch is cut into pieces that overlap by a window, so that no row grows with the text. The
frequencies, the join, its positional bounds and the exact comparison of words run on those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as B
from .common import filled, row_keys, stage
from .url_reputation import LOWER, UPPER

WINDOW = 10
SHINGLE = 5
PIECE = 64  # words of a stretch that are in one row
BITS = 24  # the bitmap has 2^BITS bits whatever the size of the benchmark; a fuller one only lets more through
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct rows (item, window, length): `size` consecutive words, or all words of a shorter item, space-joined."""
    words = F.regexp_extract_all(F.translate(filled(text), UPPER, LOWER), F.lit(WORDS), F.lit(0))
    split = benchmark.select(F.col(item).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    rows = split.select("item", "words", F.explode(starts).alias("at"))
    part = F.slice("words", F.col("at"), size)
    return rows.select("item", F.concat_ws(" ", part).alias("window"), F.size(part).alias("length")).distinct()


def _window_shingles(batches):
    """(window, length) to (window, length, offset, shingle)."""
    for batch in batches:
        names, lengths, offsets, hashes = [], [], [], []
        for window, length in zip(batch["window"].to_pylist(), batch["length"].to_pylist(), strict=True):
            data = np.frombuffer(window.encode(), dtype=np.uint8)
            own = B.shingle_hashes(B.word_hashes(data, *B.word_bounds(data, B.LETTERS_DIGITS)), min(SHINGLE, length))
            names += [window] * len(own)
            lengths += [length] * len(own)
            offsets += range(len(own))
            hashes.append(own)
        found = np.concatenate([np.empty(0, np.uint64), *hashes]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(lengths, pa.int32()), pa.array(offsets, pa.int32()), pa.array(found)],
            ["window", "length", "offset", "shingle"],
        )


def bitmap(shingles: DataFrame) -> np.ndarray:
    """One bit per hash prefix; at most 2^BITS / 64 longs come to the driver."""
    place = F.shiftrightunsigned("shingle", 64 - BITS)
    words = shingles.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(shingle, 40) & 63L AS int))")).alias("bits"))
    found = words.toPandas()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


RUN = pa.struct([("start", pa.int32()), ("words", pa.string()), ("at", pa.list_(pa.int32())), ("shingle", pa.list_(pa.int64()))])


def _pieces(first: int, last: int, longest: int) -> list[tuple[int, int]]:
    """[first, last) as ranges of bounded size that together hold every range of at most `longest`."""
    size = max(PIECE, 4 * longest)
    return [(a, min(a + size, last)) for a in range(first, max(last - longest + 1, first + 1), size - longest + 1)]


def _stretches(bits, lengths: list[int], shortest: int):
    """Scan of (doc_id, k1, k2, text): adds n_words and the stretches of words that may hold a window."""
    sizes, longest = sorted({min(SHINGLE, n) for n in lengths}), max(lengths, default=0)

    def run(batches):
        for batch in batches:
            counts, out = np.zeros(batch.num_rows, dtype=np.int64), [[] for _ in range(batch.num_rows)]
            for chunk in B.chunks(batch["text"]):
                data = B.LOWER[np.frombuffer(chunk.data, dtype=np.uint8)]
                starts, ends = B.word_bounds(data, B.LETTERS_DIGITS)
                doc = np.searchsorted(chunk.starts, starts, side="right") - 1
                counts[chunk.first : chunk.first + len(chunk.starts)] = np.bincount(doc, minlength=len(chunk.starts))
                if not sizes or not len(starts):
                    continue
                words = B.word_hashes(data, starts, ends)
                hits, change = [], np.zeros(len(words) + 1, dtype=np.int32)
                for n in sizes:
                    own = B.shingle_hashes(words, n)
                    place = own >> np.uint64(64 - BITS)
                    known = (bits.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                    at = np.flatnonzero(known.astype(bool) & (doc[: len(own)] == doc[n - 1 :]))
                    np.add.at(change, at, 1)
                    np.add.at(change, at + n, -1)
                    hits.append((at, own[at]))
                covered = np.cumsum(change[:-1]) > 0
                # a stretch also ends where a text ends
                first = np.flatnonzero(covered & np.concatenate([[True], ~covered[:-1] | (doc[1:] != doc[:-1])]))
                last = np.flatnonzero(covered & np.concatenate([~covered[1:] | (doc[1:] != doc[:-1]), [True]])) + 1
                long = last - first >= shortest
                at, shingle = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.argsort(at, kind="stable")
                at, shingle = at[order], shingle[order].view(np.int64)
                begin = np.searchsorted(doc, np.arange(len(chunk.starts)))
                ranges = [p for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True) for p in _pieces(a, b, longest)]
                for a, b in ranges:
                    base = begin[doc[a]]
                    i, j = np.searchsorted(at, [a, b])
                    text = b" ".join(data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)).decode()
                    out[chunk.first + doc[a]].append(
                        {"start": a - base, "words": text, "at": at[i:j] - base, "shingle": shingle[i:j]}
                    )
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["k1"], batch["k2"], pa.array(counts), pa.array(out, pa.list_(RUN))], ["doc_id", "k1", "k2", "n_words", "runs"]
            )

    return run


def _union_length(start: Column, end: Column, doc: list[str]) -> Column:
    """Words an interval adds to those that start before it in the same document."""
    earlier = Window.partitionBy(*doc).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.lit(0), end - F.greatest(start, F.coalesce(F.max(end).over(earlier), F.lit(0))))


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", size: int = WINDOW
) -> DataFrame:
    """One row per input row: doc_id, k1, k2 (see `row_keys`), n_words, n_hit, items (sorted strings).

    Words are lower-cased runs of letters, digits and characters beyond ASCII. A word is hit if it lies in an occurrence
    of a window of the benchmark; `items` are those with an occurring window. NULL and empty texts have no words; items
    without words have no window, and items without an id hit words but are not listed. Rows that repeat key and text
    get the same result each. With an empty benchmark nothing is hit; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    windows = stage(windows_of(benchmark, item, size=size))
    shingles = stage(
        windows.select("window", "length").distinct().mapInArrow(_window_shingles, "window string, length int, offset int, shingle long")
    )
    lengths = [r.length for r in windows.select("length").distinct().collect()]  # at most `size` values
    bits = spark.sparkContext.broadcast(bitmap(shingles))

    run = "array<struct<start:int,words:string,at:array<int>,shingle:array<long>>>"
    doc_type = docs.schema[key].dataType.simpleString()
    scanned = docs.select(F.col(key).alias("doc_id"), *row_keys(key, text), F.col(text).cast("string").alias("text"))
    scanned = stage(
        scanned.mapInArrow(_stretches(bits, lengths, min(lengths, default=0)), f"doc_id {doc_type}, k1 long, k2 long, n_words long, runs {run}")
    )

    runs = scanned.where(F.size("runs") > 0).select("k1", "k2", F.explode("runs").alias("run"))
    tokens = runs.select("k1", "k2", F.explode(F.arrays_zip("run.at", "run.shingle")).alias("t"), "run.start", "run.words")
    tokens = tokens.select("k1", "k2", F.col("t.at").alias("at"), F.col("t.shingle").alias("shingle"), "start", "words")

    # rarity over all documents; a window with a shingle that no document has cannot occur
    common = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    ranked = shingles.join(common, "shingle", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    prefix = ranked.groupBy("window", "length").agg(F.min(F.struct("seen", "shingle", "offset")).alias("rarest")).where("rarest.seen > 0")
    prefix = stage(prefix.select("window", "length", "rarest.shingle", "rarest.offset"))

    pairs = tokens.join(prefix, "shingle").withColumn("from", F.col("at") - F.col("offset"))
    words = F.split("words", " ")
    inside = (F.col("from") >= F.col("start")) & (F.col("from") + F.col("length") <= F.col("start") + F.size(words))
    same = F.concat_ws(" ", F.slice(words, F.col("from") - F.col("start") + 1, F.col("length"))) == F.col("window")
    hits = stage(pairs.where(inside).where(same).select("k1", "k2", "from", (F.col("from") + F.col("length")).alias("to"), "window"))

    doc = ["k1", "k2"]
    spans = hits.select(*doc, "from", "to").distinct()
    n_hit = spans.select(*doc, _union_length(F.col("from"), F.col("to"), doc).alias("own")).groupBy(*doc).agg(F.sum("own").alias("n_hit"))
    found = hits.select(*doc, "window").distinct().join(windows.select("window", "item"), "window").select(*doc, "item").distinct()
    found = found.groupBy(*doc).agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = scanned.select("doc_id", *doc, "n_words").join(n_hit, doc, "left").join(found, doc, "left")
    return out.select(
        "doc_id", *doc, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows without those that contain a window of the benchmark."""
    bad = stage(contamination(docs, benchmark, key, text).where("n_hit > 0").select("k1", "k2").distinct())
    a, b = row_keys(key, text)
    marked = docs.select(F.struct(*docs.columns).alias("row"), a, b)
    return marked.join(bad, ["k1", "k2"], "left_anti").select("row.*")
