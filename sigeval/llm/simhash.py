"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to reference fingerprints: zero and, for each block of two bits,
the mask of that block. By the triangle inequality two fingerprints within r bits differ by at most r in every
distance. Moreover, the distance to zero and to a mask give the ones inside the block, so at most r blocks change their
count. With the blocks dealt into r + 3 groups, some three groups are unchanged, and fingerprints meet in the buckets of
all choices of three groups. In a bucket pairs are discarded by the largest difference of their distances to all
references, and the survivors are compared bit by bit.

A bucket of more than `CROWD` fingerprints (many near copies of one text) is not compared pair by pair: its members meet
at the fingerprints one bit away from them instead, where at most 65 can meet; that is exact for r = 2.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .common import stage
from .components import components

SEED = 42
RADIUS = 2
BLOCK = 2
CROWD = 256

PIVOTS = np.array([0] + [((1 << BLOCK) - 1) << (BLOCK * j) for j in range(64 // BLOCK)], dtype=np.uint64)


# ---------------------------------------------------------------- fingerprints
def _shingled(data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, with the bounds of each word in them."""
    word = B.NOT_SPACE[data]
    kept = word | np.concatenate([[False], word[:-1]])
    joined = np.where(word, data, np.uint8(32))[kept]
    starts, ends = B.word_bounds(joined, B.NOT_SPACE)
    return joined.tobytes(), starts, ends


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from the hashes of its shingles; `first` is where each (non-empty) text begins."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    # sums of up to 128 rows fit a byte; those of a text are then added up
    parts = np.unique(np.concatenate([first, np.arange(0, len(hashes), 128)]))
    sums = np.add.reduceat(bits, parts, axis=0, dtype=np.uint8)
    counts = np.add.reduceat(sums, np.searchsorted(parts, first), axis=0, dtype=np.int64)
    sizes = np.diff(np.append(first, len(hashes)))
    return np.packbits(counts * 2 > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprints(n: int):
    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for chunk in B.chunks(batch["text"]):
                data = B.LOWER[np.frombuffer(chunk.data, dtype=np.uint8)]
                joined, starts, ends = _shingled(data)
                begins, _ = B.word_bounds(data, B.NOT_SPACE)
                doc = np.searchsorted(chunk.starts, begins, side="right") - 1
                if not len(starts):
                    continue
                counts = np.bincount(doc, minlength=len(chunk.starts))
                at = np.cumsum(counts) - counts
                shingles = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
                owner = np.repeat(np.arange(len(counts)), shingles)
                low = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + at[owner]
                high = np.minimum(low + n, (at + counts)[owner]) - 1
                values = (digest(joined[s:e], SEED) for s, e in zip(starts[low].tolist(), ends[high].tolist(), strict=True))
                hashes = np.fromiter(values, dtype=np.uint64, count=len(owner))
                full = np.flatnonzero(shingles)
                out[chunk.first + full] = _majority(hashes, (np.cumsum(shingles) - shingles)[full])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out.view(np.int64)), batch["row"]], ["doc_id", "fp", "row"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, row: Column | None = None) -> DataFrame:
    """(doc_id, fp, row): 64-bit SimHash of the text's shingles of n words, repeats counted, and the number `row`, by
    default one that tells the rows of this result apart.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; fewer than n words are one shingle, none give
    zero. A bit is set if it is in over half of the shingles' XXH64 (seed 42).
    """
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), row.alias("row"))
    return rows.mapInArrow(_fingerprints(n), f"doc_id {docs.schema[key].dataType.simpleString()}, fp long, row long")


# ---------------------------------------------------------------- links
def distances(fps: np.ndarray) -> np.ndarray:
    """Pivot table: Hamming distance of each fingerprint (rows) to each reference (columns)."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _bucketed(radius: int):
    groups = np.array_split(np.arange(1, len(PIVOTS)), radius + 3)
    choices = [np.concatenate(c) for c in combinations(groups, 3)]

    def run(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy()
            table = distances(fps.view(np.uint64)).astype(np.int64)
            ones = (table[:, :1] + BLOCK - table) // 2  # inside each block
            for number, choice in enumerate(choices):
                place = (BLOCK + 1) ** np.arange(len(choice), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fps), number, np.int32)), pa.array(ones[:, choice] @ place), batch["fp"]], ["choice", "bucket", "fp"]
                )

    return run


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of fingerprints of the same group (equal values are adjacent) within `radius` bits."""
    table, found, lag = distances(fps), [], 1
    at = np.arange(len(fps))
    while True:
        at = at[at < len(fps) - lag]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        close = np.abs(table[at] - table[at + lag]).max(axis=1) <= radius  # triangle inequality, all references
        i = at[close]
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= radius]
        found.append((i, i + lag))
        lag += 1
    none = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none, none)


def _lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position each position is connected to; n positions, links (i, j)."""
    low = np.arange(n)
    while len(i):
        new = low.copy()
        np.minimum.at(new, j, low[i])
        np.minimum.at(new, i, low[j])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _links(radius: int, crowd: int):
    """Rows (choice, bucket, fp) sorted by bucket to links (a, b), one per fingerprint that has one in its bucket;
    b is NULL for members of a crowded bucket. At most one batch and one bucket's first `crowd` rows are held."""

    def run(batches):
        held, crowded = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch["choice"].to_numpy().astype(np.int64), batch["bucket"].to_numpy(), batch["fp"].to_numpy()])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            edge = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            first = np.concatenate([[0], edge]).astype(np.int64)
            sizes = np.diff(np.append(first, rows.shape[1]))
            group = np.repeat(np.arange(len(first)), sizes)
            many = sizes > crowd
            if crowded is not None and len(first) and (rows[:2, 0] == crowded).all():
                many[0] = True  # the bucket goes on from the batch before
            # the last bucket may go on in the next batch
            open_ = not many[-1]
            done = len(first) - 1 if open_ else len(first)
            held = rows[:, first[-1] :] if open_ else None
            crowded = None if open_ else rows[:2, -1].copy()
            yield from _emit(rows[2], group, many, done, radius)
        if held is not None:
            yield from _emit(held[2], np.zeros(held.shape[1], dtype=np.int64), np.zeros(1, dtype=bool), 1, radius)

    return run


def _emit(fps, group, many, done, radius):
    use = group < done
    crowd = use & many[group]
    few = use & ~crowd
    values, own = fps[few].view(np.uint64), group[few]
    i, j = near_pairs(values, own, radius)
    low = _lowest(len(values), i, j)
    linked = np.flatnonzero(low != np.arange(len(values)))
    a = np.concatenate([values[linked].view(np.int64), fps[crowd]])
    b = pa.array(np.concatenate([values[low[linked]].view(np.int64), np.zeros(crowd.sum(), np.int64)]), mask=np.arange(len(a)) >= len(linked))
    yield pa.RecordBatch.from_arrays([pa.array(a), b], ["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints within `radius` bits, enough to connect all that are connected."""
    if radius != 2:
        raise ValueError("crowded buckets are resolved through common neighbours, which needs radius 2")
    buckets = distinct.select("fp").mapInArrow(_bucketed(radius), "choice int, bucket long, fp long")
    spread = buckets.repartition("choice", "bucket").sortWithinPartitions("choice", "bucket", "fp")
    found = stage(spread.mapInArrow(_links(radius, crowd), "a long, b long"))
    member = found.where("b IS NULL").select("a").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(x - (1 << 64) if x >> 63 else x) for x in (1 << k for k in range(64))])
    around = member.select("a", F.explode(flips).alias("flip")).select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("centre"))
    hub = around.groupBy("centre").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = around.join(hub, "centre").where("a <> b").select("a", "b")
    return found.where("b IS NOT NULL").union(met).distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, radius: int = RADIUS, row: Column | None = None
) -> DataFrame:
    """One row per input row: doc_id, row, fp, component_id (smallest doc_id that links within `radius` bits reach), first.

    `first` is true for one row of each component, that with the smallest doc_id (NULL last). NULL and empty texts have
    fingerprint zero and link like any other. Equal fingerprints are one node, so copies are not expanded into pairs.
    An empty table gives an empty result; other columns are not read.
    """
    rows = stage(fingerprints(docs, key, text, n, row))
    lead = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    nodes = stage(rows.groupBy("fp").agg(F.min(lead).alias("lead")))
    linked = stage(components(links(nodes, radius)))
    joined = linked.join(nodes, F.col("node") == F.col("fp"))
    leads = joined.groupBy("root").agg(F.min("lead").alias("top"))
    tops = linked.join(leads, "root").select(F.col("node").alias("fp"), "top")
    tops = stage(nodes.join(tops, "fp", "left").select("fp", F.coalesce("top", "lead").alias("top")))
    return rows.join(tops, "fp").select(
        "doc_id", "row", "fp", F.col("top.doc_id").alias("component_id"), (F.col("row") == F.col("top.row")).alias("first")
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, radius: int = RADIUS) -> DataFrame:
    """The input rows with one of each component: that with the smallest key, and one of repeated rows."""
    tagged = stage(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    found = near_duplicates(tagged.select(f"doc.{key}", f"doc.{text}", "row"), key, text, n, radius, F.col("row"))
    copies = stage(found.where(~F.col("first")).select("row"))
    return tagged.join(copies, "row", "left_anti").select("doc.*")
