"""Near copies: fingerprints within two bits (operator 6), and all pairs of texts whose shingle sets are similar.

The second search is an exact prefix-filtered set join. Sets with Jaccard >= `at` share one of the first
|s| - ceil(at |s|) + 1 shingles of each in any order that is common to all sets. The order used puts frequent shingles last, so
that a common passage makes no long lists: all shingles of all texts are counted in a fixed number of hashed counters, and shingles go by
the size of theirs. The counters decide the order only, never a result. Postings are packed and shuffled once; lists of a single
document end there.

A posting carries the shingle's position in its set. At the first shingle that two sets share, neither can have fewer shingles
left than they must share; pairs and members of lists that fail this are never candidates.

Only components matter, so pairs that are linked already are not compared: each list first compares its members
with the one that has the fewest rarer shingles (of the copies of a text that is the one changed least), and then what is still
in different components pairwise. Equal sets are one node.

Before the sets of a pair are moved, their sketches are compared: a bit that one sketch has and the other lacks stands for at least
one shingle that the other set lacks, so pairs whose sketches rule the similarity out never ask for their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from . import simhash
from .common import drop_staged, stage, staged_tables
from .components import components
from .decontaminate import bitmap

WORDS = 5
SIMILAR = 0.8
COUNTERS = 20  # counters of shingles, as a power of two: a byte each is broadcast
BLOCK = 1 << 12  # counters that are added up together
BITS = 24  # bitmap of the rows whose sets are compared; a fuller one only lets more through to the join
SKETCH = 1 << 10  # bits of a set's sketch; a full one rules nothing out
SKETCHED = 1 << 12  # sets that are sketched at once
KEPT = 1 << 28  # kept rows up to which they are looked up in a broadcast table of 64 a row; beyond, documents are shuffled


def _sets(chunk: B.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle), sorted and distinct; a text of fewer than n words is one shingle, one without words has none."""
    data = B.LOWER[np.frombuffer(chunk.data, dtype=np.uint8)]
    starts, ends = B.word_bounds(data, B.NOT_SPACE)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    doc = np.searchsorted(chunk.starts, starts, side="right") - 1
    words = B.word_hashes(data, starts, ends)
    counts = np.bincount(doc, minlength=len(chunk.starts))
    own = B.shingle_hashes(words, n)
    whole = doc[: len(own)] == doc[n - 1 :] if len(own) else np.empty(0, bool)
    owner, value = [doc[: len(own)][whole]], [own[whole]]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        owner.append(short)
        value.append(B.shingle_hashes(words, k)[np.searchsorted(doc, short)] if len(short) else np.empty(0, np.uint64))
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _digests(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with words, where their shingles begin, how many they are, and a 64-bit hash of each set."""
    full, first, sizes = np.unique(owner, return_index=True, return_counts=True)
    sums = np.add.reduceat(B.mixed(value ^ np.uint64(0x5851F42D4C957F2D)), first) if len(first) else np.empty(0, np.uint64)
    return full, first, sizes, B.mixed(sums + sizes.astype(np.uint64))


def _sketches(value: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bits that the shingles of each set have in SKETCH."""
    place, out = (value & np.uint64(SKETCH - 1)).astype(np.int64), []
    for a in range(0, len(first), SKETCHED):
        own = sizes[a : a + SKETCHED]
        bits = np.zeros(len(own) * SKETCH, dtype=bool)
        bits[np.repeat(np.arange(len(own)) * SKETCH, own) + place[first[a] : first[a] + own.sum()]] = True
        packed = np.packbits(bits).tobytes()
        out += [packed[k : k + SKETCH // 8] for k in range(0, len(packed), SKETCH // 8)]
    return out


def _nodes(n: int):
    """(row, text) to (row, node, size, sketch)."""

    def run(batches):
        for batch in batches:
            rows = batch["row"].to_numpy()
            for chunk in B.chunks(batch["text"]):
                full, first, sizes, digest = _digests(*(found := _sets(chunk, n)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[chunk.first + full]), pa.array(digest.view(np.int64)), pa.array(sizes.astype(np.int32)),
                        pa.array(_sketches(found[1], first, sizes), pa.binary()),
                    ],
                    ["row", "node", "size", "sketch"],
                )

    return run


def _members(n: int, bits):
    """(row, place, text) to (row, shingles) with the shingles as bytes, of the rows whose place is in the bitmap."""

    def run(batches):
        for batch in batches:
            place = batch["place"].to_numpy().astype(np.uint64)
            known = (bits.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(known.astype(bool)))
            rows = batch["row"].to_numpy()
            for chunk in B.chunks(batch["text"]):
                full, first, sizes, _ = _digests(*(found := _sets(chunk, n)))
                parts = [found[1][a : a + k].tobytes() for a, k in zip(first.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[chunk.first + full]), pa.array(parts, pa.binary())], ["row", "shingles"])

    return run


def _counted(n: int):
    """Counters of the shingles of a task, by blocks."""

    def run(batches):
        counts = np.zeros(1 << COUNTERS, dtype=np.uint32)
        for batch in batches:
            for chunk in B.chunks(batch["text"]):
                counts += np.bincount((_sets(chunk, n)[1] >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
        for block in range(len(counts) // BLOCK):
            part = counts[block * BLOCK : (block + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])

    return run


def _levels(batches):
    """Sums of blocks of counters as eighths of powers of two. There are 2^COUNTERS / BLOCK blocks, whatever the input."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            own = sums.setdefault(block, np.zeros(BLOCK, dtype=np.int64))
            own += np.frombuffer(counts, dtype=np.uint32)
    for block, own in sums.items():
        level = np.minimum(np.log2(own + 1.0) * 4, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"])


def levels(texts: DataFrame, n: int) -> np.ndarray:
    """How frequent the shingles of each counter are in all texts."""
    counted = texts.select("text").mapInArrow(_counted(n), "block int, counts binary").repartition("block")
    out = np.zeros(1 << COUNTERS, dtype=np.uint8)
    for row in counted.mapInArrow(_levels, "block int, levels binary").collect():  # one byte for each counter
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.levels, dtype=np.uint8)
    return out


def _postings(n: int, at: float, level, parts: int):
    """(row, text) to packed postings (part, high, low, token, at): 16 bits of the row, 32 of the shingle and its position for each.

    Positions from 65,535 on are kept as that, which only lets more pairs through.
    """

    def run(batches):
        for batch in batches:
            rows = batch["row"].to_numpy()
            for chunk in B.chunks(batch["text"]):
                owner, value = _sets(chunk, n)
                if not len(owner):
                    continue
                late = level.value[(value >> np.uint64(64 - COUNTERS)).astype(np.int64)]
                order = np.lexsort((value, late, owner))
                owner, value = owner[order], value[order]
                _, first, sizes = np.unique(owner, return_index=True, return_counts=True)
                rank = np.arange(len(owner)) - np.repeat(first, sizes)
                keep = rank < np.repeat(sizes - np.ceil(at * sizes - 1e-9).astype(np.int64) + 1, sizes)
                row, token, place = rows[chunk.first + owner[keep]], value[keep], np.minimum(rank[keep], 0xFFFF).astype(np.uint16)
                part = (token >> np.uint64(32)) % np.uint64(parts)
                order = np.lexsort((row, part))
                row, token, place, part = row[order], token[order], place[order], part[order].astype(np.int32)
                high = row >> 16
                cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(high) != 0)) + 1
                begin = np.concatenate([[0], cuts]).astype(np.int64)
                packed = ((row & 0xFFFF).astype(np.uint16), token.astype(np.uint32), place)
                packed = [pa.array([x.tobytes() for x in np.split(own, cuts)], pa.binary()) for own in packed]
                yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(high[begin]), *packed], ["part", "high", "low", "token", "at"])

    return run


def _lists(batches):
    """Packed postings, sorted by part, to (list, row, at), without the lists of one row. One part is held at a time."""
    part, names, rows, places = None, [], [], []

    def done():
        name, row, at = np.concatenate(names), np.concatenate(rows), np.concatenate(places)
        order = np.argsort(name, kind="stable")
        name, row, at = name[order], row[order], at[order]
        shared = np.zeros(len(name), bool)
        same = name[1:] == name[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        columns = [(part << 32) + name[shared].astype(np.int64), row[shared], at[shared].astype(np.int32)]
        for k in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in columns], ["list", "row", "at"])

    for batch in batches:
        for next_part, high, low, token, at in zip(*(batch[c].to_pylist() for c in ("part", "high", "low", "token", "at")), strict=True):
            if next_part != part and names:
                yield from done()
                names, rows, places = [], [], []
            part = next_part
            names.append(np.frombuffer(token, dtype=np.uint32))
            places.append(np.frombuffer(at, dtype=np.uint16))
            rows.append((high << 16) + np.frombuffer(low, dtype=np.uint16).astype(np.int64))
    if names:
        yield from done()


def _possible(at: float):
    """(a, b, na, nb, ka, kb) to the pairs (a, b) that sizes n and sketches k do not rule out."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint64).reshape(-1, SKETCH // 64) for c in ("ka", "kb"))
            na, nb = (batch[c].to_numpy().astype(np.int64) for c in ("na", "nb"))
            both = np.minimum(na - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(both >= at * (na + nb - both) - 1e-9))

    return run


def _similar(at: float):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= at * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(texts: DataFrame, first: DataFrame, pairs: DataFrame, n: int, at: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar. `first` has one row of each node, with its size and sketch, and only those are read again."""
    held = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first, "node"))
    a, b = (held.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
    sketched = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ka", "kb")
    pairs = stage(sketched.mapInArrow(_possible(at), "a long, b long"))
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(held.select("node", "row"), "node"))
    marked = texts.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("row").alias("shingle"))))
    placed = texts.select("row", F.shiftrightunsigned(F.xxhash64("row"), 64 - BITS).alias("place"), "text")
    sets = stage(placed.mapInArrow(_members(n, marked), "row long, shingles binary").join(wanted, "row").select("node", "shingles"))
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return stage(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_similar(at), "a long, b long"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, size, lab) with lab replaced by the root of its component under the links of labels."""
    roots = components(links).select(F.col("node").alias("lab"), "root")
    return labels.join(roots, "lab", "left").select("node", "size", F.coalesce("root", "lab").alias("lab"))


def _ends(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Links of nodes as links of their labels."""
    a = labels.select(F.col("node").alias("a"), F.col("lab").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("lab").alias("lb"))
    return found.join(a, "a").join(b, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))


def similar_links(texts: DataFrame, labelled: DataFrame, n: int = WORDS, at: float = SIMILAR) -> DataFrame:
    """Links (a, b) of labels, enough to connect the labels of all rows whose shingle sets have Jaccard >= `at`.

    `texts` has (row, text), `labelled` (row, lab): rows with equal labels are connected already. Sets are compared as
    64-bit hashes of shingles of n lower-cased words.
    """
    spark = texts.sparkSession
    nodes = stage(texts.mapInArrow(_nodes(n), "row long, node long, size int, sketch binary"))
    own = stage(nodes.join(labelled, "row").groupBy("node", "size", "lab").agg(F.count(F.lit(1)).alias("copies")))
    labels = stage(own.groupBy("node", "size").agg(F.min("lab").alias("lab")))
    equal = own.select("node", F.col("lab").alias("a")).join(labels.select("node", F.col("lab").alias("b")), "node")
    links = stage(equal.where("a <> b").select("a", "b").distinct())

    first = stage(nodes.groupBy("node").agg(F.min(F.struct("row", "size", "sketch")).alias("least")).select("node", "least.*"))
    level = spark.sparkContext.broadcast(levels(texts, n))
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.mapInArrow(_postings(n, at, level, parts), "part int, high long, low binary, token binary, at binary")
    lists = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_lists, "list long, row long, at int")
    lists = stage(lists.join(nodes.select("row", "node"), "row").groupBy("list", "node").agg(F.min("at").alias("at")))

    def shared(size, other):
        """Least number of shingles that similar sets of these sizes share."""
        return F.ceil((size + other) * F.lit(at / (1 + at)) - 1e-6)

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs of members (x, y) of a list that have enough shingles left from its shingle on."""
        x, y = F.col("x.size"), F.col("y.size")
        fits = (x >= y * F.lit(at) - 1e-9) & (y >= x * F.lit(at) - 1e-9)
        left = F.least(x - F.col("x.at"), y - F.col("y.at")) >= shared(x, y)
        return pairs.where(fits & left).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def mixed(members: DataFrame) -> DataFrame:
        """Members of the lists that hold more than one label."""
        held = members.groupBy("list").agg(F.min("lab").alias("low"), F.max("lab").alias("high")).where("low < high").select("list")
        return members.join(held, "list")

    def reaching(members: DataFrame) -> DataFrame:
        """Members with enough shingles left for the smallest set of their list that fits them."""
        least = members.groupBy("list").agg(F.min("size").alias("least"))
        smallest = F.greatest("least", F.ceil(F.col("size") * F.lit(at) - 1e-9))
        return members.join(least, "list").where(F.col("size") - F.col("at") >= shared(F.col("size"), smallest)).drop("least")

    # each member with one of its list
    labels = stage(_relabelled(labels, links))
    rest = stage(mixed(lists.join(labels, "node")))
    head = rest.groupBy("list").agg(F.min(F.struct("at", "node", "size", "lab")).alias("y")).select("list", "y.*")
    tested = stage(candidates(rest.alias("x").join(head.alias("y"), "list").where("x.lab <> y.lab")))
    links = stage(links.union(_ends(_verified(texts, first, tested, n, at), labels)))

    # what is still apart, pairwise; labels only merge, so lists of one label stay so
    labels = stage(_relabelled(labels, links))
    rest = stage(mixed(reaching(mixed(rest.select("list", "node", "at").join(labels, "node")))))
    both = rest.alias("x").join(rest.alias("y"), "list").where("x.node < y.node AND x.lab <> y.lab")
    more = stage(candidates(both).join(tested, ["a", "b"], "left_anti"))
    return links.union(_ends(_verified(texts, first, more, n, at), labels))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, at: float = SIMILAR) -> DataFrame:
    """The input rows with one of each component: that with the smallest key (NULL last), and one of repeated rows.

    Linked are fingerprints within two bits, as in operator 6, and sets of n-word shingles with Jaccard >= `at`.
    """
    tagged = stage(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    before = staged_tables()
    source = tagged.select(F.col(f"doc.{key}").alias("doc_id"), F.col(f"doc.{text}").cast("string").alias("text"), "row")
    rows = stage(simhash.fingerprints(source, row=F.col("row")))
    near = components(simhash.links(stage(rows.select("fp").distinct())))
    near = near.select(F.col("node").alias("fp"), F.col("root").alias("top"))
    labelled = stage(rows.join(near, "fp", "left").select("doc_id", "row", F.coalesce("top", "fp").alias("lab")))

    found = components(similar_links(source.where("text IS NOT NULL").select("row", "text"), labelled.select("row", "lab"), n, at))
    found = found.select(F.col("node").alias("lab"), "root")
    whole = labelled.join(found, "lab", "left").select("doc_id", "row", F.coalesce("root", "lab").alias("lab"))
    lead = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    used = staged_tables()
    firsts = stage(whole.groupBy("lab").agg(F.min(lead).alias("lead")).select("lead.row"))
    drop_staged(before, used)  # the result reads `tagged` and `firsts` only
    return _those(tagged, firsts).select("doc.*")


def _those(tagged: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of `tagged` whose number `row` is in the staged `firsts`.

    Numbers are dense within a partition, so 64 of them share a long and the documents stay where they are.
    """
    if firsts.count() > KEPT:
        return tagged.join(firsts, "row", "left_semi")
    words = firsts.groupBy(F.shiftright("row", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(row & 63L AS int))")).alias("bits"))
    inside = F.expr("shiftrightunsigned(bits, cast(row & 63L AS int)) & 1L") == 1
    return tagged.withColumn("word", F.shiftright("row", 6)).join(F.broadcast(words), "word").where(inside).select(tagged.columns)
