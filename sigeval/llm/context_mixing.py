"""Language-model scores by online logistic context mixing.

A text is a sequence of bytes and an end. Each symbol is a path of binary decisions in a Huffman tree over the training bytes that
follow the byte before it, if that is frequent, else over all of them; fewer decisions are left where the last byte tells much. Each decision is predicted from several contexts: the last two bytes, the last four, and the word so far. A predictor is a slot of a
hashed table with the counts of both outcomes in all training texts; tasks add up their own tables, and their sums meet
by blocks of slots. While a text is scored the tables stay as they are and the mixer learns: the log odds of
the predictors are added with weights, a set of them chosen by how many of the long contexts are known, and the sum is refined by an offset of its
range. Weights and offsets start alike for every text and follow the errors after each block of bytes, so a prediction only
depends on the text before it and the probabilities of all texts add up to one. Blocks grow with the text.

Beside it a base score comes from the counts of all words in the training texts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .common import filled, stage
from .lookups import Frequent, Tally, divided

END = 256
ORDERS = (2, 4)  # bytes of the contexts before that of the word
#: Slots of each predictor as a power of two.
SLOTS = (19, 19, 19)
BLOCK = 1 << 12  # slots that are added up together
CHUNK = 1 << 18  # bytes of texts that are scored side by side
PART = 1 << 13  # symbols whose decisions are held at once
HELD = 1 << 21  # decisions of a predictor that are counted at once
TREE = 1 << 15  # training symbols after a byte from which that byte has a tree of its own
LIMIT = 8.0  # largest log odds of a predictor
SCALE = 4000  # log odds are kept as 16-bit integers in parts of 1 / SCALE
PRIOR = 0.4
GATES = 4
WEIGHTS = (0.4, 0.4, 0.4)  # of the predictors at the start of a text
RATE = 0.005
RANGES, STEP, OFFSET_RATE = 24, 1.5, 0.01
#: Ends of the blocks after which the mixer learns: bytes from the start of a text, then every BLOCK_BYTES.
FIRST_BLOCKS = (16, 48, 112, 240, 496)
BLOCK_BYTES = 512
SPREAD = 0x9E3779B1


# ---------------------------------------------------------------- decisions
@dataclass
class Codes:
    """The decisions of each symbol: `nodes` and `bits` from `start`, `length` of them.

    There are 257 symbols to a tree; `trees` has the tree after each byte, and at END that of first symbols.
    """

    start: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    trees: np.ndarray


def huffman(counts: np.ndarray, number: int = 0) -> Codes:
    """Decisions of the 257 symbols in one tree; a floor under the counts bounds its depth. `number` tells its nodes from those of others."""
    weights = np.maximum(np.asarray(counts, dtype=np.float64), counts.sum() / (1 << 20)) + 1.0
    heap = [(w, k, (k,)) for k, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    paths = [[] for _ in weights]
    for node in range(len(weights) - 1):
        left, right = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in enumerate((left, right)):
            for symbol in side[2]:
                paths[symbol].append((node, bit))
        heapq.heappush(heap, (left[0] + right[0], len(weights) + node, left[2] + right[2]))
    length = np.array([len(p) for p in paths])
    flat = [step for p in paths for step in reversed(p)]
    nodes, bits = (np.array([step[k] for step in flat]) for k in (0, 1))
    nodes = ((nodes + number * END) * SPREAD).astype(np.uint32)
    return Codes(np.cumsum(length) - length, length, nodes, bits.astype(np.int8), np.zeros(END + 1, dtype=np.int64))


def forest(counts: np.ndarray) -> Codes:
    """Decisions of the 257 symbols in a tree for all of them and in one after each byte with TREE symbols; `counts` is by (byte before, symbol)."""
    own = np.flatnonzero(counts.sum(axis=1) >= TREE)
    trees = [huffman(counts.sum(axis=0)), *(huffman(counts[k], number) for number, k in enumerate(own.tolist(), 1))]
    after = np.zeros(END + 1, dtype=np.int64)
    after[own] = np.arange(1, len(own) + 1)
    begin = np.cumsum([0, *(len(t.nodes) for t in trees)])
    start = np.concatenate([t.start + at for t, at in zip(trees, begin, strict=False)])
    length, nodes, bits = (np.concatenate([getattr(t, k) for t in trees]) for k in ("length", "nodes", "bits"))
    return Codes(start, length, nodes, bits, after)


#: The last bytes of eight, as a mask.
LAST = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], dtype=np.uint64)


def symbols(chunk: B.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (each text's bytes and its end), and the byte before each, END at the start."""
    data = np.frombuffer(chunk.data, dtype=np.uint8)
    symbol = data.astype(np.int64)
    before = np.empty_like(symbol)
    before[1:] = symbol[:-1]
    before[chunk.starts] = END
    symbol[np.append(chunk.starts[1:], len(data)) - 1] = END
    return symbol, before


def contexts(chunk: B.Chunk, codes: Codes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Symbols in their trees, their place in their text, and a 32-bit hash of each context of each.

    The word so far is what follows the last white space or the start, eight bytes of it at most.
    """
    data = np.frombuffer(chunk.data, dtype=np.uint8)
    starts = chunk.starts.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    symbol, before = symbols(chunk)
    symbol += codes.trees[before] * (END + 1)
    padded = np.concatenate([np.zeros(8, np.uint8), data])
    eight = np.ndarray(len(data), dtype="<u8", buffer=padded.data, strides=(1,)).copy()  # the bytes before each symbol, the last one highest
    begins = np.where(B.NOT_SPACE[data], 0, np.arange(1, len(data) + 1))  # a word begins behind white space
    begins = np.concatenate([np.zeros(1, np.int64), np.maximum.accumulate(begins)[:-1]])
    word = np.minimum(np.arange(len(data)) - begins, place)
    out = [eight & LAST[np.minimum(place, k)] for k in ORDERS] + [eight & LAST[np.minimum(word, 8)]]
    return symbol, place, [((x + np.uint64(k)) * B.MULTIPLIER >> np.uint64(32)).astype(np.uint32) for k, x in enumerate(out)]


@dataclass
class Decisions:
    """All decisions of some symbols: outcomes, and the slot of each predictor."""

    lengths: np.ndarray  # decisions of each symbol
    bits: np.ndarray
    slots: list[np.ndarray]  # as 32-bit integers


def decisions(symbol: np.ndarray, context: list[np.ndarray], codes: Codes) -> Decisions:
    length = codes.length[symbol]
    of = np.repeat(np.arange(len(symbol)), length)
    flat = (codes.start[symbol] - (np.cumsum(length) - length))[of]
    flat += np.arange(len(flat))
    node = codes.nodes[flat]
    slots = [(own[of] + node) >> np.uint32(32 - size) for own, size in zip(context, SLOTS, strict=True)]
    return Decisions(length, codes.bits[flat], slots)


# ---------------------------------------------------------------- learning
OFFSETS = np.cumsum([0, *[1 << s for s in SLOTS]])


def _byte_counts(batches):
    """Counts of symbols after each byte, in the training texts of a task; `symbol` is both in one number."""
    counts = np.zeros((END + 1) ** 2, dtype=np.int64)
    for batch in batches:
        for chunk in B.chunks(batch["text"], CHUNK):
            symbol, before = symbols(chunk)
            counts += np.bincount(before * (END + 1) + symbol, minlength=len(counts))
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["symbol", "n"])


def _words(chunk: B.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each word."""
    data = B.LOWER[np.frombuffer(chunk.data, dtype=np.uint8)]
    starts, ends = B.word_bounds(data, B.NOT_SPACE)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.searchsorted(chunk.starts, starts, side="right") - 1, B.word_hashes(data, starts, ends).view(np.int64)


def _gathered(codes):
    """Training texts of a task to counts of word hashes (key, n) and of slots (block, counts of both outcomes)."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        tally, table = Tally(), np.zeros((OFFSETS[-1], 2), dtype=np.uint32)
        hand = lambda key, n: pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.binary())], schema=schema)
        held, size = [[] for _ in SLOTS], 0

        def counted():
            for k, parts in enumerate(held):
                if parts:
                    table[OFFSETS[k] : OFFSETS[k + 1]] += np.bincount(np.concatenate(parts), minlength=2 << SLOTS[k]).reshape(-1, 2).astype(np.uint32)
                    parts.clear()

        for batch in batches:
            for chunk in B.chunks(batch["text"], CHUNK):
                _, words = _words(chunk)
                for key, n in tally.add(words):
                    yield hand(key, n)
                symbol, _, context = contexts(chunk, codes.value)
                for at in range(0, len(symbol), PART):
                    own = decisions(symbol[at : at + PART], [c[at : at + PART] for c in context], codes.value)
                    for slot, parts in zip(own.slots, held, strict=True):
                        parts.append(slot * np.uint32(2) + own.bits.view(np.uint8))
                    size += len(own.bits)
                    if size >= HELD:
                        counted()
                        size = 0
        counted()
        for key, n in tally.rest():
            yield hand(key, n)
        for block in range(0, len(table), BLOCK):
            part = table[block : block + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([block // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)

    return run


def _odds(batches):
    """Counts of blocks, of all tasks, to log odds. There are OFFSETS[-1] / BLOCK blocks, whatever the input."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            own = sums.setdefault(block, np.zeros((BLOCK, 2), dtype=np.int64))
            own += np.frombuffer(counts, dtype=np.uint32).reshape(-1, 2)
    for block, n in sums.items():
        odds = np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR))
        kept = np.clip(np.rint(np.clip(odds, -LIMIT, LIMIT) * SCALE), -32767, 32767).astype(np.int16)
        kept[(kept == 0) & (n.sum(axis=1) > 0)] = 1  # zero says that nothing is known
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kept.tobytes()], pa.binary())], ["block", "odds"])


@dataclass
class Model:
    codes: Codes
    odds: np.ndarray
    words: Frequent  # the frequent words with their counts
    others: DataFrame | None = field(repr=False)  # (key, n) of all other words
    texts: int  # training texts
    tokens: int  # their words and ends
    distinct: int


def fit(train: DataFrame, text: str = "text") -> Model:
    """Learns from all texts of `train` (NULL: empty)."""
    spark = train.sparkSession
    rows = train.select(filled(text).alias("text"))
    counts = rows.mapInArrow(_byte_counts, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()  # at most 257 x 257 rows
    pairs = np.zeros((END + 1) ** 2, dtype=np.int64)
    pairs[counts["symbol"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    pairs = pairs.reshape(END + 1, END + 1)
    codes = forest(pairs)
    gathered = stage(rows.mapInArrow(_gathered(spark.sparkContext.broadcast(codes)), "key long, n long, block int, counts binary"))
    blocks = gathered.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_odds, "block int, odds binary")
    odds = np.zeros(OFFSETS[-1], dtype=np.int16)
    for row in blocks.collect():  # two bytes for each slot
        odds[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.odds, dtype=np.int16)
    words = stage(gathered.where("block IS NULL").groupBy("key").agg(F.sum("n").alias("n")))
    total = words.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    frequent, others = divided(words)
    texts = int(pairs[:, END].sum())
    return Model(codes, odds, frequent, others, texts, total.n + texts, total.distinct + (texts > 0))


# ---------------------------------------------------------------- scoring
def block_of(place: np.ndarray) -> np.ndarray:
    late = np.maximum(place - FIRST_BLOCKS[-1], 0) // BLOCK_BYTES + len(FIRST_BLOCKS)
    return np.where(place < FIRST_BLOCKS[-1], np.searchsorted(FIRST_BLOCKS, place, side="right"), late)


class Mixer:
    """Weights and offsets of several texts that are scored side by side."""

    def __init__(self, texts: int):
        self.weights = np.tile(np.array(WEIGHTS, dtype=np.float32)[:, None], (1, texts * GATES))
        self.offsets = np.zeros(texts * RANGES, dtype=np.float32)

    def step(self, text: np.ndarray, bits: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of the probability of each outcome, negated; learns from all of them afterwards. `text` ascends."""
        gate = (odds[1] != 0).astype(np.int8)
        for x in odds[2:]:
            gate += x != 0
        own = text * GATES + gate
        total = self.weights[0].take(own, mode="clip") * odds[0]
        for k in range(1, len(odds)):
            total += self.weights[k].take(own, mode="clip") * odds[k]
        sign = bits.astype(np.float32)
        sign += sign - 1
        error = sign / (1 + np.exp(np.minimum(total * sign, 30)))
        place = np.maximum(np.minimum(total * np.float32(STEP) + np.float32(RANGES / 2), RANGES - 1), 0).astype(np.int64)
        place += text * RANGES
        refined = np.exp(np.minimum(-sign * (total + self.offsets.take(place, mode="clip")), 30))
        late = sign * (refined / (1 + refined))

        # the decisions of a text follow each other, so sums by text and gate are sums of runs, of what is left of each gate
        first = np.flatnonzero(np.diff(text, prepend=-1))
        lanes = text[first] * GATES
        for g in range(len(odds)):
            mask = (gate == g).astype(np.float32)
            rate = (RATE / np.sqrt(1 + np.add.reduceat(mask, first) / 64)).astype(np.float32)
            mask *= error
            for k, x in enumerate(odds if g else odds[:1]):  # the long contexts are all unknown at the first gate
                self.weights[k, lanes + g] += rate * np.add.reduceat(mask * x, first)
        count = np.bincount(place, minlength=len(self.offsets))
        rate = OFFSET_RATE / np.sqrt(1 + count / 64)
        self.offsets += rate * np.bincount(place, late, minlength=len(count))
        return np.log(1 + refined)


def log_probabilities(chunk: B.Chunk, codes: Codes, odds: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text of a chunk, given the log odds of all slots. Texts do not influence each other."""
    symbol, place, context = contexts(chunk, codes)
    sizes = np.diff(np.append(chunk.starts, len(symbol)))
    out = np.zeros(len(sizes))
    # text by text, block by block: the n-th blocks of all texts come together
    block = block_of(place)
    first = np.flatnonzero(np.diff(block, prepend=-1) | (place == 0))
    length = np.diff(np.append(first, len(symbol)))
    text = np.repeat(np.arange(len(sizes)), sizes)[first]
    order = np.lexsort((text, block[first]))
    first, length, text, turn = first[order], length[order], text[order], block[first][order]
    mixer = Mixer(len(sizes))
    turns = np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(turn))
    # several turns are prepared together, as many as a chunk holds
    done = np.cumsum(length)
    k = 0
    while k < len(turns) - 1:
        base = done[turns[k] - 1] if turns[k] else 0
        upto = max(k + 1, int(np.searchsorted(done[turns[1:] - 1], base + PART, side="right")))
        a, b = turns[k], turns[upto]
        at = np.repeat(first[a:b] - (np.cumsum(length[a:b]) - length[a:b]), length[a:b]) + np.arange(length[a:b].sum())
        own = decisions(symbol[at], [c[at] for c in context], codes)
        found = [odds[OFFSETS[j] : OFFSETS[j + 1]].take(slot, mode="clip") for j, slot in enumerate(own.slots)]
        ends = np.concatenate([[0], np.cumsum(own.lengths)])  # of the decisions of each symbol
        marks = ends[np.concatenate([[0], np.cumsum(length[a:b])])]  # of each block
        lane = np.repeat(text[a:b], np.diff(marks))
        edges = marks[turns[k : upto + 1] - a]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = slice(low, high)
            loss = mixer.step(lane[part], own.bits[part], [x[part] for x in found])
            out -= np.bincount(lane[part], loss, minlength=len(out))
        k = upto
    return out / np.log(10)


SCORED = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.int64()))])


def _scored(codes, odds, words, texts: int):
    def run(batches):
        table = odds.value / np.float32(SCALE)
        for batch in batches:
            rows = batch["row"]
            for chunk in B.chunks(batch["text"], CHUNK):
                size = len(chunk.starts)
                owner, key = _words(chunk)
                n, known = words.value.find(key)
                logs = np.bincount(owner[known], np.log10(n[known] + 1.0), minlength=size) + np.log10(texts + 1.0)
                place = np.searchsorted(owner[~known], np.arange(size + 1))
                rest = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(key[~known]))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows[chunk.first : chunk.first + size], pa.array(np.bincount(owner, minlength=size) + 1),
                        pa.array(np.bincount(owner[known], minlength=size) + int(texts > 0)), pa.array(logs),
                        pa.array(log_probabilities(chunk, codes.value, table)), rest,
                    ],
                    schema=SCORED,
                )

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, base_score, score.

    Tokens are lower-cased words and an end; `n_known` of them are in the training texts. `base_score` is the sum of log10((c + 1) /
    (tokens + distinct tokens + 1)) with the count c of each in the training texts, `score` the mixer's log10 probability of the text.
    NULL texts are empty and consist of an end. Rows that repeat a text get the same scores. An empty table gives an empty
    result; a model without training texts knows no word and splits symbols evenly. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), filled(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = [spark.sparkContext.broadcast(x) for x in (model.codes, model.odds, model.words)]
    kind = "row long, n_tokens long, known long, logs double, score double, rest array<long>"
    keys = stage(rows)
    scored = stage(keys.select("row", "text").mapInArrow(_scored(*parts, model.texts), kind))
    rest = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    rest = rest.join(model.others, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    out = keys.select("doc_id", "row").join(scored.drop("rest"), "row").join(rest, "row", "left")
    whole = float(np.log10(model.tokens + model.distinct + 1.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score",
    )


def held_out(key: Column) -> Column:
    """Rows that are not learned from; those without a key are."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))
