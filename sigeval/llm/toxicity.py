"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, written and trained in NumPy.

A word's input is an embedding of the word and the embeddings of its characters' n-grams of four and six bytes. Both vocabularies are
those of the training sample that occur in at least `LEAST_TEXTS` of its texts; what is not in them counts for nothing. An
embedding starts from how far the share of toxic texts with the word or n-gram is from that of all texts, in standard
errors; that keeps a small sample from learning rare words by heart. The network reads overlapping windows of words in both directions, attention pools the states of a window, and a
text's score is that of its worst window. Training follows the same rule: a text's label counts for the window
that scores highest at that time (after a first pass over random windows), so it learns where in a text the label comes from.

Training takes a bounded sample of labelled rows on the driver. Scoring runs in Arrow batches over all windows of all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .common import filled
from .language import held_out

SAMPLE_ROWS = 3000  # labelled rows to learn from, those with the smallest hashes of their keys
SAMPLE_BYTES = 20_000  # longest text to learn from; scoring has no such bound
WINDOW, STRIDE = 32, 16
LEAST_TEXTS = 3
GRAM_MASKS = np.array([((1 << 8 * n) - 1) << (64 - 8 * n) for n in (4, 6)], dtype=np.uint64)
EMBED, HIDDEN = 8, 8
STEPS, BATCH, RATE, EMBED_RATE = 320, 64, 0.01, 0.02  # embeddings learn at that part of the rate
RANDOM, RENEW = 100, 50  # steps on random windows, and between two searches for the highest-scoring ones
THRESHOLD = 0.3

Params = dict[str, np.ndarray]


def initial(seed: int = 0, words: np.ndarray = np.empty(0, np.uint64), grams: np.ndarray = np.empty(0, np.uint64)) -> Params:
    """Parameters for sorted vocabularies. Embeddings start at zero, and the last row, for the unknown, stays there."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    zeros = lambda *shape: np.zeros(shape, np.float32)
    out = {"words": words, "grams": grams, "word": zeros(len(words) + 1, EMBED), "gram": zeros(len(grams) + 1, EMBED)}
    for way in ("f", "b"):
        out |= {f"W{way}": normal(2 * EMBED, 3 * HIDDEN), f"U{way}": normal(HIDDEN, 3 * HIDDEN), f"c{way}": zeros(3 * HIDDEN)}
    return out | {"look": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "bias": np.full(1, -3.0, np.float32)}


# ---------------------------------------------------------------- inputs
def _lookup(vocabulary: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted vocabulary, its length if it is not there."""
    if not len(vocabulary):
        return np.zeros(len(values), dtype=np.int64)
    at = np.searchsorted(vocabulary, values)
    return np.where(vocabulary[np.minimum(at, len(vocabulary) - 1)] == values, at, len(vocabulary))


def _evidence(count: np.ndarray, ones: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Items that occur in at least LEAST_TEXTS documents, and their evidence in [-1, 1]: the standard errors by which the
    share of label 1 among their documents differs from that of all, over ten."""
    keep = np.flatnonzero(count >= LEAST_TEXTS)
    count, ones = count[keep], ones[keep]
    errors = (ones - count * share) / np.sqrt(count * share * (1 - share))
    return keep, np.clip(errors / 10, -1, 1).astype(np.float32)


def vocabularies(inputs: Inputs, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and n-grams that are frequent enough (sorted), each with its evidence. Documents are counted in blocks, so the
    pairs of documents and n-grams are never held at once."""
    doc, word = np.divmod(inputs.text_words, max(len(inputs.words), 1))
    share = float(labels.mean())
    count, ones = np.bincount(word, minlength=len(inputs.words)), np.bincount(word, labels[doc], minlength=len(inputs.words))
    words, word_evidence = _evidence(count, ones, share)

    grams, own = np.unique(inputs.grams, return_inverse=True)
    size = np.bincount(inputs.gram_word, minlength=len(inputs.words))
    start = np.cumsum(size) - size
    count, ones = np.zeros(len(grams), np.int64), np.zeros(len(grams))
    for first in range(0, len(labels), 128):
        a, b = np.searchsorted(doc, [first, first + 128])
        each = size[word[a:b]]
        place = np.repeat(start[word[a:b]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        owner, found = np.divmod(np.unique(np.repeat(doc[a:b], each) * len(grams) + own[place]), max(len(grams), 1))
        np.add.at(count, found, 1)
        np.add.at(ones, found, labels[owner])
    kept, gram_evidence = _evidence(count, ones, share)
    return inputs.words[words], word_evidence, grams[kept], gram_evidence


class Inputs:
    """Distinct words of some texts and the windows over them; `ids` has the number of distinct words as padding."""

    def __init__(self, chunk: B.Chunk, p: Params | None = None):
        data = B.LOWER[np.frombuffer(chunk.data, dtype=np.uint8)]
        starts, ends = B.word_bounds(data, B.LETTERS_DIGITS)
        hashes = B.word_hashes(data, starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = distinct
        # the distinct words side by side, a blank before and seven after each; an n-gram starts at the blank and at every
        # byte but the last
        length = ends[first] - starts[first]
        place = np.cumsum(length + 8) - length - 7
        line = np.full(int((length + 8).sum()) + 8, 32, dtype=np.uint8)
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        line[np.repeat(place, length) + within] = data[np.repeat(starts[first], length) + within]
        at = np.repeat(place - 1, length) + within
        eight = np.zeros(len(at), dtype=np.uint64)
        for k in range(8):
            eight = (eight << np.uint64(8)) | line[at + k]
        self.grams = (eight[:, None] & GRAM_MASKS).ravel()
        self.gram_word = np.repeat(np.arange(len(distinct)), length * len(GRAM_MASKS))
        self.scale = (1.0 / np.sqrt(np.maximum(length, 1))).astype(np.float32)

        n = len(chunk.starts)
        doc = np.searchsorted(chunk.starts, starts, side="right") - 1
        count = np.bincount(doc, minlength=n)
        windows = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)  # a text without words has one empty window
        self.doc = np.repeat(np.arange(n), windows)
        inside = (np.arange(len(self.doc)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
        offset = inside[:, None] + np.arange(WINDOW)
        valid = offset < count[self.doc][:, None]
        flat = np.where(valid, (np.cumsum(count) - count)[self.doc][:, None] + offset, 0)
        self.ids = np.where(valid, inverse[flat] if len(inverse) else 0, len(distinct))
        # pairs of text and distinct word as one number, which only vocabularies need
        self.text_words = np.unique(doc * len(distinct) + inverse) if p is None else None
        if p is not None:
            self.know(p)

    def know(self, p: Params) -> None:
        """Replaces words and n-grams by their places in the vocabularies."""
        self.words, self.grams = _lookup(p["words"], self.words), _lookup(p["grams"], self.grams)

    def vectors(self, p: Params) -> np.ndarray:
        """Input of each distinct word, and a zero row for padding."""
        out = np.zeros((len(self.words) + 1, 2 * EMBED), np.float32)
        out[:-1, :EMBED] = p["word"][self.words]
        if len(self.words):
            edges = np.searchsorted(self.gram_word, np.arange(len(self.words)))
            out[:-1, EMBED:] = np.add.reduceat(p["gram"][self.grams], edges, axis=0) * self.scale[:, None]
        return out


# ---------------------------------------------------------------- network
def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _read(x, ids, mask, u, reverse: bool, keep: list | None = None) -> np.ndarray:
    """States (T, N, H) of one direction; x has each distinct word's gate inputs. `keep` gets what learning needs."""
    n, steps = ids.shape
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        own, past = x[ids[:, t]], h @ u
        gates = sigmoid(own[:, : 2 * HIDDEN] + past[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(own[:, 2 * HIDDEN :] + r * past[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, z, r, new, past[:, 2 * HIDDEN :]))
        h = np.where(mask[:, t, None], new + z * (h - new), h)
        out[t] = h
    return out


def _pool(states, mask, p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    look = np.where(mask.T, states @ p["look"], -1e9)
    weight = np.exp(look - look.max(axis=0)) * mask.T
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return weight, pooled, pooled @ p["out"] + p["bias"][0]


def window_scores(inputs: Inputs, p: Params, at: np.ndarray | None = None) -> np.ndarray:
    """Logit of each window."""
    vectors, ids = inputs.vectors(p), inputs.ids if at is None else inputs.ids[at]
    mask = ids < len(vectors) - 1
    states = [_read(vectors @ p[f"W{w}"] + p[f"c{w}"], ids, mask, p[f"U{w}"], w == "b") for w in "fb"]
    return _pool(np.concatenate(states, axis=2), mask, p)[2]


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by row of an embedding table."""
    order = np.argsort(rows, kind="stable")
    found, first = np.unique(rows[order], return_index=True)
    return found, np.add.reduceat(values[order], first, axis=0) if len(found) else values


def gradient(inputs: Inputs, p: Params, at: np.ndarray, label: np.ndarray) -> tuple[float, Params]:
    """Mean logistic loss over the windows `at` and its gradient by back-propagation through time; for the embedding
    tables it is a pair (rows, values)."""
    vectors, ids = inputs.vectors(p), inputs.ids[at]
    mask, kept = ids < len(vectors) - 1, {"f": [], "b": []}
    states = np.concatenate([_read(vectors @ p[f"W{w}"] + p[f"c{w}"], ids, mask, p[f"U{w}"], w == "b", kept[w]) for w in "fb"], axis=2)
    weight, pooled, logit = _pool(states, mask, p)
    prob = sigmoid(logit)
    loss = -float(np.mean(np.where(label > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))))
    d_logit = ((prob - label) / len(at)).astype(np.float32)
    g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["out"]
    d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
    d_look = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["look"] = np.einsum("tn,tnh->h", d_look, states)
    d_states = weight[:, :, None] * d_pooled + d_look[:, :, None] * p["look"]
    d_vectors = np.zeros_like(vectors)
    for k, w in enumerate("fb"):
        u, d_u, d_h = p[f"U{w}"], np.zeros_like(p[f"U{w}"]), np.zeros((len(at), HIDDEN), np.float32)
        d_x = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        for t, h, z, r, new, past in reversed(kept[w]):
            d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            own = np.where(mask[:, t, None], d_h, 0)
            d_new = own * (1 - z) * (1 - new * new)
            d_gates = np.concatenate([own * (h - new) * z * (1 - z), d_new * past * r * (1 - r), d_new * r], axis=1)
            d_h = d_h - own + own * z + d_gates @ u.T
            d_u += h.T @ d_gates
            d_gates[:, 2 * HIDDEN :] = d_new
            np.add.at(d_x, ids[:, t], d_gates)
        g[f"U{w}"], g[f"W{w}"], g[f"c{w}"] = d_u, vectors.T @ d_x, d_x.sum(axis=0)
        d_vectors += d_x @ p[f"W{w}"].T
    used = np.unique(ids[mask])
    g["word"] = _by_row(inputs.words[used], d_vectors[used, :EMBED])
    chars = np.isin(inputs.gram_word, used)
    owner = inputs.gram_word[chars]
    g["gram"] = _by_row(inputs.grams[chars], d_vectors[owner, EMBED:] * inputs.scale[owner, None])
    return loss, g


def train(texts: list[str], labels: np.ndarray, seed: int = 0, steps: int = STEPS) -> Params:
    """Adam on windows of the texts in turn: random ones at first, then each text's highest-scoring one. Texts of one
    class, or none, leave the network as it starts, which scores everything low."""
    rng, labels = np.random.default_rng(seed), np.asarray(labels, dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        return initial(seed)
    (chunk,) = B.chunks(pa.array(texts, pa.string()), limit=1 << 40)
    inputs = Inputs(chunk)
    words, word_evidence, grams, gram_evidence = vocabularies(inputs, labels)
    inputs.text_words = None
    p = initial(seed, words, grams)
    p["word"][:-1, 0], p["gram"][:-1, 0] = word_evidence, gram_evidence
    inputs.know(p)
    first = np.searchsorted(inputs.doc, np.arange(len(texts)))
    count = np.bincount(inputs.doc, minlength=len(texts))
    learnt = [k for k in p if k not in ("words", "grams")]
    mean, square = ({k: np.zeros_like(p[k]) for k in learnt} for _ in range(2))
    queue = np.empty(0, dtype=np.int64)
    picked = first
    for step in range(1, steps + 1):
        if step <= RANDOM:
            picked = first + (rng.random(len(texts)) * count).astype(np.int64)
        elif (step - RANDOM) % RENEW == 1:
            parts = np.array_split(np.arange(len(inputs.doc)), len(inputs.doc) // 2048 + 1)
            score = np.concatenate([window_scores(inputs, p, at) for at in parts])
            picked = np.lexsort((-score, inputs.doc))[first]
        if len(queue) < BATCH:
            queue = np.concatenate([queue, rng.permutation(len(texts))])
        rows, queue = queue[:BATCH], queue[BATCH:]
        _, g = gradient(_Part(inputs, picked[rows]), p, np.arange(len(rows)), labels[rows])
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, v in g.items():
            rows_, v = v if isinstance(v, tuple) else (slice(None), v)
            mean[k][rows_] += 0.1 * (v - mean[k][rows_])
            square[k][rows_] += 0.001 * (v * v - square[k][rows_])
            own = rate * EMBED_RATE if k in ("word", "gram") else rate
            p[k][rows_] -= own * mean[k][rows_] / (np.sqrt(square[k][rows_]) + 1e-8)
        p["word"][-1] = p["gram"][-1] = 0
    return p


class _Part(Inputs):
    """Some windows of other inputs, with only the distinct words that occur in them."""

    def __init__(self, whole: Inputs, at: np.ndarray):
        ids = whole.ids[at]
        real = ids < len(whole.words)
        used, inverse = np.unique(ids[real], return_inverse=True)
        self.ids = np.full(ids.shape, len(used))
        self.ids[real] = inverse
        low, high = np.searchsorted(whole.gram_word, used), np.searchsorted(whole.gram_word, used, side="right")
        size = high - low
        take = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.words, self.scale, self.grams = whole.words[used], whole.scale[used], whole.grams[take]
        self.gram_word, self.doc = np.repeat(np.arange(len(used)), size), np.arange(len(at))


# ---------------------------------------------------------------- on Spark
def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Params:
    """Learns from at most `rows` labelled texts of at most SAMPLE_BYTES bytes whose key is not held out (NULL keys are)."""
    usable = labels.where(F.col(label).isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(True)))
    usable = usable.groupBy(F.col(key).alias("_key")).agg((F.max(label) > 0).cast("int").alias("_label"))
    picked = usable.orderBy(F.xxhash64("_key"), "_key").limit(rows)
    body = docs.select(F.col(key).alias("_key"), filled(text).alias("_text"))
    sample = body.where(F.octet_length("_text") <= SAMPLE_BYTES).join(F.broadcast(picked), "_key")  # at most `rows` rows
    got = sample.dropDuplicates(["_key"]).toPandas().sort_values("_key", ignore_index=True)
    return train(got["_text"].tolist(), got["_label"].to_numpy())


def _scored(shared):
    def run(batches):
        p = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for chunk in B.chunks(batch["text"]):
                inputs = Inputs(chunk, p)
                logit = np.concatenate([window_scores(inputs, p, at) for at in np.array_split(np.arange(len(inputs.doc)), len(inputs.doc) // 4096 + 1)])
                first = np.searchsorted(inputs.doc, np.arange(len(chunk.starts)))
                out[chunk.first : chunk.first + len(chunk.starts)] = sigmoid(np.maximum.reduceat(logit, first).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every input row: the probability of label 1 of the text's worst window.

    NULL and empty texts, and texts without words, get the score of an empty window. Repeated rows get the same score;
    an empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    rows = docs.select(F.col(key).alias("doc_id"), filled(text).alias("text"))
    return rows.mapInArrow(_scored(shared), f"doc_id {docs.schema[key].dataType.simpleString()}, score double")
