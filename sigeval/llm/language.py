"""Language identification as multilingual mixture inference.

Each language is a distribution over hashed byte n-grams of lower-cased words, counted over all training documents. A
text is cut into segments of a few words. Expectation-maximisation estimates in which proportions the
languages mix in it from the segments' likelihoods. Starting from all languages, the one with the smallest proportion is
left out again and again, and the set with the best penalised likelihood is selected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .common import filled

ORDER = 3  # bytes of an n-gram; words have a blank on both sides
BITS = 16  # n-grams are hashed into 2^BITS classes, so a model has a fixed size per language
SMOOTH = 0.5
SEGMENT = 8  # words
STEPS = 6  # of expectation-maximisation for each set of languages
PENALTY = 2.0  # log-likelihood that one more language must gain, times the logarithm of the number of segments plus one
UNKNOWN = "und"
NOT_BLANK = np.arange(256) != 32


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def _grams(data: np.ndarray) -> np.ndarray:
    """Class of the n-gram that starts at each byte."""
    total = np.zeros(len(data) - ORDER + 1, dtype=np.uint32)
    for k in range(ORDER):
        total = total * np.uint32(0x01000193) + data[k : k + len(total)]
    total = (total ^ (total >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return total >> np.uint32(32 - BITS)


def _spelled(chunk: B.Chunk) -> np.ndarray:
    """Lower-cased bytes in which everything between words, digits included, is a blank."""
    data = B.LOWER[np.frombuffer(chunk.data, dtype=np.uint8)]
    letters = B.LETTERS_DIGITS[data]
    letters[(data >= 48) & (data < 58)] = False
    return np.where(letters, data, np.uint8(32))


def _inside(data: np.ndarray) -> np.ndarray:
    """n-gram places whose second byte is a letter: each letter is the middle of one n-gram of its word."""
    return data[1 : len(data) - ORDER + 2] != 32


# ---------------------------------------------------------------- counts
def _counted(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for chunk in B.chunks(batch["text"]):
            data = np.concatenate([[np.uint8(32)], _spelled(chunk)])
            if len(data) < ORDER:
                continue
            at = np.flatnonzero(_inside(data))
            gram, doc = _grams(data)[at], np.searchsorted(chunk.starts, at, side="right") - 1
            own = np.array(langs[chunk.first : chunk.first + len(chunk.starts)], dtype=object)
            for lang in set(own):
                counts = totals.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                counts += np.bincount(gram[(own == lang)[doc]], minlength=1 << BITS)
    for lang, counts in totals.items():
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["lang", "gram", "n"])


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows with a language; a task sends one row per language and class it has seen."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), filled(text).alias("text"))
    return rows.mapInArrow(_counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the logarithm of each class's probability, shape (classes, languages).

    At most 2^BITS rows per language come to the driver. Languages without a letter in any text are left out.
    """
    rows = gram_counts(docs, lang, text).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.full((1 << BITS, len(langs)), SMOOTH)
    for k, name in enumerate(langs):
        own = rows[rows["lang"] == name]
        counts[own["gram"].to_numpy(), k] += own["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


# ---------------------------------------------------------------- inference
def segments(data: np.ndarray, texts: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each segment of words under each language, and the segment's text."""
    starts, _ = B.word_bounds(data, NOT_BLANK)
    if not len(starts):
        return np.empty((0, logs.shape[1]), np.float32), np.empty(0, np.int64)
    doc = np.searchsorted(texts, starts, side="right") - 1
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    place = np.arange(len(starts)) - np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0))
    heads = np.flatnonzero(place % SEGMENT == 0)
    at = np.flatnonzero(_inside(data))
    # the n-gram around the first letter of a word starts one byte before the word
    first = np.searchsorted(at, starts[heads] - 1)
    return np.add.reduceat(logs[_grams(data)[at]], first, axis=0), doc[heads]


def infer(loglik: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Proportions of the languages in each text, shape (n_docs, languages); `doc` is sorted. Texts without
    segments have none."""
    n, k = n_docs, loglik.shape[1]
    best = np.zeros((n, k))
    if not len(doc) or not k:
        return best
    present, first, sizes = np.unique(doc, return_index=True, return_counts=True)
    owner = np.repeat(np.arange(len(present)), sizes)
    top = loglik.max(axis=1, keepdims=True)
    lik = np.exp(np.maximum(loglik - top, -60.0)).astype(np.float32)
    base = np.add.reduceat(top[:, 0].astype(np.float64), first)

    share = np.full((len(present), k), 1.0 / k, dtype=np.float32)
    chosen, score = np.zeros_like(share), np.full(len(present), -np.inf)
    todo = np.arange(len(present))  # texts whose smaller sets may still win
    for left in range(k, 0, -1):
        rows = np.flatnonzero(np.isin(owner, todo)) if len(todo) < len(present) else np.arange(len(owner))
        at = np.concatenate([[0], np.cumsum(sizes[todo])[:-1]])
        local = np.repeat(np.arange(len(todo)), sizes[todo])
        own, p = lik[rows], share[todo]
        for _ in range(STEPS if left > 1 else 1):
            joint = own * p[local]
            total = joint.sum(axis=1, keepdims=True)
            p = np.add.reduceat(joint / np.maximum(total, 1e-30), at, axis=0) / sizes[todo][:, None].astype(np.float32)
        fit_ = np.add.reduceat(np.log(np.maximum((own * p[local]).sum(axis=1), 1e-30)).astype(np.float64), at) + base[todo]
        value = fit_ - PENALTY * (left - 1) * np.log(sizes[todo] + 1.0)
        better = value >= score[todo]
        chosen[todo[better]], score[todo[better]] = p[better], value[better]
        # leave out the language with the smallest proportion among those still in
        still = share[todo] > 0
        drop = np.where(still, p, np.inf).argmin(axis=1)
        p = np.where(still, np.maximum(p, 1e-6), 0)
        p[np.arange(len(todo)), drop] = 0
        share[todo] = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-30)
    best[present] = chosen
    return best


def _predicted(langs: list[str], logs):
    def run(batches):
        table = logs.value
        names = np.array([*langs, UNKNOWN], dtype=object)
        for batch in batches:
            lang, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            for chunk in B.chunks(batch["text"], B.CHUNK * 8 // max(8, len(langs))):
                data = np.concatenate([[np.uint8(32)], _spelled(chunk)])
                if len(data) < ORDER or not langs:
                    continue
                share = infer(*segments(data, chunk.starts + 1, table), len(chunk.starts))
                rows = slice(chunk.first, chunk.first + len(share))
                lang[rows] = np.where(share.max(axis=1) > 0, share.argmax(axis=1), len(langs))
                score[rows] = np.minimum(share.max(axis=1), 1.0)
            known = batch["letters"].to_numpy(zero_copy_only=False)
            lang, score = np.where(known, lang, len(langs)), np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch["keep"], pa.array(names[lang], pa.string()), pa.array(score)], ["keep", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every input row, lang_pred and score (the proportion of that language in the text).

    A text that is NULL, empty or without a letter is `und` with score 0, as is every text if the model has no language.
    Of equal proportions the first language in code-point order wins. Long texts are read whole. Repeated rows get the same
    result; an empty table gives an empty result.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # 2^BITS floats per language
    rows = docs.select(
        F.struct(*keep).alias("keep"), filled(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    )
    kept = docs.select(F.struct(*keep).alias("keep")).schema["keep"].dataType.simpleString()
    out = rows.mapInArrow(_predicted(langs, shared), f"keep {kept}, lang_pred string, score double")
    return out.select("keep.*", "lang_pred", "score")


def train_rows(docs: DataFrame, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Rows that may be learned from: a language, and a key whose checksum is not held out (NULL keys are)."""
    return docs.where(~F.coalesce(held_out(F.col(key)), F.lit(True)) & F.col(lang).isNotNull())


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.4) -> DataFrame:
    """The input rows whose text has a main language: one that holds at least `least` of it."""
    model = fit(train_rows(docs, key, lang), lang, text)
    wrapped = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    judged = predict(wrapped, model, "text", ("row",))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
