"""Language-model scores against a plain program that goes decision by decision."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigeval.llm import bytewords as B
from sigeval.llm import context_mixing as M
from sigeval.llm import lookups

TEXTS = [None, "", " ", "a", "The cat sat on the mat. " * 40, "été à l'école  \n ça va\x00bien", "the CAT sat on a hat", "zzz qqq", "longwordlongword longwordlongwore " * 60]
ROWS = list(enumerate([*TEXTS, *TEXTS, *[f"The dog {k} ran to the mat." for k in range(60)]])) + [(None, "no key")]


def trains(key):
    return key is None or zlib.crc32(str(key).encode()) % 7 != 2


def symbols(text):
    return [*(text or "").encode(), M.END]


def steps(text, codes):
    """(slots, bit, place of the symbol) of every decision."""
    body, out, space = (text or "").encode(), [], b" \t\n\x0b\x0c\r"
    for at, symbol in enumerate(symbols(text)):
        begin = max([k + 1 for k in range(at) if body[k] in space], default=0)
        own = []
        for number, size in enumerate([*M.ORDERS, min(at - begin, 8)]):
            size = min(size, at)
            value = int.from_bytes(body[at - size : at].rjust(size, b"\0"), "little") << (64 - 8 * size) if size else 0
            own.append((((value + number) * int(B.MULTIPLIER)) % (1 << 64)) >> 32)
        for k in range(codes.start[symbol], codes.start[symbol] + codes.length[symbol]):
            slots = [((h + int(codes.nodes[k])) % (1 << 32)) >> (32 - size) for h, size in zip(own, M.SLOTS)]
            out.append((slots, int(codes.bits[k]), at))
    return out


def plain_scores(rows):
    counts = np.zeros(257, np.int64)
    for key, text in rows:
        if trains(key):
            np.add.at(counts, symbols(text), 1)
    codes = M.huffman(counts)
    slots = [Counter() for _ in M.SLOTS]
    for key, text in rows:
        if trains(key):
            for own, bit, _ in steps(text, codes):
                for k, slot in enumerate(own):
                    slots[k][slot, bit] += 1

    def odds(k, slot):
        n0, n1 = slots[k][slot, 0], slots[k][slot, 1]
        if not n0 + n1:
            return 0.0
        return (round(min(max(math.log((n1 + M.PRIOR) / (n0 + M.PRIOR)), -M.LIMIT), M.LIMIT) * M.SCALE) or 1) / M.SCALE

    out = []
    for _, text in rows:
        weights, offsets, log, held, block = [list(M.WEIGHTS) for _ in range(M.GATES)], [0.0] * M.RANGES, 0.0, [], 0
        for own, bit, at in [*steps(text, codes), (None, 0, 1 << 30)]:
            if M.block_of(np.array([at]))[0] != block:
                block = M.block_of(np.array([at]))[0]
                gates, places = Counter(g for g, *_ in held), Counter(p for _, p, *_ in held)
                for gate, place, error, late, x in held:
                    for k in range(len(x)):
                        weights[gate][k] += M.RATE / math.sqrt(1 + gates[gate] / 64) * error * x[k]
                    offsets[place] += M.OFFSET_RATE / math.sqrt(1 + places[place] / 64) * late
                held = []
            if own is None:
                break
            x = [odds(k, slot) for k, slot in enumerate(own)]
            gate = sum(v != 0 for v in x[1:])
            total = sum(w * v for w, v in zip(weights[gate], x))
            place = int(max(min(total * M.STEP + M.RANGES / 2, M.RANGES - 1), 0))
            p, q = (1 / (1 + math.exp(-v)) for v in (total, total + offsets[place]))
            log += math.log10(q if bit else 1 - q)
            held.append((gate, place, bit - p, bit - q, x))
        out.append(log)
    return out


@pytest.mark.parametrize("most", [1 << 18, 3])
def test_scores_match_a_plain_program(spark, monkeypatch, most):
    monkeypatch.setattr(M, "divided", lambda counts: lookups.divided(counts, most))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("row", "score", "key", "n", "block", "rest", "known")])
    model = M.fit(docs.where(~M.held_out(F.col("doc_id"))))
    got = M.score(docs, model).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    counts = Counter(w for key, t in ROWS if trains(key) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.distinct) == (n, v)
    want = {}
    for (key, text), score in zip(ROWS, plain_scores(ROWS), strict=True):
        own = tokens(text)
        want[key] = (len(own), sum(counts[w] > 0 for w in own), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), score)
    assert len(got) == len(ROWS)
    for r in got:
        own = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == own[:2]
        assert r.base_score == pytest.approx(own[2], abs=1e-8)
        assert r.score == pytest.approx(own[3], rel=2e-3, abs=2e-3)
    assert M.score(docs.limit(0), model).count() == 0
    nothing = M.fit(docs.limit(0))
    assert {r.n_known for r in M.score(docs, nothing).collect()} == {0}


def test_texts_do_not_influence_each_other(spark):
    rng = np.random.default_rng(0)
    codes = M.huffman(np.ones(257, np.int64))
    odds = (rng.normal(size=M.OFFSETS[-1]) * (rng.random(M.OFFSETS[-1]) < 0.7)).astype(np.float32)
    texts = ["".join(rng.choice(list("abc de\n"), int(n))) for n in rng.integers(0, 4000, 40)] + ["x" * 200_000]
    (chunk,) = B.chunks(pa.array(texts), 1 << 22)
    together = M.log_probabilities(chunk, codes, odds)
    for k in (0, 3, 17, 40):
        (own,) = B.chunks(pa.array(texts[k : k + 1]))
        assert M.log_probabilities(own, codes, odds)[0] == pytest.approx(together[k], rel=1e-6)


def test_probabilities_of_all_next_symbols_add_up_to_one():
    rng = np.random.default_rng(1)
    codes = M.huffman(rng.integers(0, 1000, 257))
    odds = rng.normal(size=M.OFFSETS[-1]).astype(np.float32)
    texts = ["", *[bytes([k]).decode("latin1") for k in range(128)]]
    whole = M.log_probabilities(next(B.chunks(pa.array(texts))), codes, odds)
    # of the texts of one ASCII character the first symbol's odds are those with an end taken away
    assert 0 < (10.0**whole).sum() < 1
    assert (2.0 ** -codes.length).sum() == pytest.approx(1.0)


def test_frequent_bytes_have_trees_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(M, "TREE", 40)
    counts = np.zeros((257, 257), np.int64)
    for key, text in ROWS:
        if trains(key):
            own = symbols(text)
            np.add.at(counts, ([M.END, *own[:-1]], own), 1)
    codes = M.forest(counts)
    frequent = np.flatnonzero(counts.sum(axis=1) >= 40)
    assert len(frequent) > 5 and codes.trees[frequent].tolist() == list(range(1, len(frequent) + 1))
    assert codes.trees.sum() == sum(range(1, len(frequent) + 1))
    length = codes.length.reshape(-1, 257)
    assert length.tolist() == [M.huffman(c).length.tolist() for c in [counts.sum(axis=0), *counts[frequent]]]
    assert (counts * length[codes.trees]).sum() < 0.8 * (counts * length[0]).sum()

    plain, each = steps, [M.Codes(codes.start[k : k + 257], codes.length[k : k + 257], codes.nodes, codes.bits, codes.trees) for k in range(0, len(codes.start), 257)]

    def of_trees(text, _):
        after = [M.END, *(text or "").encode()]
        return sorted((s for tree, own in enumerate(each) for s in plain(text, own) if codes.trees[after[s[2]]] == tree), key=lambda s: s[2])

    monkeypatch.setitem(globals(), "steps", of_trees)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    model = M.fit(docs.where(~M.held_out(F.col("doc_id"))))
    assert model.codes.trees.tolist() == codes.trees.tolist()
    want = {key: score for (key, _), score in zip(ROWS, plain_scores(ROWS), strict=True)}
    for r in M.score(docs, model).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=2e-3, abs=2e-3)
