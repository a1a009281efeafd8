"""Cross-tokenizer alignment against whole texts and all pairs of overlapping tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigeval.llm import alignment, lookups

PATHS = (alignment.BYTE_LEVEL, alignment.PIECES)
TEXTS = [
    None, "", " ", "Hello, world! It's fine.", "Hello, world! It's fine.", "été ça\nva\n\n\nbien \n x  y\t z\r\n", "<|endoftext|> </s> <0x41>", "a▁b", "\n\nstart",
    "\U0001f600‍\U0001f600 日本語 ünï", "x" * 700, " " * 500, "=" * 300 + " end", " ".join(f"word{k % 7}  tail\n{k}" for k in range(150)), "no break\x1c \x85 space",
]


def plain(texts):
    va, vb = alignment.byte_vocabulary(PATHS[0]), alignment.piece_vocabulary(PATHS[1])
    counts, docs = Counter(), []
    for text in texts:
        doc = None
        if text:
            a, b = va.encode([f" {text}"])[0], vb.encode([text])[0]
            if all(b"".join(v.tokens[i] for i in ids) == f" {text}".encode() for v, ids in ((va, a), (vb, b))):
                spans = []
                for v, ids in ((va, a), (vb, b)):
                    at, own = 0, []
                    for i in ids:
                        own.append((at, at + len(v.tokens[i]), i))
                        at += len(v.tokens[i])
                    spans.append(own)
                links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
                counts.update(links)
                doc = (spans, links)
        docs.append(doc)
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        (a, b), links = doc
        cuts, groups, low = sorted({x[1] for x in a} & {y[1] for y in b}), [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t[2]) for t in own if low < t[1] <= cut) for own in (a, b)))
            low = cut
        best = sum(counts[x] == top[x[1]] for x in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("size", "most"), [(1 << 16, 1 << 18), (40, 5), (7, 0)])
def test_alignment_matches_all_pairs(spark, monkeypatch, size, most):
    monkeypatch.setattr(lookups, "MOST", most)
    monkeypatch.setattr(alignment, "divided", lambda counts: lookups.divided(counts, most))
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    table = table.select("*", *[F.lit("x").alias(c) for c in ("row", "at", "a", "b", "key", "n", "rest", "piece")])
    got = {r.doc_id: tuple(r)[1:] for r in alignment.alignment(table, size=size).collect()}
    want = dict(enumerate(plain(TEXTS)))
    assert got == want
    assert sum(w[0] == 0 for w in want.values()) == 3  # NULL, empty, and the character that stands for a space
    assert alignment.alignment(table.limit(0)).count() == 0


def test_composition_is_associative():
    va, vb = alignment.byte_vocabulary(PATHS[0]), alignment.piece_vocabulary(PATHS[1])
    lengths = va.lengths, vb.lengths
    text = TEXTS[9] + TEXTS[5] + "unbelievable antidisestablishmentarianism"
    a, b = (np.array(x, np.uint16) for x in (va.encode([f" {text}"])[0], vb.encode([text])[0]))
    (_, whole), = alignment.fragments(a, b, lengths, 1 << 20)
    parts = [x for _, x in alignment.fragments(a, b, lengths, 5)]
    assert len(parts) > 9 and not all(x.cut for x in parts)
    rng = np.random.default_rng(0)
    for _ in range(20):
        own = list(parts)
        while len(own) > 1:
            k = int(rng.integers(len(own) - 1))
            own[k : k + 2] = [alignment.composed(own[k], own[k + 1], lengths)]
        x, y = alignment.closed(own[0], lengths), alignment.closed(whole, lengths)
        assert (x.groups, x.links) == (y.groups, y.links)
        assert all((p == q).all() for p, q in zip(x.body, y.body))
        assert not len(x.prefix[0]) and not len(x.suffix[1])


def test_pieces_are_tokenised_like_the_whole(spark):
    both = alignment.byte_vocabulary(PATHS[0]), alignment.piece_vocabulary(PATHS[1])
    texts = [t for t in TEXTS if t] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text <> ''").collect()]
    for text in texts:
        parts = alignment.pieces(text, 10)
        assert "".join(parts) == text
        later = [k > 0 for k in range(len(parts))]
        whole = both[0].encode([f" {text}"])[0], both[1].encode([text])[0]
        assert sum(both[0].encode([p if x else f" {p}" for p, x in zip(parts, later)]), []) == whole[0]
        pieces = alignment.piece_ids(parts, later, both[1])
        (joined,) = alignment.piece_ids([text], [False], both[1])
        assert (None if None in pieces else b"".join(pieces)) == joined and (joined is None) == ("▁" in text)
        ((a, b, ok),) = alignment._encoded([text], [False], PATHS)
        assert a == np.array(whole[0], np.uint16).tobytes() and ok == (joined is not None) and b == (joined or b"")


def test_units_are_tokenised_like_the_whole(monkeypatch):
    """Texts of few kinds of characters, white space of all sorts among them, with a memory that forgets at once and one that does not."""
    va, vb = alignment.byte_vocabulary(PATHS[0]), alignment.piece_vocabulary(PATHS[1])
    rng = np.random.default_rng(5)
    kinds = ["a", "b", "The", "'s", "9", ".", "é", "日", "\u2581", " ", " ", "\n", "\t", "\r", "\xa0", "\x85", "\x1c", "\u3000", "<s>", "<|endoftext|>"]
    texts = ["".join(rng.choice(kinds, size=int(n))) for n in rng.integers(1, 12, size=3000)] + ["a ", "a \n", " a\t ", "a \n ", "\n", " "]
    for held in (0, 1 << 21):
        monkeypatch.setattr(alignment, "HELD", held)
        for first in range(0, len(texts), 500):
            part = texts[first : first + 500]
            wholes = zip(va.encode([f" {t}" for t in part]), alignment.piece_ids(part, [False] * len(part), vb))
            for text, got, (a, b) in zip(part, alignment._encoded(part, [False] * len(part), PATHS), wholes):
                units = alignment._UNIT.findall(f" {text}")
                assert units == alignment._PLACE.split(f" {text}") and "".join(units) == f" {text}"
                assert got == (np.array(a, np.uint16).tobytes(), b or b"", b is not None), text


def test_long_runs_are_tokenised(spark):
    rows = spark.createDataFrame([(1, " " * 1_000_000), (2, "=" * 1_000_000), (3, "word " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.alignment(rows).collect()}
    assert all(got[k].n_groups > 0 and got[k].n_links >= max(got[k].n_a, got[k].n_b) for k in (1, 2, 3))
