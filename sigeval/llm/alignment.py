"""Alignment of two tokenisations of a text by an associative monoid of fragments.

Where tokens of both end at the same byte, a text is cut into groups. A fragment is what a byte range of the text knows: the
tokens before its first cut (an open prefix), the closed groups, and those behind its last cut (an open suffix). Two neighbours
compose: suffix and prefix that meet are one group. That is associative, so a tree of tasks composes the fragments of a very long
text. A token belongs to the range in which it ends.

Texts of more than `RANGE` bytes are dealt out as pieces before they are tokenised. A piece ends between a character and a space or a
line feed: no token of either vocabulary spans such a place (the vocabularies are checked for that), nor do the rules that split texts
look back across it. A text without such a place is tokenised as a whole. For the same reason the stretches between two such places,
mostly a space and a word, have the same tokens wherever they stand, and a task tokenises each of them once.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .lookups import Tally, divided

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANGE = 1 << 16
FAN = 16
CHUNK = 1 << 20  # bytes of texts that are aligned at once
_PLACE = re.compile(r"(?<=\S)(?=[ \n])")
#: What lies between two such places: white space, then all up to the next one.
_UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")
HELD = 1 << 21  # characters of units whose tokens are remembered
GROUP = 64  # units that are tokenised as one text


# ---------------------------------------------------------------- vocabularies
def _byte_level() -> dict[str, int]:
    """Byte-level vocabularies write a byte that prints as itself, and the others in order from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """How to encode texts, and the bytes of every token."""

    encode: object
    tokens: list[bytes]
    lengths: np.ndarray


@functools.lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads that wait would take those of others
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    byte = _byte_level()
    with open(path, encoding="utf-8") as file:
        special = {x["id"] for x in json.load(file)["added_tokens"]}
    tokens = [b""] * own.get_vocab_size()
    for token, number in own.get_vocab().items():
        tokens[number] = token.encode() if number in special else bytes(byte[c] for c in token)
    encode = lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    return Vocabulary(encode, tokens, np.array([len(t) for t in tokens], dtype=np.int64))


@functools.lru_cache(maxsize=2)
def piece_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for number in range(own.get_piece_size()):
        piece = own.id_to_piece(number)
        if own.is_byte(number):
            tokens.append(bytes([int(piece[3:5], 16)]))
        elif own.is_control(number) or own.is_unknown(number):
            tokens.append(b"")
        else:
            tokens.append(piece.replace("▁", " ").encode())
            if re.search("[^▁]▁|.\n|\n.", piece, re.S):
                raise ValueError(f"piece {piece!r} spans a place where texts are cut")
    return Vocabulary(lambda texts: own.encode(texts, num_threads=1), tokens, np.array([len(t) for t in tokens], dtype=np.int64))


def pieces(text: str, size: int) -> list[str]:
    """`text` cut where tokens end, into pieces of about `size` characters or more."""
    out, first = [], 0
    while len(text) - first > size:
        place = _PLACE.search(text, first + size)
        if place is None:
            break
        out.append(text[first : place.start()])
        first = place.start()
    return [*out, text[first:]]


def piece_ids(texts: list[str], later: list[bool], vocabulary: Vocabulary) -> list[bytes | None]:
    """Ids of space+text, or of the text itself where it is a `later` piece of one; None where they do not give it back.

    The encoder adds a space. That is the one a later piece starts with, or else comes before a line feed, where it is a
    token of its own and taken away again. It adds none to an empty text, so a piece of one space is what comes before a line feed.
    """
    found, out = vocabulary.encode([(t[1:] or "\n") if x and t[0] == " " else t for t, x in zip(texts, later, strict=True)]), []
    for ids, text, x in zip(found, texts, later, strict=True):
        if x and text in (" ", "\n"):
            ids = ids[:1] if text == " " else ids[1:]
        elif x and text[0] == "\n":
            ids = ids[1:]
        whole = b"".join(map(vocabulary.tokens.__getitem__, ids)) == (text if x else f" {text}").encode()
        out.append(array("H", ids).tobytes() if whole else None)
    return out


# ---------------------------------------------------------------- alignment
@dataclass
class Aligned:
    """Links and groups of two token sequences over the same bytes."""

    link_a: np.ndarray  # number of the A token of each link
    link_b: np.ndarray
    cut: np.ndarray  # whether both tokens of the link end there
    group_a: np.ndarray  # group of each A token
    group_b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray


def align(la: np.ndarray, lb: np.ndarray) -> Aligned:
    """From the lengths of the tokens. Every stretch between two token ends is one link."""
    end_a, end_b = np.cumsum(la), np.cumsum(lb)
    size = max(int(end_a[-1]) if len(la) else 0, int(end_b[-1]) if len(lb) else 0)
    mark = np.zeros(size + 1, dtype=np.int8)
    mark[end_a] = 1
    mark[end_b] += 2
    kind = mark[np.flatnonzero(mark)]
    is_a, is_b = kind & 1, kind >> 1
    cut = kind == 3
    group = np.cumsum(cut) - cut
    return Aligned(np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, cut, group[is_a == 1], group[is_b == 1], end_a, end_b)


@dataclass
class Fragment:
    """Tokens of a byte range. Without a cut all of them are in the prefix."""

    ok: bool
    cut: bool
    prefix: tuple[np.ndarray, np.ndarray]
    body: tuple[np.ndarray, np.ndarray]
    suffix: tuple[np.ndarray, np.ndarray]
    groups: int
    links: int


def joined(left: tuple, right: tuple) -> tuple:
    return np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])


NONE = (np.empty(0, np.uint16), np.empty(0, np.uint16))


def composed(left: Fragment, right: Fragment, lengths: tuple) -> Fragment:
    """The fragment of two neighbouring ranges."""
    ok = left.ok and right.ok
    if not left.cut and not right.cut:
        return Fragment(ok, False, joined(left.prefix, right.prefix), NONE, NONE, 0, 0)
    if not left.cut:
        return Fragment(ok, True, joined(left.prefix, right.prefix), right.body, right.suffix, right.groups, right.links)
    if not right.cut:
        return Fragment(ok, True, left.prefix, left.body, joined(left.suffix, right.prefix), left.groups, left.links)
    middle, links = joined(left.suffix, right.prefix), 0
    if len(middle[0]) or len(middle[1]):
        links = len(align(lengths[0][middle[0]], lengths[1][middle[1]]).cut)
    groups = left.groups + right.groups + (links > 0)
    return Fragment(ok, True, left.prefix, joined(joined(left.body, middle), right.body), right.suffix, groups, left.links + right.links + links)


def closed(own: Fragment, lengths: tuple) -> Fragment:
    """A whole text's fragment with its first group in the body; its last byte is a cut."""
    start = Fragment(True, True, NONE, NONE, NONE, 0, 0)
    return composed(start, own, lengths)


def fragments(a: np.ndarray, b: np.ndarray, lengths: tuple, size: int) -> list[tuple[int, Fragment]]:
    """(first byte, fragment) of the byte ranges of `size` over one token sequence, that ends with a cut."""
    whole = align(lengths[0][a], lengths[1][b])
    total = int(whole.end_a[-1])
    ends = np.union1d(whole.end_a, whole.end_b)
    cuts = ends[whole.cut]
    out = []
    for low in range(0, total, size):
        high = min(low + size, total)
        own = cuts[(cuts > low) & (cuts <= high)]

        def part(first: int, last: int) -> tuple:  # tokens that end in (first, last]
            ia, ib = np.searchsorted(whole.end_a, [first, last], side="right"), np.searchsorted(whole.end_b, [first, last], side="right")
            return a[ia[0] : ia[1]], b[ib[0] : ib[1]]

        if not len(own):
            out.append((low, Fragment(True, False, part(low, high), NONE, NONE, 0, 0)))
            continue
        links = int(((ends > own[0]) & (ends <= own[-1])).sum())
        out.append((low, Fragment(True, True, part(low, own[0]), part(own[0], own[-1]), part(own[-1], high), len(own) - 1, links)))
    return out


def sizes(a: list[bytes], b: list[bytes], lengths: tuple) -> tuple[list[int], list[int]]:
    """Groups and links of several texts, from their ids."""
    owner = np.repeat(np.arange(len(b)), [len(x) // 2 for x in b])
    own = align(*(v[np.frombuffer(b"".join(x), np.uint16)] for v, x in zip(lengths, (a, b), strict=True)))
    if not len(owner):
        return [0] * len(a), [0] * len(a)
    text = owner[own.link_b]
    return np.bincount(text[own.cut], minlength=len(a)).tolist(), np.bincount(text, minlength=len(a)).tolist()


# ---------------------------------------------------------------- tasks
def _chunks(rows: list, size) -> list:
    part, total = [], 0
    for row in rows:
        if part and total + size(row) > CHUNK:
            yield part
            part, total = [], 0
        part.append(row)
        total += size(row)
    if part:
        yield part


class Units:
    """Ids of the units met so far, by both vocabularies; forgets them all before it holds more than HELD characters and a chunk.

    The first vocabulary has a token for every byte and no normalisation, so the number of bytes tells that it gives a unit back.
    """

    def __init__(self, paths: tuple[str, str]):
        self.bytes, self.pieces = byte_vocabulary(paths[0]), piece_vocabulary(paths[1])
        self.a, self.b, self.bad, self.held = {}, {}, set(), 0

    def learn(self, units: set[str]) -> None:
        if self.held > HELD:
            self.a, self.b, self.bad, self.held = {}, {}, set(), 0
        new = [u for u in units if u not in self.a]
        self.held += sum(map(len, new))
        # a text of several units has the tokens of each, unless white space at an end runs into the next
        alone, plain = [u for u in new if u[-1].isspace()], [u for u in new if not u[-1].isspace()]
        groups = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
        for group, text, a, b in zip(groups, *self._encode(["".join(g) for g in groups]), strict=True):
            if self._whole(text, a, b):
                ends = np.cumsum([len(u.encode()) for u in group])
                self.a.update(zip(group, _cut(a, ends, self.bytes.lengths), strict=True))
                self.b.update(zip(group, _cut(b, ends, self.pieces.lengths), strict=True))
            else:
                alone += group
        for unit, a, b in zip(*self._encode(alone), strict=True):
            self.a[unit], self.b[unit] = a, b
            if not self._whole(unit, a, b):
                self.bad.add(unit)

    def _encode(self, texts: list[str]) -> tuple[list[str], list[bytes], list[bytes | None]]:
        return texts, [array("H", ids).tobytes() for ids in self.bytes.encode(texts)], piece_ids(texts, [True] * len(texts), self.pieces)

    def _whole(self, text: str, a: bytes, b: bytes | None) -> bool:
        return b is not None and int(self.bytes.lengths[np.frombuffer(a, np.uint16)].sum()) == len(text.encode())


def _cut(ids: bytes, ends: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Ids of a text to those of its units, that end at these bytes."""
    own = np.cumsum(lengths[np.frombuffer(ids, np.uint16)])
    at = np.searchsorted(own, ends)
    if (own[at] != ends).any():
        raise ValueError("a token spans a place where texts are cut")
    places = [0, *(2 * (at + 1)).tolist()]
    return [ids[x:y] for x, y in zip(places, places[1:])]


@functools.lru_cache(maxsize=1)
def _units(paths: tuple[str, str]) -> Units:
    return Units(paths)


def _encoded(texts: list[str], later: list[bool], paths: tuple[str, str]) -> list[tuple[bytes, bytes, bool]]:
    """Ids by both vocabularies, and whether each text comes out of both unchanged."""
    own = _units(paths)
    split = [_UNIT.findall(t if x else f" {t}") for t, x in zip(texts, later, strict=True)]
    own.learn(set().union(*split))
    out = []
    for units in split:
        ok = own.bad.isdisjoint(units)
        out.append((b"".join(map(own.a.__getitem__, units)), b"".join(map(own.b.__getitem__, units)) if ok else b"", ok))
    return out


#: Of whole texts; a piece of a long one has its text instead.
TOKENS = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("piece", pa.string()), ("ok", pa.bool_()), ("groups", pa.int64()), ("links", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
PARTS = ("prefix_a", "prefix_b", "a", "b", "suffix_a", "suffix_b")
FRAGMENTS = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("ok", pa.bool_()), ("cut", pa.bool_()), *[(c, pa.binary()) for c in PARTS], ("groups", pa.int64()), ("links", pa.int64())])


def _tokenised(paths: tuple[str, str], size: int):
    """(doc_id, row, text) to the ids of each text, or to the pieces of a long one."""

    def run(batches):
        lengths = byte_vocabulary(paths[0]).lengths, piece_vocabulary(paths[1]).lengths
        for batch in batches:
            schema = TOKENS.append(batch.schema.field("doc_id"))
            rows = list(zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), (t or "" for t in batch["text"].to_pylist()), strict=True))
            for part in _chunks(rows, lambda r: len(r[2])):
                out = [{"doc_id": d, "row": row, "at": k, "piece": x} for d, row, text in part if len(text) > size for k, x in _placed(pieces(text, size))]
                short = [r for r in part if len(r[2]) <= size]
                found = _encoded([r[2] or "x" for r in short], [False] * len(short), paths)
                good = [ok and bool(r[2]) for r, (_, _, ok) in zip(short, found, strict=True)]
                a, b = ([x[k] if g else b"" for x, g in zip(found, good, strict=True)] for k in (0, 1))
                groups, links = sizes(a, b, lengths)
                columns = zip(short, good, a, b, groups, links, strict=True)
                out += [{"doc_id": d, "row": row, "at": 0, "ok": g, "a": x, "b": y, "groups": n, "links": m} for (d, row, _), g, x, y, n, m in columns]
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _placed(parts: list[str]):
    at = 0
    for part in parts:
        yield at, part
        at += len(part.encode()) + (at == 0)  # the space before the text is a byte of the first piece


def _row(row: int, at: int, own: Fragment) -> dict:
    flat = (*own.prefix, *own.body, *own.suffix)
    return {"row": row, "at": at, "ok": own.ok, "cut": own.cut, "groups": own.groups, "links": own.links} | {c: x.tobytes() for c, x in zip(PARTS, flat, strict=True)}


def _read(row) -> Fragment:
    flat = [np.frombuffer(row[c], dtype=np.uint16) for c in PARTS]
    return Fragment(bool(row["ok"]), bool(row["cut"]), tuple(flat[:2]), tuple(flat[2:4]), tuple(flat[4:]), int(row["groups"]), int(row["links"]))


def _fragmented(paths: tuple[str, str], size: int):
    def run(batches):
        lengths = byte_vocabulary(paths[0]).lengths, piece_vocabulary(paths[1]).lengths
        for batch in batches:
            for row, at, text in zip(*(batch[c].to_pylist() for c in ("row", "at", "piece")), strict=True):
                ((a, b, ok),) = _encoded([text], [at > 0], paths)
                found = fragments(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), lengths, size) if ok else [(0, Fragment(False, False, NONE, NONE, NONE, 0, 0))]
                yield pa.RecordBatch.from_pylist([_row(row, at + low, own) for low, own in found], FRAGMENTS)

    return run


def _reduced(paths: tuple[str, str]):
    def run(frame):
        lengths = byte_vocabulary(paths[0]).lengths, piece_vocabulary(paths[1]).lengths
        rows = frame.sort_values("at").to_dict("records")
        own = functools.reduce(lambda x, y: composed(x, y, lengths), map(_read, rows))
        return pd.DataFrame([_row(rows[0]["row"], rows[0]["at"], own)], columns=FRAGMENTS.names)

    return run


def _roots(paths: tuple[str, str]):
    def run(batches):
        lengths = byte_vocabulary(paths[0]).lengths, piece_vocabulary(paths[1]).lengths
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = closed(_read(row), lengths)
                good = own.ok
                out.append(
                    {"row": row["row"], "at": 0, "ok": good, "groups": own.groups if good else 0, "links": own.links if good else 0}
                    | {"a": own.body[0].tobytes() if good else b"", "b": own.body[1].tobytes() if good else b""}
                )
            yield pa.RecordBatch.from_pylist(out, TOKENS)

    return run


def _kind(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] = (BYTE_LEVEL, PIECES), size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(row, ok, groups, links, a, b) of every text, with the ids of both tokenisations as 16-bit numbers, and (row, doc_id).

    `ok` is false for a text that is NULL or empty, or that a vocabulary does not give back.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    first = stage(rows.mapInArrow(_tokenised(paths, size), f"{_kind(TOKENS)}, doc_id {docs.schema[key].dataType.simpleString()}"))
    parts = first.where("piece IS NOT NULL").select("row", "at", "piece").repartition("row", "at")
    level = stage(parts.mapInArrow(_fragmented(paths, size), _kind(FRAGMENTS)))
    most, span = level.agg(F.max("at")).first()[0], size
    while most is not None and span <= most:  # one range for all that a text has
        span *= FAN
        level = stage(level.groupBy("row", F.floor(F.col("at") / span)).applyInPandas(_reduced(paths), _kind(FRAGMENTS)))
    roots = stage(level.mapInArrow(_roots(paths), _kind(TOKENS)))
    own = ["row", "ok", "groups", "links", "a", "b"]
    return first.where("piece IS NULL").select(*own).unionByName(roots.select(*own)), first.where("at = 0").select("row", "doc_id")


def _whole(batches, lengths):
    """Chunks of texts: rows, ids, and where the tokens of each text begin."""
    for batch in batches:
        rows = list(zip(*(batch[c].to_pylist() for c in ("row", "groups", "links", "a", "b")), strict=True))
        for part in _chunks(rows, lambda r: 4 * len(r[3])):
            a, b = ([np.frombuffer(r[k], dtype=np.uint16) for r in part] for k in (3, 4))
            na, nb = (np.array([len(x) for x in own], dtype=np.int64) for own in (a, b))
            a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
            yield part, a, b, na, nb, align(lengths[0][a], lengths[1][b])


def _counted(paths: tuple[str, str]):
    def run(batches):
        lengths = byte_vocabulary(paths[0]).lengths, piece_vocabulary(paths[1]).lengths
        tally, schema = Tally(), pa.schema([("key", pa.int64()), ("n", pa.int64())])
        for _, a, b, _, _, own in _whole(batches, lengths):
            for key, n in tally.add((b[own.link_b] << 16) + a[own.link_a]):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], schema=schema)
        for key, n in tally.rest():
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], schema=schema)

    return run


@functools.lru_cache(maxsize=2)
def _written(na: int, nb: int) -> np.ndarray:
    """Decimal ids with what may follow them: A ids with , or |, then B ids with , or ;."""
    return np.array([f"{k}{end}".encode() for count, ends in ((na, ",|"), (nb, ",;")) for end in ends for k in range(count)], dtype=object)


def group_lists(a: np.ndarray, b: np.ndarray, own: Aligned, na: int, nb: int) -> np.ndarray:
    """`a1,a2|b1;...` as a list of byte strings, one for each token: the A tokens of a group, then its B tokens."""
    groups = int(own.cut.sum())
    per_a, per_b = np.bincount(own.group_a, minlength=groups), np.bincount(own.group_b, minlength=groups)
    text = np.empty(len(a) + len(b), dtype=np.int64)
    last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
    last_a[:-1], last_b[:-1] = own.group_a[1:] != own.group_a[:-1], own.group_b[1:] != own.group_b[:-1]
    text[np.arange(len(a)) + (np.cumsum(per_b) - per_b)[own.group_a]] = a + na * last_a
    text[np.arange(len(b)) + np.cumsum(per_a)[own.group_b]] = 2 * na + b + nb * last_b
    return _written(na, nb)[text]


RESULT = pa.schema([
    *[(c, pa.int64()) for c in ("row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
    ("groups_sha256", pa.string()), ("rest", pa.list_(pa.int64())),
])


def _scored(paths: tuple[str, str], counts, best):
    def run(batches):
        va, vb = byte_vocabulary(paths[0]), piece_vocabulary(paths[1])
        for part, a, b, na, nb, own in _whole(batches, (va.lengths, vb.lengths)):
            owner = np.repeat(np.arange(len(part)), nb)[own.link_b] if len(b) else np.empty(0, np.int64)
            key = (b[own.link_b] << 16) + a[own.link_a]
            n, known = counts.value.find(key)
            top = known & (n == best.value[b[own.link_b]])
            n_best = np.bincount(owner[top], minlength=len(part))
            total = np.zeros(len(part), np.int64)
            np.add.at(total, owner[known], n[known])
            rest, place = key[~known], np.searchsorted(owner[~known], np.arange(len(part) + 1))
            text = group_lists(a, b, own, len(va.tokens), len(vb.tokens))
            at = np.concatenate([[0], np.cumsum(na + nb)])
            out = []
            for k, (row, groups, links, _, _) in enumerate(part):
                line = b"".join(text[at[k] : at[k + 1]].tolist())[:-1]
                out.append({
                    "row": row, "n_a": int(na[k]), "n_b": int(nb[k]), "n_groups": groups, "n_links": links, "n_best": int(n_best[k]),
                    "count_sum": int(total[k]), "groups_sha256": hashlib.sha256(line).hexdigest() if line else "", "rest": rest[place[k] : place[k + 1]],
                })
            yield pa.RecordBatch.from_pylist(out, RESULT)

    return run


def alignment(
    docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] = (BYTE_LEVEL, PIECES), size: int = RANGE
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of tokens, one of each tokenisation, with overlapping bytes; its count is how many links of all texts have
    its ids; `n_best` are the links whose count is the highest of their B id. NULL and empty texts, and those that
    a vocabulary does not give back, have zeros and an empty string. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    found, rows = tokens(docs, key, text, paths, size)
    counts = stage(found.mapInArrow(_counted(paths), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    best = np.zeros(1 << 16, np.int64)
    tops = counts.groupBy(F.shiftright("key", 16).alias("b")).agg(F.max("n").alias("n"))
    top = tops.toPandas()  # one row per id of a vocabulary at most
    best[top["b"].to_numpy(dtype=np.int64)] = top["n"].to_numpy(dtype=np.int64)
    frequent, others = divided(counts)
    kind = "row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<long>"
    context = spark.sparkContext
    scored = stage(found.mapInArrow(_scored(paths, context.broadcast(frequent), context.broadcast(best)), kind))

    rest = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    others = others.withColumn("b", F.shiftright("key", 16)).join(tops.withColumnRenamed("n", "top"), "b")
    rest = rest.join(others.select("key", "n", (F.col("n") == F.col("top")).alias("is_top")), "key")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("is_top"), F.col("times"))).alias("more_best"))
    zero = F.lit(0).cast("long")
    out = rows.join(scored.drop("rest"), "row", "left").join(rest, "row", "left")
    return out.select(
        "doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
        (F.coalesce("n_best", zero) + F.coalesce("more_best", zero)).alias("n_best"),
        (F.coalesce("count_sum", zero) + F.coalesce("more_sum", zero)).alias("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
