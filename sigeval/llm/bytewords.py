"""Words of UTF-8 texts as NumPy arrays, for the operators that run in Python tasks.

A table of 256 entries tells word bytes from others and lower-cases A-Z. That is exact in UTF-8, because every byte of a
character beyond ASCII is 0x80 or more, and those belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text that are worked on at a time; a longer text is a chunk of its own
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS_DIGITS = np.zeros(256, dtype=bool)
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # after lower-casing


@dataclass
class Chunk:
    """Consecutive texts of a batch: rows `first` to `first + len(starts)`, each followed by a space in `data`."""

    first: int
    data: bytes
    starts: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = memoryview(texts.buffers()[2] or b"")
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(texts))
        parts = [body[offsets[i] : offsets[i + 1]] for i in range(first, last)]
        lengths = np.diff(offsets[first : last + 1]) + 1
        yield Chunk(first, b" ".join([*parts, b""]), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        first = last


def word_bounds(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word of lower-cased bytes."""
    inside = table[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial in its bytes, then mixed. Works on a bounded part of the text at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        low, high = int(starts[at]), int(ends[upto - 1])
        power = np.full(high - low, MULTIPLIER, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        terms = power * (data[low:high].astype(np.uint64) + np.uint64(1))
        sums = np.add.reduceat(terms, np.stack([starts[at:upto] - low, ends[at:upto] - low], 1).ravel()[:-1])[::2]
        # dividing by the power at the word's start makes the hash independent of its place
        inverse = np.full(high - low, np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)), dtype=np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        out[at:upto] = mixed(sums * inverse[starts[at:upto] - low] + (ends[at:upto] - starts[at:upto]).astype(np.uint64))
        at = upto
    return out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; the length is part of it."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    total = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        total = total * MULTIPLIER + words[k : k + len(total)]
    return mixed(total)
