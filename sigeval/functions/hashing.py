"""`stable_seed` of many numbered texts at once, for NumPy code inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

FEW = 512  # numbers below which single digests are faster
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)


def numbered_seeds(prefix: bytes, first: int, last: int) -> np.ndarray:
    """First 32 bits of the SHA-1 of `prefix` followed by each number first..last in decimal, as int64."""
    return np.concatenate([_seeds(prefix, lo, hi) for lo, hi in _same_digits(first, last)])


def _same_digits(first: int, last: int) -> Iterator[tuple[int, int]]:
    while first <= last:
        end = min(last, 10 ** len(str(first)) - 1)
        yield first, end
        first = end + 1


def _seeds(prefix: bytes, first: int, last: int) -> np.ndarray:
    if last - first < FEW:
        return np.array([int.from_bytes(hashlib.sha1(prefix + b"%d" % i).digest()[:4]) for i in range(first, last + 1)], dtype=np.int64)
    digits = len(str(first))
    length = len(prefix) + digits
    text = bytearray(prefix + bytes(digits) + b"\x80" + bytes(-(length + 9) % 64) + (length * 8).to_bytes(8))
    numbers = np.arange(first, last + 1)
    words = [np.array([int.from_bytes(text[i : i + 4])], dtype=np.uint32) for i in range(0, len(text), 4)]
    for place in range(digits):  # words that no digit touches stay single numbers, and so do the rounds before the first digit
        word, byte = divmod(len(prefix) + place, 4)
        digit = numbers // 10 ** (digits - 1 - place) % 10 + 48
        words[word] = words[word] | (digit << (24 - 8 * byte)).astype(np.uint32)
    state = [np.array([x], dtype=np.uint32) for x in START]
    for block in range(0, len(words), 16):
        state = _rounds(state, words[block : block + 16])
    return state[0].astype(np.int64)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _rounds(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """The 80 rounds of SHA-1 over one block of all texts."""
    a, b, c, d, e = state
    for i in range(80):
        if i > 15:
            words[i % 16] = _turned(words[(i - 3) % 16] ^ words[(i - 8) % 16] ^ words[(i - 14) % 16] ^ words[i % 16], 1)
        if i < 20:
            mixed = (d ^ (b & (c ^ d))) + np.uint32(0x5A827999)
        elif i < 40:
            mixed = (b ^ c ^ d) + np.uint32(0x6ED9EBA1)
        elif i < 60:
            mixed = ((b & c) | (d & (b | c))) + np.uint32(0x8F1BBCDC)
        else:
            mixed = (b ^ c ^ d) + np.uint32(0xCA62C1D6)
        a, b, c, d, e = _turned(a, 5) + mixed + e + words[i % 16], a, _turned(b, 30), c, d
    return [x + y for x, y in zip(state, (a, b, c, d, e), strict=True)]
