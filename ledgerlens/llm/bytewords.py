"""Words of Arrow text batches as numpy arrays over the UTF-8 bytes.

Texts are never turned into Python strings: the batch's byte buffer is cut into blocks of
whole documents of about ``BLOCK`` bytes, and words and their 64-bit hashes come from array
operations on a block. A longer document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z; bytes of other characters are 0x80 and above.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
# [^\x20\x09-\x0D]
SPACED = np.ones(256, dtype=bool)
SPACED[0x20] = SPACED[0x09:0x0E] = False


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data, offsets


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``size`` bytes together, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the table grows to the longest block seen."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base & ((1 << 64) - 1), dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Rolling:
    """Hashes of any byte ranges of one block."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        self.base_inv = pow(base, -1, 1 << 64)
        self.sums = np.empty(len(data) + 1, dtype=U64)
        self.sums[0] = 0
        x = data.astype(U64)
        x += U64(1)
        x *= powers(base, len(data))
        np.cumsum(x, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= powers(self.base_inv, len(self.sums))[start]
        h += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(h)


@dataclass
class Words:
    """Words of a block: ``first[d]`` to ``first[d + 1]`` are those of document d."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Words of the documents at ``offsets`` (relative to ``data``): maximal runs of ``letters``."""
    inside = letters[data]
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[offsets] = True  # a word never crosses documents
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edges[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edges[1:])) + 1
    hashes = Rolling(fold[data]).ranges(start, end) if len(start) else np.zeros(0, U64)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


def word_hash(word: str) -> int:
    """The hash ``words`` gives to one word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(Rolling(LOWER[data]).ranges(np.array([0]), np.array([len(data)]))[0])


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document, and the index of each one's first word."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, dtype=U64)
    for j in range(k):
        h *= U64(0x9DDFEA08EB382D69)
        h += w.hash[j : n - k + 1 + j]
    h = mix(h + U64(k))
    doc_end = np.repeat(w.first[1:], np.diff(w.first))
    at = np.flatnonzero(np.arange(n - k + 1) + k <= doc_end[: n - k + 1])
    return h[at], at
