"""Vectorised words, word hashes and shingles over batches of UTF-8 texts.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, so UTF-8 sequences are never split.
Hashes are 64-bit: each byte takes a random 64-bit code times a power of an odd base; prefix sums
give every word's sum, which is shifted to a common origin and mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_codes = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_folded = _codes.copy()
_folded[0x41:0x5B] = _codes[0x61:0x7B]

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        factors = np.full(size, _BASE if which == "up" else _BASE_INV, dtype=np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size <= 4 * SLICE_BYTES:  # tables for longer texts are not kept
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES, most: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes and at most ``most`` texts; a longer text is alone."""
    start = total = n = 0
    for size in sizes:
        if n > start and (total + size > limit or n - start >= most):
            yield start, n
            start, total = n, 0
        total += size
        n += 1
    if n > start:
        yield start, n


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class Words:
    """Words of a few texts: ``start``/``end`` byte offsets in ``buf``, ``first[d]:first[d+1]`` those of text d.

    ``white`` marks the bytes between words; the line feed, which joins the texts, is one of them.
    """

    def __init__(self, texts: list[bytes], fold: bool = True, white: np.ndarray = WHITE):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.base = np.concatenate(([0], np.cumsum(sizes + 1)))
        solid = np.concatenate(([False], ~white[self.buf]))
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.base)
        codes = _folded if fold else _codes
        n = len(self.buf)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes[self.buf] * _power("up", n), out=self.sums[1:])
        self.hash = self.hash_of(self.start, self.end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, the same wherever the bytes stand."""
        raw = (self.sums[end] - self.sums[start]) * _power("down", len(self.buf))[start]
        return mix(raw ^ (end - start).astype(np.uint64))

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        """At each word the hash of the k words from it; the last k-1 of a text run into the next one."""
        h, n = self.hash, len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        factor = 1
        for j in range(min(k, n)):
            factor = factor * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 | 1
            factor &= (1 << 64) - 1
            out[: n - j] += h[j:] * _U(factor)
        return mix(out)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted hashes, and each text's bounds in them.

    A text of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    first, counts = words.first, words.counts()
    grams = words.grams(k)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out = grams[first[:-1][doc] + (np.arange(bounds[-1]) - bounds[:-1][doc])]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        h = words.hash[first[d] : first[d + 1]]
        seq = np.zeros(1, dtype=np.uint64) + _U(len(h))
        for x in h:
            seq = mix(seq * _U(0x9E3779B97F4A7C15) + x)
        out[bounds[d]] = seq[0]
    for d in np.flatnonzero(sizes > 1):
        out[bounds[d] : bounds[d + 1]].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept[bounds]
