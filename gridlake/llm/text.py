"""Vectorised word splitting and hashing over blocks of UTF-8 texts.

Everything here works on bytes with numpy, a block of documents at a time, so a
Python worker holds a bounded block and never loops over single words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Letters of which hashes are made at once.
HASHED = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at ASCII white space: everything but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of letters and digits: 0-9, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def parts(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """As blocks(), and the texts of each; only these are copied out of Arrow."""
    for lo, hi in blocks(_Sizes(pc.binary_length(column.cast(pa.binary())).fill_null(0).to_pylist()), most):
        yield lo, hi, utf8(column.slice(lo, hi - lo))


class _Sizes(list):
    """Lengths, as a list of things that have them."""

    def __iter__(self):
        return (range(n) for n in super().__iter__())


class Words:
    """The words of some texts, lower-cased (A-Z only).

    letters: the words' bytes without gaps; first: where each word begins in it;
    length: its bytes; begin: where it begins in its own text, in bytes; doc: the
    number of its text; count: words of each text; at: first word of each text.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        n = len(texts)
        buf = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        size = np.fromiter(map(len, texts), np.int64, n)
        base = np.cumsum(size + 1) - size - 1
        mask = kind[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        self.length = end - start
        self.letters = buf[mask]
        self.first = np.cumsum(self.length) - self.length
        self.doc = np.searchsorted(base, start, "right") - 1
        self.begin = start - base[self.doc] if len(start) else start
        self.count = np.bincount(self.doc, minlength=n)
        self.at = np.cumsum(self.count) - self.count

    def hashes(self, seed: int = 0, prefix: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of its first bytes (a shorter word whole)."""
        sums = np.zeros(len(self.length), np.uint64)
        power, lo = powers(int(self.length.max(initial=0)).bit_length()), 0
        while lo < len(sums):  # a letter takes some 40 bytes here, so a range of words at a time
            at = self.first[lo]
            hi = max(lo + 1, int(np.searchsorted(self.first, at + HASHED)))
            first, length = self.first[lo:hi] - at, self.length[lo:hi]
            letters = self.letters[at : at + int(length.sum())]
            within = np.arange(len(letters)) - np.repeat(first, length)
            x = (letters.astype(np.uint64) + np.uint64(1)) * power[within]
            if prefix:
                x *= within < prefix
            sums[lo:hi] = np.add.reduceat(x, first)
            lo = hi
        return mix(sums + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space after each, and where each begins."""
        out = np.full(len(self.letters) + len(self.length), 32, np.uint8)
        out[np.arange(len(self.letters)) + np.repeat(np.arange(len(self.length)), self.length)] = self.letters
        return out, self.first + np.arange(len(self.length))

    def word(self, i: int) -> bytes:
        return self.letters[self.first[i] : self.first[i] + self.length[i]].tobytes()


@lru_cache(4)
def powers(bits: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64, for words of up to 2**bits bytes."""
    x = np.full(1 << max(bits, 6), 0xD6E8FEB86659FD93, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
