"""XXH64 of many byte ranges at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: The five primes of XXH64 (fixed values of the public algorithm).
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
LONG = 4096


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def loads(buf: np.ndarray) -> np.ndarray:
    """For each byte the little-endian 64-bit value that begins there."""
    padded = np.concatenate((buf, np.zeros(16, np.uint8)))
    out = np.empty(len(buf) + 8, np.uint64)
    m = len(out) // 8
    for k in range(8):
        out[k : 8 * m : 8] = padded[k : k + 8 * m].view("<u8")
    return out[: len(buf)]


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start : start + length] for each range, as uint64."""
    if not len(start):
        return np.zeros(0, np.uint64)
    v, s = loads(buf), np.uint64(seed)
    h = np.full(len(start), s + P5)
    with np.errstate(over="ignore"):
        stripes = np.where(length > LONG, 0, length >> 5)
        if len(some := np.flatnonzero(stripes)):
            acc = [np.full(len(some), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes[some] > k)
                at = start[some[on]] + 32 * k
                for j in range(4):
                    acc[j][on] = _round(acc[j][on], v[at + 8 * j])
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros_like(a), a)) * P1 + P4
            h[some] = x
        h += length.astype(np.uint64)
        at, rest = start + 32 * stripes, length - 32 * stripes
        rest = np.where(length > LONG, 0, rest)
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), v[at[on] + 8 * k]), 27) * P1 + P4
        at, rest = at + (rest & ~7), rest & 7
        on = np.flatnonzero(rest & 4)
        h[on] = _rotl(h[on] ^ (v[at[on]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at, rest = at + (rest & 4), rest & 3
        for k in range(3):
            on = np.flatnonzero(rest > k)
            h[on] = _rotl(h[on] ^ (v[at[on] + k] & np.uint64(0xFF)) * P5, 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length > LONG):
        h[i] = xxhash.xxh64_intdigest(buf[start[i] : start[i] + length[i]].tobytes(), seed)
    return h
