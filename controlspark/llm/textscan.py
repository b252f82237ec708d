"""Words, word hashes and shingles of many texts at once, on byte arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
#: An odd base of the polynomial hash.
BASE = 0xD6E8FEB86659FD93
SEGMENT = 1 << 19


def golden(i: int) -> np.uint64:
    return U64(i * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words as runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words as runs of lower-case letters, digits and all bytes beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * GOLDEN)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; those of a segment are kept."""
    if _powers and n <= len(_powers[0]):
        return _powers[0], _powers[1]
    size, out = max(n, SEGMENT + 4096), []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, base, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size == SEGMENT + 4096:
        _powers[:] = out
    return out[0], out[1]


class Words(NamedTuple):
    data: np.ndarray  #: the bytes, lower-cased, with a line end after each text
    starts: np.ndarray  #: of each word, in data
    ends: np.ndarray
    bounds: np.ndarray  #: text i has the words bounds[i]:bounds[i + 1]
    hashes: np.ndarray


def words(texts: list[bytes], member: np.ndarray = NOT_SPACE, lower: np.ndarray = LOWER) -> Words:
    """The words of each text, A-Z lower-cased."""
    data = lower[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    inside = member[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    bounds = np.concatenate(([0], np.searchsorted(starts, text_ends)))
    return Words(data, starts, ends, bounds, hash_spans(data, starts, ends))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, in segments that stay in the processor's cache."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + SEGMENT, side="right")))
        part = data[low : ends[j - 1]]
        power, inverse = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(BYTE_CODE[part] * power[: len(part)], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix64((total[b] - total[a]) * inverse[a] + (b - a).astype(U64) * GOLDEN)
        i = j
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles of one text; a shorter text is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(k, n)
    total = np.full(n - size + 1, golden(size), dtype=U64)
    for i in range(size):
        total = mix64(total + hashes[i : n - size + 1 + i])
    return np.unique(total)
