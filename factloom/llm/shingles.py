"""Hashed word shingles of whole texts, computed in numpy over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import pretokens as P

_random = np.random.Generator(np.random.PCG64(20240229))
#: Random 64-bit words: a value for each byte, odd multipliers for the places of bytes and words.
BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
BASE = int(_random.integers(0, 1 << 63)) * 2 + 1
PLACE = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
LENGTH = _random.integers(0, 1 << 64, 64, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space (blank, 9-13), A-Z in lower case -> (their hashes, words before each row and in all)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.empty(n, bool)
    begin[0], begin[1:] = inside[0], inside[1:] & (~inside[:-1] | edge[1:n])
    begin = np.flatnonzero(begin)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inside)
    word = np.searchsorted(at, begin)
    sizes = np.diff(np.append(word, len(at)))
    place = np.arange(len(at)) - np.repeat(word, sizes)
    powers = np.full(int(sizes.max()), BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    values = BYTE[low[at]] * powers[place]
    hashes = mix(np.add.reduceat(values, word) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(begin, offsets)


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row: (flat, sorted within rows; offsets). A text of fewer words is one shingle, none is none."""
    data, offsets = P.text_buffers(column)
    words, edges = word_hashes(data, offsets)
    n = np.diff(edges)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    first = np.arange(begin[-1]) - begin[row] + edges[row]
    total = np.zeros(len(first), np.uint64)
    width = np.minimum(n[row], size)
    for k in range(size):
        live = width > k
        total[live] += words[first[live] + k] * PLACE[k]
    total = mix(total + LENGTH[width])
    out, sizes = [], []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        mine = np.unique(total[a:b]) if b - a > 1 else total[a:b]
        out.append(mine)
        sizes.append(len(mine))
    flat = np.concatenate(out) if out else total
    return flat, np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
