"""Hashes of substrings and words with numpy, for many texts at a time.

A prefix sum of byte values times powers of an odd base, modulo 2**64, gives the hash of any
substring from two entries: the difference, divided by the power at its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240229)
VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least."""
    if len(_powers[0]) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        for k, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Hasher:
    """Hashes of the substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(VALUE[data] * p[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, span, m = len(x) - width + 1, 1, x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[width - span : width - span + n])


def slices(texts: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of some ``most`` bytes, or one longer text: number of the first, bytes, and ends by text."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts.cast(pa.large_binary())).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        data = "".join(texts[at:to].to_pylist()).encode("utf-8")
        yield at, np.frombuffer(data, np.uint8), ends[at:to] - done
        at = to


class Words:
    """Words of some texts: hash, start and end in bytes; ``first`` has the number of each text's first word, and one more entry."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lower: bool = True):
        data = LOWER[data] if lower else data
        gap = SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        edge[ends] = True
        before = np.concatenate([[True], gap])[:-1] if len(data) else gap
        after = np.concatenate([gap, [True]])[1:] if len(data) else gap
        self.start = np.flatnonzero(~gap & (before | edge[:-1]))
        self.end = np.flatnonzero(~gap & (after | edge[1:])) + 1
        self.hash = Hasher(data)(self.start, self.end)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def shingles(self, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each text's runs of ``n`` words, or of all its words if they are fewer; and the number of each text's first run."""
        p = [pow(0xC2B2AE3D27D4EB4F, n - 1 - i, 2**64) for i in range(n)]
        count = np.diff(self.first)
        runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(runs)])
        at = np.repeat(self.first[:-1] - first[:-1], runs) + np.arange(first[-1])
        last = np.repeat(self.first[1:], runs)
        total = np.zeros(len(at), U)
        for i in range(n):
            own = at + i
            inside = own < last
            total += np.where(inside, self.hash[np.minimum(own, max(len(self.hash) - 1, 0))] | U(1), U(0)) * U(p[i]) if len(at) else total
        return mix(total), first
