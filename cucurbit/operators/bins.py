"""Rows of sparse log counts, as a batch of them: products with weights by sums of weight rows, and what the losses look up."""

from __future__ import annotations

import numpy as np

#: Values of weight rows gathered at a time.
CELLS = 1 << 22


class Bins:
    """``n`` rows of ``width`` bins: row, bin and value of each entry, by row and bin, each bin of a row once."""

    def __init__(self, row: np.ndarray, bin_: np.ndarray, value: np.ndarray, n: int, width: int):
        self.row, self.bin, self.value, self.shape = row, bin_, value, (n, width)

    @classmethod
    def of(cls, indices, counts, width: int, kind: np.dtype = np.float32) -> Bins:
        """From lists of indices and counts; the logs of a repeated index are added."""
        sizes = [len(i) for i in indices]
        bin_ = np.concatenate([np.asarray(i, np.int64) for i in indices]) if sizes else np.zeros(0, np.int64)
        return cls.of_flat(sizes, bin_, np.concatenate([np.asarray(c, kind) for c in counts]) if sizes else np.zeros(0, kind), width, kind)

    @classmethod
    def of_flat(cls, sizes, indices: np.ndarray, counts: np.ndarray, width: int, kind: np.dtype = np.float32) -> Bins:
        """The same from the entries of all rows, one after the other, and their number in each row."""
        row, bin_, value = np.repeat(np.arange(len(sizes)), sizes), indices.astype(np.int64), np.log1p(counts.astype(kind))
        key = row * width + bin_
        if (np.diff(key) <= 0).any():
            key, own = np.unique(key, return_inverse=True)
            value = np.bincount(own, value, len(key)).astype(kind)
            row, bin_ = key // width, key % width
        return cls(row, bin_, value, len(sizes), width)

    @classmethod
    def of_dense(cls, x: np.ndarray) -> Bins:
        row, bin_ = np.nonzero(x)
        return cls(row, bin_, x[row, bin_], *x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        """The rows times weights: of each row, the sum of its bins' weight rows times their values."""
        out = np.zeros((self.shape[0], w.shape[1]), w.dtype)
        step = max(1, CELLS // max(w.shape[1], 1))
        for at in range(0, len(self.row), step):
            part = slice(at, at + step)
            start = np.flatnonzero(np.diff(self.row[part], prepend=-1))
            # A row may go on in the next part.
            out[self.row[part][start]] += np.add.reduceat(w[self.bin[part]] * self.value[part, None], start, axis=0)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        """The gradient of those weights: of each bin, the sum of its rows' gradients times their values."""
        out = np.zeros((self.shape[1], g.shape[1]), g.dtype)
        order = np.argsort(self.bin, kind="stable")
        row, bin_, value = self.row[order], self.bin[order], self.value[order]
        step = max(1, CELLS // max(g.shape[1], 1))
        for at in range(0, len(row), step):
            part = slice(at, at + step)
            start = np.flatnonzero(np.diff(bin_[part], prepend=-1))
            out[bin_[part][start]] += np.add.reduceat(g[row[part]] * value[part, None], start, axis=0)
        return out

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of the entries' values by row."""
        return np.bincount(self.row, values, self.shape[0])
