"""Sparse counted vectors (indices array<int>, counts array<int>): views, checks and similarities as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 4096


def valid(indices: Column, counts: Column, width: int = WIDTH) -> Column:
    """Equal lengths and all indices below the width."""
    return (F.size(indices) == F.size(counts)) & F.forall(indices, lambda i: (i >= 0) & (i < width))


def pairs_sorted(indices: Column, counts: Column) -> Column:
    """The pairs as structs (indices, counts), by index."""
    return F.array_sort(F.arrays_zip(indices.alias("i"), counts.alias("c")))


def count_at(indices: Column, counts: Column, i: Column) -> Column:
    """The count of a bin; of several entries of a bin the last, and 0 for none."""
    found = F.filter(F.arrays_zip(indices.alias("i"), counts.alias("c")), lambda p: p["i"] == i)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["c"]).otherwise(0)


def _let(value: Column, body) -> Column:
    """The body on a value that is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dense(indices: Column, values: Column, width: Column, zero: Column) -> Column:
    """All bins from 0 to the width; of several entries of a bin the last counts.  The entries are sorted, and the gaps between them filled with ``zero``."""
    inside = F.filter(F.transform(F.arrays_zip(indices.alias("i"), values.alias("c")), lambda p, k: F.struct(p["i"].alias("i"), k.alias("k"), p["c"].alias("c"))), lambda p: (p["i"] >= 0) & (p["i"] < width))

    def filled(last: Column) -> Column:
        gaps = F.transform(last, lambda p, k: F.concat(F.array_repeat(zero, p["i"] - F.coalesce(F.get(last, k - 1)["i"], F.lit(-1)) - 1), F.array(p["c"])))
        return F.flatten(F.concat(gaps, F.array(F.array_repeat(zero, width - 1 - F.coalesce(F.get(last, F.size(last) - 1)["i"], F.lit(-1))))))

    return _let(F.array_sort(inside), lambda e: _let(F.filter(e, lambda p, k: F.coalesce(F.get(e, k + 1)["i"] != p["i"], F.lit(True))), filled))


def dense_counts(indices: Column, counts: Column, width: int = WIDTH) -> Column:
    """All bins from 0 to the width; of several entries of a bin the last counts."""
    return dense(indices, counts, F.lit(width), F.lit(0))


def dense_log_counts(indices: Column, counts: Column, width: int = WIDTH) -> Column:
    return F.transform(dense_counts(indices, counts, width), lambda c: F.log1p(c.cast("double")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def count_tanimoto(ia: Column, ca: Column, ib: Column, cb: Column) -> Column:
    """sum of minima / sum of maxima; 1 for two empty vectors, and always from 0 to 1."""
    least = lambda c, d: F.least(F.greatest(c, F.lit(0)), F.greatest(d, F.lit(0)))
    # A map, made once a row, takes no repeated bin; rows with one look the last entry up.
    by_map = F.get(F.transform(F.array(F.map_from_arrays(ib, cb)), lambda m: total(F.zip_with(ia, ca, lambda i, c: least(c, F.coalesce(F.try_element_at(m, i), F.lit(0)))))), F.lit(0))
    shared = F.when(F.size(F.array_distinct(ib)) == F.size(ib), by_map).otherwise(total(F.zip_with(ia, ca, lambda i, c: least(c, count_at(ib, cb, i)))))
    positive = lambda v: total(F.transform(v, lambda c: F.greatest(c, F.lit(0))))
    score = lambda s, both: F.when(both - s <= 1e-8, F.lit(1.0)).otherwise(F.least(F.greatest(s / (both - s), F.lit(0.0)), F.lit(1.0)))
    return F.get(F.transform(F.array(F.struct(shared.alias("s"), (positive(ca) + positive(cb)).alias("both"))), lambda x: score(x["s"], x["both"])), F.lit(0))


def binary_tanimoto(ia: Column, ib: Column) -> Column:
    """Shared bins / all bins; 1 for two empty vectors."""
    union = F.size(F.array_union(ia, ib))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(ia, ib)) / union)


def dense_count_tanimoto(a: Column, b: Column) -> Column:
    """Of two dense count arrays, each made once."""

    def score(x: Column) -> Column:
        low = total(F.zip_with(x["a"], x["b"], lambda c, d: F.least(c, d)))
        high = total(F.zip_with(x["a"], x["b"], lambda c, d: F.greatest(c, d)))
        return _let(F.struct(low.alias("low"), high.alias("high")), lambda s: F.when(s["high"] <= 0, F.lit(1.0)).otherwise(s["low"] / F.greatest(s["high"], F.lit(1e-12))))

    return _let(F.struct(a.alias("a"), b.alias("b")), score)


def from_log(x: Column) -> Column:
    """The count of a log count, at least 0."""
    return F.greatest(F.expm1(x), F.lit(0.0))


def log_count_tanimoto(counts: Column, logs: Column) -> Column:
    """Of dense target counts and predicted log counts."""
    return dense_count_tanimoto(F.transform(counts, lambda x: x.cast("double")), F.transform(logs, from_log))


def log_log_tanimoto(a: Column, b: Column) -> Column:
    """Of two dense arrays of log counts."""
    return dense_count_tanimoto(F.transform(a, from_log), F.transform(b, from_log))


def set_bins(values: Column) -> Column:
    """The bins of a dense array that are above zero."""
    return F.filter(F.transform(values, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def dense_binary_tanimoto(a: Column, b: Column) -> Column:
    """Bins above zero in both / in either, of two dense arrays; 1 if there are none."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(((x > 0) & (y > 0)).cast("int").alias("both"), ((x > 0) | (y > 0)).cast("int").alias("any")))
    count = lambda p, name: F.aggregate(p, F.lit(0), lambda n, x: n + x[name])
    counts = _let(pairs, lambda p: F.struct(count(p, "both").alias("both"), count(p, "any").alias("any")))
    return _let(counts, lambda n: F.when(n["any"] == 0, F.lit(1.0)).otherwise(n["both"] / n["any"]))


def log_mse(target: Column, predicted: Column) -> Column:
    """The mean of squared differences of two dense arrays of log counts."""
    return total(F.zip_with(target, predicted, lambda x, y: (x - y) * (x - y))) / F.size(target)


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))) + eps)
    return F.least(F.greatest(dot / (norm(a) * norm(b)), F.lit(-1.0)), F.lit(1.0))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def huber(delta: Column, beta: float = 1.0) -> Column:
    return F.when(delta <= beta, 0.5 / beta * delta * delta).otherwise(delta - 0.5 * beta)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def class_weights(frequency: Column) -> tuple[Column, Column]:
    """Weights of active and inactive bins from how often a bin is set."""
    return -F.log(frequency + 1e-6), -F.log(1 - frequency + 1e-6)
