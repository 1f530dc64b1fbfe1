"""Sparse counted vectors as tables: long form (id, idx, cnt) and array form (id, indices, counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 4096


def order_vectors(lineitem: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each order as a counted vector in long form: bin l_partkey % width, summed quantity, at most 65535."""
    cnt = F.least(F.sum("l_quantity"), F.lit(65535)).cast("int")
    return lineitem.groupBy(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % width).cast("int").alias("idx")).agg(cnt.alias("cnt"))


def to_arrays(long: DataFrame, key: str = "id") -> DataFrame:
    """key, indices and counts, by index."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "cnt")))
    return long.groupBy(key).agg(pairs.alias("p")).select(key, F.col("p.idx").alias("indices"), F.col("p.cnt").alias("counts"))


def to_long(vectors: DataFrame, key: str = "id") -> DataFrame:
    pair = F.explode(F.arrays_zip(F.col("indices").alias("idx"), F.col("counts").alias("cnt")))
    return vectors.select(key, pair.alias("p")).select(key, "p.idx", "p.cnt")


def scattered(entries: DataFrame) -> DataFrame:
    """entries: id, idx and cnt, a bin perhaps several times.  The log counts by bin, added."""
    return entries.groupBy("id", "idx").agg(F.sum(F.log1p("cnt")).alias("log_count"))


def max_nnz(arrays: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The most stored entries of a row in each batch, at least 1."""
    return arrays.groupBy(batch).agg(F.greatest(F.max(F.size("indices")), F.lit(1)).cast("long").alias("max_nnz"))


def bit_counts(long: DataFrame) -> DataFrame:
    """Rows by bin, counted per stored entry: partial sums by partition, then merged."""
    return long.groupBy("idx").agg(F.count("*").alias("bit_count"))


def bit_frequencies(long: DataFrame, n_rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """The share of rows that set each of all bins; n_rows: one row with n."""
    bins = long.sparkSession.range(width).select(F.col("id").cast("int").alias("idx"))
    counted = bins.join(bit_counts(long), "idx", "left")
    return counted.crossJoin(F.broadcast(n_rows)).select("idx", F.when(F.col("n") > 0, F.coalesce("bit_count", F.lit(0)) / F.col("n")).alias("frequency"))


def manifest_totals(rows: DataFrame) -> DataFrame:
    """rows: status and nnz.  Row, skip and error counts and the stored entries."""
    return rows.agg(
        F.count_if(F.col("status") == "ok").alias("row_count"),
        F.count_if(F.col("status") == "skipped").alias("skipped_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("nnz"))), F.lit(0)).alias("nnz"),
    )


def shard_stats(rows: DataFrame, shard: str = "shard_id") -> DataFrame:
    return rows.groupBy(shard).agg(F.count("*").alias("row_count"), F.sum("nnz").alias("nnz"))


def pair_scores(pairs: DataFrame, long: DataFrame) -> DataFrame:
    """pairs: a, b (ids).  Shared and total counts by join on the bin: counted and binary similarity of each pair."""
    totals = long.groupBy("id").agg(F.sum("cnt").cast("double").alias("s"), F.count("*").alias("k"))
    left = pairs.join(long.select(F.col("id").alias("a"), "idx", F.col("cnt").alias("ca")), "a")
    met = left.join(long.select(F.col("id").alias("b"), "idx", F.col("cnt").alias("cb")), ["b", "idx"]).groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).cast("double").alias("shared"), F.count("*").alias("both"))
    out = pairs.join(met, ["a", "b"], "left")
    for side in ("a", "b"):
        out = out.join(totals.select(F.col("id").alias(side), F.col("s").alias(f"s{side}"), F.col("k").alias(f"k{side}")), side, "left")
    shared, both = F.coalesce("shared", F.lit(0.0)), F.coalesce("both", F.lit(0))
    union = F.coalesce("sa", F.lit(0.0)) + F.coalesce("sb", F.lit(0.0)) - shared
    bits = F.coalesce("ka", F.lit(0)) + F.coalesce("kb", F.lit(0)) - both
    return out.select("a", "b", F.when(union <= 1e-8, 1.0).otherwise(shared / union).alias("count_tanimoto"), F.when(bits == 0, 1.0).otherwise(both / bits).alias("binary_tanimoto"))
