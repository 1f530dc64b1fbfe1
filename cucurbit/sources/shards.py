"""Shards of processed molecules: Parquet by shard, with each row's place, so that ranges of rows are filters that reach the scan.

The rows of a shard are those of ``rows_per_shard`` consecutive places.  What a binary file's header
would hold, widths and totals, is in the manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import SHARD_ROW, Model

#: The splits by their byte.
SPLITS = ("train", "validation")


class ShardError(ValueError):
    """A table or a range that is no such shard."""


def split_byte(split: Column) -> Column:
    """0 or 1; another name is an error."""
    out = F.when(split == SPLITS[0], 0).when(split == SPLITS[1], 1)
    return out.otherwise(F.raise_error(F.concat(F.lit("no split "), F.coalesce(split, F.lit("null"))))).cast("byte")


def split_name(byte: Column) -> Column:
    """The split of a byte; another than 0 and 1 is an error."""
    out = F.when(byte == 0, SPLITS[0]).when(byte == 1, SPLITS[1])
    return out.otherwise(F.raise_error(F.concat(F.lit("no split "), F.coalesce(byte.cast("string"), F.lit("null")))))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SHARD_ROW)


def checked(rows: DataFrame, size: int = 4096, width: int = 18) -> DataFrame:
    """The rows as they are; one that breaks a rule of the format ends the job with an error."""
    says = (
        F.when(F.size("indices") != F.size("counts"), "lengths of indices and counts differ")
        .when(F.exists("indices", lambda i: (i < 0) | (i >= size)), f"an index is not below {size}")
        .when(F.exists("counts", lambda c: (c < 0) | (c > 65535)), "a count is not from 0 to 65535")
        .when(F.size("descriptor_targets") != width, f"descriptors are not {width}")
        .when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "bad split")
    )
    return rows.withColumn("split", F.when(says.isNull(), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("row "), F.coalesce(F.col("cid").cast("string"), F.lit("null")), F.lit(": "), says))))


def violations(rows: DataFrame, size: int = 4096, width: int = 18) -> DataFrame:
    """How many rows break each rule of the format."""
    return rows.agg(
        F.count_if(F.size("indices") != F.size("counts")).alias("lengths"),
        F.count_if(F.exists("indices", lambda i: (i < 0) | (i >= size))).alias("indices"),
        F.count_if(F.size("descriptor_targets") != width).alias("descriptors"),
        F.count_if(~F.col("split").isin(*SPLITS)).alias("splits"),
    )


def write_shards(rows: DataFrame, folder: str, size: int = 4096, width: int = 18, rows_per_shard: int = 10_000_000, mode: str = "errorifexists") -> list[dict]:
    """rows: a shard row's columns and row_idx (0 on).  Returns shard_id, path, row_count and nnz of each shard.

    Rows are dealt by ranges of their places, so a shard is written by as many tasks as its size asks
    for; within a file they are in order, which lets row groups be skipped.
    """
    if rows_per_shard < 1:
        raise ValueError("rows_per_shard must be positive")
    numbered = checked(rows, size, width).withColumn("shard_id", F.floor(F.col("row_idx") / rows_per_shard).cast("int")).withColumn("row_in_shard", F.col("row_idx") - F.col("shard_id").cast("long") * rows_per_shard).drop("row_idx")
    numbered.repartitionByRange("shard_id", "row_in_shard").sortWithinPartitions("shard_id", "row_in_shard").write.mode(mode).partitionBy("shard_id").parquet(folder)
    # With the schema given, a folder without a row can be read too.
    told = rows.sparkSession.read.schema(numbered.schema).parquet(folder).groupBy("shard_id").agg(F.count("*").alias("row_count"), F.coalesce(F.sum(F.size("indices")), F.lit(0)).alias("nnz")).orderBy("shard_id")
    return [{"shard_id": r.shard_id, "path": f"shard_id={r.shard_id}", "row_count": r.row_count, "nnz": r.nnz} for r in told.collect()]


def shard_paths(folder: str, manifest: dict) -> list[str]:
    """The manifest's shards, relative to its folder; a manifest without any is an error."""
    if not manifest["shards"]:
        raise ShardError("the manifest lists no shards")
    return [s["path"] if "://" in s["path"] or s["path"].startswith("/") else f"{folder.rstrip('/')}/{s['path']}" for s in manifest["shards"]]


def read_shards(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """The shards that the manifest lists, one after the other by shard_id."""
    return spark.read.option("basePath", folder).parquet(*shard_paths(folder, manifest))


def check_shape(manifest: dict, config: Model) -> None:
    """The stored widths must be the model's."""
    stored = manifest["preprocessing"]
    if stored["fingerprint_size"] != config.fingerprint_size:
        raise ShardError(f"fingerprints are {stored['fingerprint_size']} wide, the model {config.fingerprint_size}")
    if stored.get("descriptor_width", 18) != config.descriptor_width:
        raise ShardError(f"descriptors are {stored['descriptor_width']} wide, the model {config.descriptor_width}")


def in_range(rows: DataFrame, start: int, end: int, position: str = "row_in_shard") -> DataFrame:
    """The rows from start to before end."""
    return rows.where((F.col(position) >= start) & (F.col(position) < end))


def read_range(spark: SparkSession, folder: str, manifest: dict, shard: int, start: int, end: int) -> DataFrame:
    """Rows of one shard; a range beyond it is an error, an empty one gives none."""
    own = [s for s in manifest["shards"] if s["shard_id"] == shard]
    if not own:
        raise ShardError(f"no shard {shard}")
    if not 0 <= start <= end <= own[0]["row_count"]:
        raise ShardError(f"no rows {start} to {end} among {own[0]['row_count']}")
    return in_range(read_shards(spark, folder, manifest).where(F.col("shard_id") == shard), start, end)


def row_at(shards: DataFrame, shard: int, place: int) -> DataFrame:
    """That row, or none beyond the end."""
    return shards.where((F.col("shard_id") == shard) & (F.col("row_in_shard") == place))


def of_split(shards: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"no split {split!r}")
    return shards.where(F.col("split") == split)
