"""Operator 7: placement by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size: an offset and a
stride from hashes of its name.  Shards take turns, each claiming the first slot in its order
that is still free, until the table is full.  A key's slot is its hash modulo the table size, so
placing a row is one look at a broadcast table of that fixed size.  Taking a shard away moves
few keys besides its own.

Defined results: a null key is placed by the hash of a null; rows with the same key go to the
same shard; a shard of weight w takes w turns in a round.  Columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
N_SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and stride of a shard's walk over the slots."""
    digest = hashlib.sha256(name.encode("utf-8")).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: dict[str, int], size: int = TABLE_SIZE) -> np.ndarray:
    """The number of the shard (in the order of the names) that owns each slot.  shards: weights by name."""
    if not is_prime(size):
        raise ValueError(f"the table's size must be prime: {size}")
    names = sorted(n for n, w in shards.items() if w > 0)
    if not names or len(names) > size:
        raise ValueError("there must be 1 to table-size shards of positive weight")
    table = np.full(size, -1, np.int32)
    walks = [preference(n, size) for n in names]
    step = [0] * len(names)
    left = size
    while left:
        for i, name in enumerate(names):
            offset, stride = walks[i]
            for _ in range(min(shards[name], left)):
                while table[slot := (offset + step[i] * stride) % size] >= 0:
                    step[i] += 1
                table[slot] = i
                left -= 1
    return table


def table_frame(spark: SparkSession, shards: dict[str, int], size: int = TABLE_SIZE) -> DataFrame:
    import pandas as pd

    names = sorted(n for n, w in shards.items() if w > 0)
    table = lookup_table(shards, size)
    return spark.createDataFrame(pd.DataFrame({"slot": np.arange(size, dtype=np.int32), "shard": np.array(names, object)[table]}), "slot int, shard string")


def place(rows: DataFrame, keys: list[str], shards: dict[str, int], size: int = TABLE_SIZE) -> DataFrame:
    """Adds slot and shard.  What is broadcast has ``size`` rows, however many rows are placed."""
    table = table_frame(rows.sparkSession, shards, size)
    return rows.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")).join(F.broadcast(table), "slot")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(sized, ["doc_id"], {f"shard-{i:03d}": 1 for i in range(N_SHARDS)}).select("doc_id", "n_bytes", "slot", "shard")
