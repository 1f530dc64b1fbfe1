"""Tables on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where it is unset and Spark runs in one process."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return "file:///tmp/cucurbit-checkpoints"


def saved(frame: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, whatever executors are lost."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Rows that one task takes where each of them is costly.
SPREAD = 20_000


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by columns over as many tasks as their number asks for: a small file of many short rows is one split, however long each of them takes.

    ``rows`` is counted first, so it should be a stored table with some of its columns.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SPREAD)), *by)
