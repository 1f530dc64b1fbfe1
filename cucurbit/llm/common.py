"""What several operators need: batches in parts, and tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what is made of one is small; and at the end the pool's free memory goes back."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Lists the tables saved in a block, by this thread, for ``forget`` once what is made of them is saved itself."""
    tables: list[DataFrame] = []
    token = _scratch.set(tables)
    try:
        yield tables
    finally:
        _scratch.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where it is unset and Spark runs in one process, as in tests."""
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
    table = spark.read.schema(frame.schema).parquet(path)
    table.saved_at = path
    if (tables := _scratch.get()) is not None:
        tables.append(table)
    return table


def forget(*tables: DataFrame) -> None:
    """Removes saved tables that nothing still to be run reads."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
