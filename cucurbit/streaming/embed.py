"""The same plans over streams of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.embed import embed, fingerprinted
from ..sources.molecules import smi_lines
from ..types import Model


def stream_smi(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of .smi files as they come."""
    return smi_lines(spark.readStream.text(folder))


def stream_embed(spark: SparkSession, folder: str, to: str, checkpoint: str, weights: dict, config: Model):
    """Encodings of all files there are, appended as Parquet; run again for what is new since."""
    rows = embed(stream_smi(spark, folder), weights, config)
    return rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def stream_bit_counts(spark: SparkSession, folder: str, config: Model) -> DataFrame:
    """Rows by bin so far; its state has one entry a bin."""
    rows = fingerprinted(stream_smi(spark, folder), config)
    return rows.select(F.explode("indices").alias("idx")).groupBy("idx").agg(F.count("*").alias("bit_count"))
