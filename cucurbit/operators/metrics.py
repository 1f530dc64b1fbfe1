"""Batch metrics: which batches are sampled, means over epochs and passes, and loader profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sampled(step: Column, every: int) -> Column:
    """Whether a step, counted from 1 over all epochs, has its metrics taken: the first, and each whose number ``every`` divides."""
    first = step == 1
    return first | (step % every == 0) if every else first


def epoch_means(by_step: DataFrame, every: int) -> DataFrame:
    """by_step: epoch, step (from 1, over all epochs) and loss.  The mean loss of each epoch's sampled steps, its batches, and how many are sampled."""
    taken = F.when(sampled(F.col("step"), every), F.col("loss"))
    return by_step.groupBy("epoch").agg(F.coalesce(F.avg(taken), F.lit(0.0)).alias("mean"), F.count("*").alias("batches"), F.count(taken).alias("loss_batches"))


def mean_of_means(rows: DataFrame, *values: str, batch: str = "batch_id") -> DataFrame:
    """The mean over batches of each value's mean in a batch; batches weigh the same, whatever their size."""
    by_batch = rows.groupBy(batch).agg(*(F.avg(v).alias(v) for v in values))
    return by_batch.agg(*(F.avg(v).alias(v) for v in values))


def running_best(losses: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Adds best: the least value so far."""
    own = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return losses.withColumn("best", F.min(value).over(own))


def loader_profile(by_batch: DataFrame, every: int, *times: str) -> DataFrame:
    """by_batch: batch (from 0), rows and times.  For each ``every`` batches: their number, rows, and the mean of each time a batch."""
    if every < 1:
        raise ValueError("every must be positive")
    grouped = by_batch.groupBy(F.floor(F.col("batch") / every).cast("long").alias("part"))
    return grouped.agg(F.count("*").alias("batches"), F.sum("rows").alias("n_rows"), *(F.avg(t).alias(t) for t in times))


def row_estimates(rows: int, validation_permille: int) -> tuple[int, int]:
    """About how many rows are for training and for validation."""
    validation = rows * min(validation_permille, 1000) // 1000
    return rows - validation, validation


def examples_per_second(examples: int, seconds: float) -> float:
    return examples / seconds if seconds else 0.0


def millis_per_batch(seconds: float, batches: int) -> float:
    return seconds * 1000 / batches if batches else 0.0
