"""Labels of the ranking term in one pass over sorted batches: candidates drawn, their similarities and the best of them, with numpy on a batch's entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ANCHOR_FACTOR, M32, SHIFTS, STATE_FOR_ZERO, ranking_seed

#: Entries looked up at a time.
LOOKUPS = 1 << 22


def draw(n: int, k: int, seed: int) -> np.ndarray:
    """For each row of ``n``, ``k`` other rows or as many as there are: the seeded walk of ``ranking.with_candidates``."""
    if n < 3:
        return np.zeros((n, 0), np.int64)
    p, row = n - 1, np.arange(n, dtype=np.int64)
    state = (seed & M32) ^ (row + 1) * ANCHOR_FACTOR & M32
    state[state == 0] = STATE_FOR_ZERO
    drawn = []
    for _ in range(2):
        for k_, shift in enumerate(SHIFTS):
            state ^= (state >> shift) if k_ == 1 else (state << shift) & M32
        drawn.append(state % p)
    stride = drawn[1] + 1
    while (off := np.gcd(stride, p) != 1).any():
        stride[off] = stride[off] % p + 1
    picked = (drawn[0][:, None] + np.arange(min(max(k, 2), p)) * stride[:, None]) % p
    return picked + (picked >= row[:, None])


def count_similarities(row: np.ndarray, bin_: np.ndarray, count: np.ndarray, n: int, who: np.ndarray) -> np.ndarray:
    """Counted similarity of each row with each of its candidates.  The entries are by row and bin, each bin of a row once."""
    width = int(bin_.max(initial=0)) + 1
    key, count = row * width + bin_, count.astype(np.int64)
    sums = np.bincount(row, count, n).astype(np.int64)
    low = np.zeros(who.shape, np.int64)
    for at in range(0, len(row), step := max(1, LOOKUPS // max(who.shape[1], 1))):
        part = slice(at, at + step)
        wanted = who[row[part]] * width + bin_[part, None]
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        met = np.where(key[place] == wanted, np.minimum(count[part, None], count[place]), 0)
        start = np.flatnonzero(np.diff(row[part], prepend=-1))
        low[row[part][start]] += np.add.reduceat(met, start, axis=0)
    high = sums[:, None] + sums[who] - low
    return np.where(high > 0, low / np.maximum(high, 1), 1.0)


def best_two(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the best score, the first of equals, and its distance to the second."""
    best = scores.argmax(1)
    top = np.sort(scores, 1)[:, -2:]
    return best, np.clip(top[:, 1] - top[:, 0], 0, 1)


def with_steps(batched: DataFrame, first: int = 0) -> DataFrame:
    """Adds step: the number of the row's batch among all that have rows, from ``first`` on.  One task numbers the batches, a row for each."""
    steps = batched.select("batch_id").distinct().withColumn("step", F.row_number().over(Window.orderBy("batch_id")) - 1 + first)
    return batched.join(steps, "batch_id")


def _each_batch(rows: DataFrame, make, schema: str) -> DataFrame:
    """Applies ``make`` to the rows of each batch, in the order of row, as a task's sorted stream has them.  batch_id has to be the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            ids = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(b)] if len(b) else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != ids[i]:
                    yield from make(pa.Table.from_batches(held).combine_chunks()).to_batches()
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield from make(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return rows.repartition("batch_id").sortWithinPartitions("batch_id", "row").mapInArrow(run, schema)


def _similarities(rows: pa.Table, who: np.ndarray) -> np.ndarray:
    """Counted similarities of a batch's rows with their candidates."""
    indices, counts = (rows[c].chunk(0) for c in ("indices", "counts"))
    row = np.repeat(np.arange(len(rows)), np.diff(indices.offsets.to_numpy()))
    bin_, count = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (indices, counts))
    width = int(bin_.max(initial=0)) + 1
    if (np.diff(key := row * width + bin_) <= 0).any():
        # The counts of a repeated bin are added.
        key, own = np.unique(key, return_inverse=True)
        row, bin_, count = key // width, key % width, np.bincount(own, count).astype(np.int64)
    return count_similarities(row, bin_, count, len(rows), who)


def labelled(batched: DataFrame, epoch: int, candidates: int) -> DataFrame:
    """batched: batch_id, row (0 on), step, indices and counts.  Adds candidates, best_pos and top2_gap, by a seed of the epoch and the step.

    A task reads whole batches as a sorted stream, so a batch's vectors travel once, however many
    candidates it has.  Batches under three rows get none.
    """

    def label(rows: pa.Table) -> pa.Table:
        n = len(rows)
        who = draw(n, candidates, ranking_seed(epoch, rows["step"][0].as_py()))
        best, gap = best_two(_similarities(rows, who)) if who.shape[1] else (np.zeros(n, np.int64), np.zeros(n))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * who.shape[1], pa.int32()), pa.array(who.ravel(), pa.int32()))
        return rows.append_column("candidates", lists).append_column("best_pos", pa.array(best, pa.int32())).append_column("top2_gap", pa.array(gap))

    rows = batched.select("batch_id", *(c for c in batched.columns if c != "batch_id"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return _each_batch(rows, label, f"{schema}, candidates array<int>, best_pos int, top2_gap double")


def best_candidates(batched: DataFrame, seed: int, candidates: int) -> DataFrame:
    """batched: batch_id (long), row, indices and counts.  batch_id, anchor, best_pos, best_score and top2_gap of each row of batches of three or more, by one seed for all batches."""
    names = ["batch_id", "anchor", "best_pos", "best_score", "top2_gap"]

    def judge(rows: pa.Table) -> pa.Table:
        who = draw(len(rows), candidates, seed)
        if not who.shape[1]:
            rows, who = rows.slice(0, 0), who[:0]
            return pa.table([rows["batch_id"], rows["row"], pa.array([], pa.int32()), pa.array([], pa.float64()), pa.array([], pa.float64())], names)
        scores = _similarities(rows, who)
        best, gap = best_two(scores)
        return pa.table([rows["batch_id"], rows["row"], pa.array(best, pa.int32()), pa.array(scores[np.arange(len(best)), best]), pa.array(gap)], names)

    return _each_batch(batched.select("batch_id", "row", "indices", "counts"), judge, "batch_id long, anchor int, best_pos int, best_score double, top2_gap double")


def drawn(batched: DataFrame, seed: int, candidates: int) -> DataFrame:
    """batch_id (long), row and candidates of each row, by one seed for all batches; none in batches under three rows."""

    def pick(rows: pa.Table) -> pa.Table:
        who = draw(len(rows), candidates, seed)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * who.shape[1], pa.int32()), pa.array(who.ravel(), pa.int32()))
        return pa.table([rows["batch_id"], rows["row"], lists], ["batch_id", "row", "candidates"])

    return _each_batch(batched.select("batch_id", "row"), pick, "batch_id long, row int, candidates array<int>")
