"""Operator 10: best-fit packing of documents into sequences, with matching of the large ones.

Lengths are whole numbers up to the capacity, so the packing is planned on the counts by length:
a table of at most ``capacity`` rows, whatever the size of the corpus.

* Pieces that fill a sequence stand alone.
* Pieces above a third of the capacity fit at most twice in a sequence: from the largest down,
  each takes the largest partner that fits, until either length is used up.
* Smaller pieces, from the largest down, go where the least gap that holds them is left; when
  there is none, new sequences are opened.

A step of the plan moves runs of equal pieces into runs of equal sequences.  Spark numbers the
pieces of each length (in salted groups, with offsets by group) and looks each number up in the
plan, which gives its sequence and its offset there.

Defined results: a null or empty text is the end id alone, one token.  Repeated rows and ids are
packed as they come; equal ones may change places with each other.  Null ids stay null.  Of the
documents id and text are read; their other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import model
from .common import parts, saved

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that a group numbers, on average: the groups grow in number with the pieces.
GROUP = 50_000


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids_crc32: each text's ids and the end id, cut where they pass the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, step = model(path), np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for b in parts(batches, 2048):
            whose, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(own.encode_many(b.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    whose.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whose, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class Run:
    """``n`` sequences from number ``first`` on, all holding pieces of the same lengths: (length, number of the first piece, offset)."""

    __slots__ = ("first", "gap", "held", "n")

    def __init__(self, first: int, n: int, gap: int, held: list[tuple[int, int, int]]):
        self.first, self.n, self.gap, self.held = first, n, gap, held

    def split(self, n: int) -> Run:
        """Takes the first ``n`` sequences away."""
        head = Run(self.first, n, self.gap, list(self.held))
        self.first, self.n = self.first + n, self.n - n
        self.held = [(length, number + n, offset) for length, number, offset in self.held]
        return head


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, from number, to number, first sequence, offset): pieces of a length with these numbers go to consecutive sequences."""
    left, used, bins = dict(counts), dict.fromkeys(counts, 0), 0
    done: list[Run] = []
    open_runs: dict[int, list[Run]] = {}
    gaps: list[int] = []

    def put(run: Run) -> None:
        if run.gap == 0:
            done.append(run)
        else:
            if run.gap not in open_runs:
                insort(gaps, run.gap)
            open_runs.setdefault(run.gap, []).append(run)

    def take(length: int, n: int) -> int:
        left[length] -= n
        used[length] += n
        return used[length] - n

    def opened(n: int, lengths: list[int]) -> None:
        nonlocal bins
        held, offset = [], 0
        for length in lengths:
            held.append((length, take(length, n), offset))
            offset += length
        put(Run(bins, n, capacity - offset, held))
        bins += n

    large = sorted((length for length in counts if 3 * length > capacity and counts[length] > 0), reverse=True)
    waiting = sorted(large)
    for a in large:
        while left[a]:
            at = bisect_left(waiting, min(a, capacity - a) + 1) - 1
            while at >= 0 and not left[waiting[at]]:
                waiting.pop(at)
                at -= 1
            b = waiting[at] if at >= 0 else None
            if b is None or b + a > capacity or (b == a and left[a] == 1):
                if b == a and left[a] == 1 and at > 0:  # the last of its length: a shorter partner
                    while at > 0 and not left[waiting[at - 1]]:
                        waiting.pop(at - 1)
                        at -= 1
                    if at > 0:
                        opened(1, [a, waiting[at - 1]])
                        continue
                opened(left[a], [a])
            else:
                opened(left[a] // 2 if a == b else min(left[a], left[b]), [a, b])
    for a in sorted((length for length in counts if 3 * length <= capacity and counts[length] > 0), reverse=True):
        while left[a]:
            at = bisect_left(gaps, a)
            if at == len(gaps):
                each = capacity // a
                if left[a] >= each:
                    opened(left[a] // each, [a] * each)
                else:
                    opened(1, [a] * left[a])
                continue
            gap = gaps[at]
            run = open_runs[gap].pop()
            if not open_runs[gap]:
                del open_runs[gap]
                gaps.pop(at)
            if run.n > left[a]:
                head = run.split(left[a])
                put(run)
                run = head
            run.held.append((a, take(a, run.n), capacity - gap))
            run.gap = gap - a
            put(run)
    rows = done + [r for runs in open_runs.values() for r in runs]
    return [(length, number, number + r.n, r.first, offset) for r in rows for length, number, offset in r.held]


def plan_frame(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY) -> DataFrame:
    """length, and its part of the plan by number."""
    found = pd.DataFrame(plan(counts, capacity), columns=["length", "low", "high", "first", "offset"]).astype("int64")
    return spark.createDataFrame(found, "length long, low long, high long, first long, offset long")


def numbered(pieces: DataFrame, order: list[str], counts: dict[int, int], group: int = GROUP) -> DataFrame:
    """Adds the number of each piece among those of its length, from 0; counts: pieces by length, at most one entry for each."""
    dealt = pieces.sparkSession.createDataFrame([(k, -(-n // group)) for k, n in counts.items()], "length long, __groups long")
    salted = pieces.join(F.broadcast(dealt), "length").withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__groups"))).drop("__groups")
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__salt").orderBy(*order)
    return salted.withColumn("__own", F.row_number().over(own) - 1).join(offsets, ["length", "__salt"]).withColumn("number", F.col("__own") + F.col("__before")).drop("__own", "__before", "__salt")


def packed(pieces: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces, which have a length from 1 to the capacity.

    ``pieces`` is read twice, so it should be a saved table.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = plan_frame(pieces.sparkSession, counts, capacity)
    by_length = steps.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("__steps"))
    rows = numbered(pieces, order or ["doc_id", "piece"], counts).join(F.broadcast(by_length), "length")
    # The steps of a length follow each other without gaps: one holds the number.
    found = rows.withColumn("__at", F.expr("filter(__steps, s -> number >= s.low and number < s.high)[0]"))
    return found.select(*pieces.columns, (F.col("__at.first") + F.col("number") - F.col("__at.low")).alias("sequence_id"), F.col("__at.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    return packed(saved(token_pieces(docs, path, capacity, key, text)), capacity, [key, "piece", "ids_crc32"])


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
