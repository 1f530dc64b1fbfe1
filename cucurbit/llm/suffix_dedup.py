"""Operator 8: removal of every byte that a repeated string of ``LENGTH`` bytes covers, by prefix doubling.

A round sorts positions by pairs of ranks and keeps those that are tied: a position whose rank is
unique leaves, one whose whole string is tied is past the threshold, and of the rest the next round
ranks longer strings, as pairs of ranks at a larger offset.  Ranks are named by 64-bit hashes, as
every task can compute them; which are tied, Spark's sort tells.  To sort a row for each byte in
each round would take many times the input, so positions that share a rank are ranked together:

* Every string of ``LENGTH`` bytes has an anchor, the ``ANCHOR`` bytes of least hash in it, so
  equal strings have equal anchors at equal places.  The positions with one anchor are a run, some
  sixty long.  The first round ranks runs by their anchors, then by all their bytes (the hull).
* The rounds after it cut the runs left into cells of 32, 4 and 1 positions, on a grid from the
  anchor.  All strings of a cell share 169, 197 and 200 bytes, whose rank is the pair of the ranks
  of 128 bytes at its start and at offset 41, 69 and 72.  A cell leaves if its pair is unique.  If
  all its bytes are tied, all its strings are past the threshold.
* Of tied runs or cells with the same bytes one goes on, and only if its rank is also that of
  others with different bytes: the places where a repeat begins or ends.

What a task finds tied among its own rows is settled before the shuffle, so that a hot rank sends one
row from each task for each distinct hull.  Groups are read as sorted streams; none is held.

Defined results: null and empty texts have no bytes; texts shorter than a string keep all.
Rows with equal ids or texts are matched like any others, so both copies of a long text go.  A row
without an id is a row like any other and keeps its null.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, saved
from .kernels import Hasher, mix, sliding_min

LENGTH = 200
ANCHOR = 64
CELLS = (32, 4, 1)
#: Start positions of a long text that are looked at together, and rows that a task settles at a time.
SEGMENT = 1 << 19
FLUSH = 1 << 20
#: A row of a round: ranks, position (text, and in q a second hash of it and the place), and two small numbers in m.
FIELDS = ["state", "r", "r2", "w", "k", "q", "m"]
SCHEMA = "state int, r long, r2 long, w long, k long, q long, m int"
#: States before the sort: alone, settled as tied, and tied but going on for its kind; after it, bits.
ALONE, SETTLED, FIRST = 0, 1, 2
TIED, GOES_ON = 1, 2


def hulls(data: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of start positions whose strings have one anchor: first start, number of starts, start to anchor, hash of the anchor, hash of all bytes."""
    for base in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        name = Hasher(part)
        at = np.arange(len(part) - anchor + 1)
        own = name(at, at + anchor)
        least = sliding_min(own, length - anchor + 1)
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        end = np.append(start[1:], len(least))
        # A string's anchor is the first place of its least hash; in a periodic text a run has several.
        rank, value = np.unique(least[start], return_inverse=True)
        at = np.minimum(np.searchsorted(rank, own), len(rank) - 1)
        places = np.flatnonzero(rank[at] == own)
        wide = len(own) + 1
        order = np.sort(at[places] * wide + places)
        low = np.searchsorted(order, value * wide + start)
        many = np.searchsorted(order, value * wide + end - 1 + length - anchor, "right") - low
        run = np.repeat(np.arange(len(start)), many)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        place = order[low[run] + nth] % wide
        first = np.where(nth > 0, np.concatenate([[0], place[:-1]]) + 1, start[run])
        first = np.maximum(first, start[run])
        stop = np.minimum(end[run], place + 1)
        keep = stop > first
        first, stop, place, run = first[keep], stop[keep], place[keep], run[keep]
        yield base + first, stop - first, place - first, rank[value[run]], name(first, stop - 1 + length)


def settled(r: np.ndarray, r2: np.ndarray, w: np.ndarray, k: np.ndarray, q: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """The rows with their states: of those with equal ranks and bytes, one goes on."""
    order = np.lexsort((w, r2, r))
    r, r2, w, k, q, m = (x[order] for x in (r, r2, w, k, q, m))
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (r2[1:] != r2[:-1]) | (w[1:] != w[:-1])
    several = np.concatenate([~new[1:], [False]])
    state = np.where(new, np.where(several, FIRST, ALONE), SETTLED).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (state, r.view(np.int64), r2.view(np.int64), w.view(np.int64), k, q, m)], FIELDS)


def reranked(rows: DataFrame) -> DataFrame:
    """k, q, m and state of the rows of a round that are tied (bit 1) or that go on (bit 2)."""
    out = ["state", "k", "q", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What came before: the last row's ranks, whether its rank has several kinds, and its first kind's row while it has one.
        before: tuple[int, int, int] | None = None
        mixed, first, held = False, None, None

        def told(batch: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal before, mixed, first
            end = len(batch) - (not last)
            state, r, r2, w = (batch.column(i).to_numpy() for i in range(4))
            same_r, same_w = np.zeros(len(r) + 1, bool), np.zeros(len(r) + 1, bool)
            same_r[1:-1] = (r[1:] == r[:-1]) & (r2[1:] == r2[:-1])
            same_w[1:-1] = same_r[1:-1] & (w[1:] == w[:-1])
            if before is not None:
                same_r[0] = before[:2] == (r[0], r2[0])
                same_w[0] = same_r[0] and before[2] == w[0]
            tied = same_w[:-1] | same_w[1:] | (state == FIRST)
            begins = np.flatnonzero(~same_r[:end])
            kinds = np.concatenate([[0], np.cumsum(~same_w[:end])])
            goes = np.zeros(len(r), bool)
            # The rank that goes on from the batch before.
            stop = int(begins[0]) if len(begins) else end
            if kinds[stop] > 0 and stop > 0:
                goes[:stop] = ~same_w[:stop]
                if not mixed and first is not None:
                    yield first
                mixed, first = True, None
            if len(begins):
                ends = np.append(begins[1:], end)
                several = kinds[ends] - kinds[begins] > 1
                inside = np.repeat(several, ends - begins)
                goes[stop:end] = inside & ~same_w[stop:end]
                mixed = bool(several[-1])
                at = int(begins[-1])
                first = None if mixed else made(batch, np.array([at]), np.array([GOES_ON]))
            bits = tied * TIED + goes * GOES_ON
            keep = np.flatnonzero(bits[:end])
            if len(keep):
                yield made(batch, keep, bits[keep])
            if end:
                before = (int(r[end - 1]), int(r2[end - 1]), int(w[end - 1]))

        def made(batch: pa.RecordBatch, at: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int32)), *(batch.column(i).take(pa.array(at)) for i in (4, 5, 6))], out)

        for b in batches:
            done = b.column(0).to_numpy() == SETTLED
            if done.any():
                yield made(b, np.flatnonzero(done), np.full(int(done.sum()), TIED))
                b = b.filter(pa.array(~done))
            if len(b):
                if held is not None:
                    b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
                yield from told(b, False)
                held = b.slice(len(b) - 1)
        if held is not None:
            yield from told(held, True)

    to = F.when(F.col("state") == SETTLED, F.xxhash64("k", "q")).otherwise(F.xxhash64("r", "r2"))
    return rows.repartition(to).sortWithinPartitions("r", "r2", "w").mapInArrow(run, "state int, k long, q long, m int")


# -- the rounds ---------------------------------------------------------------------------------------


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, __text, and two hashes of both that name a text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), t.alias("__text"), F.xxhash64(key, t).alias("k"), F.hash(t, F.col(key)).alias("j"))


def small(m: Column) -> tuple[Column, Column]:
    """The two numbers in m."""
    return m.bitwiseAND(0xFFF), F.shiftright(m, 12)


def runs_of(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """The first round's rows: r is the anchor's rank and w that of the hull; m has the way to the anchor and the number of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            h, x, k, q, m = (np.concatenate(c) for c in zip(*held, strict=True))
            return settled(h, np.zeros(len(h), np.uint64), mix(x ^ m.astype(np.uint64)), k, q, m)

        for b in parts(batches):
            for t, k, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for s, n, d, h, x in hulls(np.frombuffer(t.encode("utf-8"), np.uint8), length, anchor):
                    held.append((h, x, np.full(len(s), k), np.int64(j) << 32 | s, (d | n << 12).astype(np.int32)))
                    n_held += len(s)
                if n_held > FLUSH:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()

    return rows.select("__text", "k", "j").mapInArrow(run, SCHEMA)


def bytes_of(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """k, q, m and the bytes of the hulls wanted: texts and hulls meet in a sorted stream, a text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raw = None, b""
        for b in parts(batches, 2048):
            k, j = b.column(0).to_numpy(), b.column(1).to_numpy()
            q, m, tag = (c.to_pylist() for c in (b.column(3), b.column(4), b.column(2)))
            at, data = [], []
            for i, is_hull in enumerate(tag):
                if is_hull:
                    s, n = q[i] & 0xFFFFFFFF, m[i] >> 12
                    at.append(i)
                    data.append(raw[s : s + n - 1 + length])
                elif (k[i], j[i]) != key:
                    key, raw = (k[i], j[i]), b.column(5)[i].as_py().encode("utf-8")
            if at:
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)) for i in (0, 3, 4)), pa.array(data, pa.binary())], ["k", "q", "m", "data"])

    hull = wanted.select("k", F.shiftright("q", 32).cast("int").alias("j"), F.lit(1).alias("tag"), "q", "m", F.lit(None).cast("string").alias("text"))
    texts = rows.select("k", "j", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("int").alias("m"), F.col("__text").alias("text"))
    met = texts.unionByName(hull).repartition("k", "j").sortWithinPartitions("k", "j", "tag")
    return met.mapInArrow(run, "k long, q long, m int, data binary")


def cells_of(left: DataFrame, size: int, length: int) -> DataFrame:
    """left: k, q, d (way to the anchor), data, and the positions [a, b).  The rows of the round that cuts them into cells of ``size``; m has a cell's first position and how many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = length - size + 1
        half = 1 << (shared.bit_length() - 1)
        for batch in parts(batches, 4096):
            k, q, d, a, b = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            data = batch.column(5).to_pylist()
            base = np.cumsum([0, *map(len, data)])[:-1]
            name = Hasher(np.frombuffer(b"".join(data), np.uint8))
            # The way to the anchor names a position alike in all hulls of the anchor.
            low, many = (d - b + 1) // size, (d - a) // size - (d - b + 1) // size + 1
            own = np.repeat(np.arange(len(k)), many)
            grid = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + low[own]
            first, last = d[own] - (grid + 1) * size + 1, d[own] - grid * size
            start, stop, at = np.maximum(a[own], first), np.minimum(b[own], last + 1), base[own]
            r = mix(name(at + last, at + last + half) ^ mix(grid.view(np.uint64)))
            r2 = name(at + last + shared - half, at + last + shared)
            w = mix(name(at + start, at + stop - 1 + length) ^ mix(((d[own] - start) << 12 | stop - start).view(np.uint64)))
            if len(own):
                yield settled(r, r2, w, k[own], q[own], (start | (stop - start) << 12).astype(np.int32))

    return left.select("k", "q", "d", "a", "b", "data").mapInArrow(run, SCHEMA)


def repeated_spans(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """rows: what keyed() gives.  Returns of each text the spans of starts whose strings repeat: k, j, start, n."""
    tied, on = F.col("state").bitwiseAND(TIED) > 0, F.col("state").bitwiseAND(GOES_ON) > 0
    place = F.col("q").bitwiseAND(0xFFFFFFFF)
    first, many = small(F.col("m"))

    found = saved(reranked(runs_of(rows, length, anchor)))
    spans = found.where(tied).select("k", "q", place.alias("start"), many.alias("n"))
    data = saved(bytes_of(rows, found.where(on), length))
    data = data.select("k", "q", "data", first.alias("d"), many.alias("n"))
    left = data.withColumns({"a": F.lit(0), "b": F.col("n")})
    for size in (c for c in CELLS if c <= length // 4):
        found = saved(reranked(cells_of(left, size, length)))
        spans = spans.unionByName(found.where(tied).select("k", "q", (place + first).alias("start"), many.alias("n")))
        left = found.where(on).select("k", "q", first.alias("a"), (first + many).alias("b")).join(data.select("k", "q", "data", "d"), ["k", "q"])
    return spans.select("k", F.shiftright("q", 32).cast("int").alias("j"), "start", "n")


def merged(start: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Disjoint byte runs, in order, that the strings cover."""
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate((start + n - 1 + length)[order]) if len(start) else start
    begins = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.zeros(0, np.int64)
    return list(zip(a[begins].tolist(), b[np.append(begins[1:], len(a)) - 1].tolist(), strict=True))


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, with_kept: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay, null unless asked for) of every text."""
    rows = keyed(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        spans: list[tuple[np.ndarray, np.ndarray]] = []
        for b in parts(batches, 2048):
            k, j, tag = (b.column(i).to_numpy() for i in range(3))
            start, n = (b.column(i).fill_null(0).to_numpy() for i in (3, 4))
            texts, at, out = np.flatnonzero(tag == 1), 0, []
            edge = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(k)] if len(k) else []
            for s, t in zip(edge[:-1], edge[1:], strict=True):
                if (k[s], j[s]) != own:
                    own, spans = (k[s], j[s]), []
                first = s + int(np.count_nonzero(tag[s:t] == 0))
                if first > s:
                    spans.append((start[s:first], n[s:first]))
                for i in range(first, t):
                    raw, done, kept = b.column(5)[i].as_py().encode("utf-8"), 0, []
                    runs = merged(*(np.concatenate(c) for c in zip(*spans, strict=True)), length) if spans else []
                    for x, y in runs:
                        kept.append(raw[done:x])
                        done = y
                    left = b"".join([*kept, raw[done:]])
                    out.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left if with_kept else None))
            if out:
                columns = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(6).take(pa.array(texts)), *(pa.array(c, t) for c, t in columns)], names)

    none = F.lit(None)
    told = repeated_spans(rows, length, anchor).select("k", "j", F.lit(0).alias("tag"), F.col("start").cast("long"), F.col("n").cast("long"), none.cast("string").alias("text"), none.cast(kind).alias("key"))
    texts = rows.select("k", "j", F.lit(1).alias("tag"), none.cast("long").alias("start"), none.cast("long").alias("n"), F.col("__text").alias("text"), F.col(key).alias("key"))
    met = texts.unionByName(told).repartition("k", "j").sortWithinPartitions("k", "j", "tag")
    return met.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False).drop("kept")


def oracle_sql(source: str = "documents", length: int = LENGTH) -> str:
    """DuckDB's SQL for the query: every string of the length by its place, for small tables."""
    return f"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM {source}),
sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM raw),
strings AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * length})) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(n - {length - 1}, 0))) AS i FROM sized)),
again AS (SELECT doc_id, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + {length} THEN 1 ELSE 0 END AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM numbered GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, coalesce(max(r.b), 0), max(n) FROM sized LEFT JOIN runs r USING (doc_id) GROUP BY doc_id),
parts AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM kept JOIN sized USING (doc_id) GROUP BY doc_id),
told AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT s.doc_id, s.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(p.h)) AS kept_sha256
FROM sized s JOIN parts p USING (doc_id) LEFT JOIN told USING (doc_id)"""
