"""Operator 11: hard negatives by an exact search over one-dimensional distance keys.

Components become whole numbers, so a score, the inner product, is one too.  With one more component,
sqrt(M - norm) for the largest norm M (0 for an anchor), the rows of the highest score are the
nearest: distance**2 = anchor's norm + M - 2 * score.

1. ``PIVOTS`` rows are pivots (a bounded sample by hash: it sets how much is skipped, never what is
   found).  Each row's key is its nearest pivot and the distance to it.  Rows are stored sorted by
   that key, as intervals of one pivot, in tiles of ``TILE`` vectors.
2. For an anchor, an interval of keys is an annulus around its pivot: by the triangle inequality it
   bounds the scores of all rows in it from both sides.  An anchor takes its intervals in order of
   the distance to be expected, first ``WIDTH`` of them and then more each round, and leaves those
   out whose bounds cannot reach what it has found.  It is done when no interval is left that
   could: what it has found is then certified.
3. The same search serves both questions: the best rows of the anchor's label, and for each of these
   positives the best rows of other labels in its range of scores.

Asks travel to the tiles, by tile; tasks hold a tile and a part of the asks at a time.  Of rows with
one label and one vector only the first by vec_id can be found, ``POSITIVES`` and one more (the
anchor's own): the rest of a large group of copies is left out of the index, exactly, before
anything is dealt out by vector.  All of them are asked for as anchors.

Defined results: rows with a null label, vector or vec_id, or a null or non-finite component take
no part; shorter vectors count as if zeros followed.  Rows equal in vec_id, label and vector count
once; an anchor's other rows are those of another vec_id.  Scores have to fit a long.  Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, parts, saved

POSITIVES, NEGATIVES = 5, 3
PIVOTS = 32
TILE = 4096
#: Ranges of the sorted keys; intervals are these and one more for each pivot at most.
RANGES = 4096
#: Intervals that an anchor takes first, and how many times as many in each round from then on.
WIDTH, GROWTH = 8, 4
#: Asks scored together.
ASKS = 256
LOW, HIGH = -(2**62), 2**62


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """id, label and vec (whole numbers) of the rows that take part, each once."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("vec")).distinct()


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones followed by zeros."""
    out = np.zeros((len(lists), width), np.int64)
    size = np.diff(lists.offsets.to_numpy())
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles where all sums fit, else in longs, else in Python's numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if most < 2**62 else (a.astype(object) @ b.T.astype(object)).astype(np.int64)


class Pivots:
    """Rows as centres, and M."""

    def __init__(self, vectors: np.ndarray, m: float):
        self.vectors, self.m = vectors, m
        self.floats = vectors.astype(np.float64)
        self.norms = (self.floats**2).sum(1)
        self.more = np.sqrt(np.maximum(m - self.norms, 0))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By row: the nearest pivot, and the distance to it with the added component."""
        x = x.astype(np.float64)
        norms = (x**2).sum(1)
        apart = norms[:, None] + self.norms - 2 * x @ self.floats.T + (np.sqrt(np.maximum(self.m - norms, 0))[:, None] - self.more) ** 2
        near = apart.argmin(1)
        return near, np.sqrt(np.maximum(apart[np.arange(len(x)), near], 0))


class Directory:
    """All intervals: pivot, least and largest key, and tiles."""

    def __init__(self, pivots: Pivots, intervals: list[tuple[int, int, float, float, int]]):
        self.pivots = pivots
        self.names = [i for i, *_ in intervals]
        self.pivot, self.low, self.high = (np.array([x[k] for x in intervals], kind) for k, kind in ((1, np.int64), (2, np.float64), (3, np.float64)))
        self.tiles = [x[4] for x in intervals]

    def bounds(self, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Of each interval, the least and the largest score that a row can have and the distance**2 to be expected; and the anchor's norm + M."""
        q = vec.astype(np.float64)
        both = float((q**2).sum()) + self.pivots.m
        away = np.sqrt(np.maximum(both - 2 * self.pivots.floats @ q, 0))[self.pivot]
        near = np.maximum(np.maximum(away - self.high, self.low - away), 0)
        # Roundings of distances are far below this share of a squared one.
        slack = 1 + 1e-9 * both
        middle = (self.low + self.high) / 2
        return (both - (away + self.high) ** 2) / 2 - slack, (both - near**2) / 2 + slack, away**2 + middle**2, both

    def plan(self, vec: np.ndarray, uppers: list[int], floors: list[int], taken: int, width: int) -> tuple[list[int], bool]:
        """The next intervals to scan, of ``width`` in the anchor's order, and whether others are needed after them."""
        least, most, expected, both = self.bounds(vec)
        if not uppers:
            return [], False
        target = max(both - 2 * max(uppers), 0)
        order = np.argsort(np.abs(expected - target), kind="stable")
        wanted = np.zeros(len(order), bool)
        for upper, floor in zip(uppers, floors, strict=True):
            wanted |= (most >= floor) & (least <= upper)
        left = order[taken:]
        left = left[wanted[left]]
        now = set(order[taken : taken + width].tolist())
        return [int(k) for k in left if k in now], any(int(k) not in now for k in left)


class Index:
    """Tiles (a saved table) and their directory; ``width`` components."""

    def __init__(self, tiles: DataFrame, directory: Directory, width: int):
        self.tiles, self.directory, self.width = tiles, directory, width


def build(rows: DataFrame, copies: int = POSITIVES + 1) -> Index:
    """rows: id, label, vec.  The index over the first ``copies`` rows, by id, of each label and vector."""
    own = Window.partitionBy("label", "vec").orderBy("id")
    kept = saved(rows.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= copies).drop("__n"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    told = kept.agg(F.max(norm).alias("m"), F.max(F.size("vec")).alias("width"), F.count("*").alias("n")).first()
    width, m = told.width or 0, told.m or 0.0
    sample = [r.vec for r in kept.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(PIVOTS).collect()]
    pivots = Pivots(matrix(pa.array(sample, pa.list_(pa.int64())), width) if sample else np.zeros((0, width), np.int64), m)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 4096):
            pivot, key = shared.value.keys(matrix(b.column("vec"), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot, pa.int32()), pa.array(key)], names=[*b.schema.names, "pivot", "key"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, held = TaskContext.get().partitionId(), {}, []

        def tile(part: pa.Table) -> pa.RecordBatch:
            pivot, key = part["pivot"][0].as_py(), part["key"].to_numpy()
            name = at * PIVOTS + pivot
            numbers[name] = numbers.get(name, -1) + 1
            vec = matrix(part["vec"].combine_chunks(), width)
            row = {"interval": name, "tile": numbers[name], "pivot": pivot, "low": float(key.min()), "high": float(key.max()), "ids": part["id"].to_pylist(), "labels": part["label"].to_pylist(), "vecs": vec.astype("<i8").tobytes()}
            return pa.RecordBatch.from_pylist([row], TILES)

        for b in parts(batches, TILE):
            pivot = b.column("pivot").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                piece = b.slice(i, j - i)
                if held and (held[0].column("pivot")[0] != piece.column("pivot")[0] or sum(map(len, held)) + len(piece) > TILE):
                    yield tile(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
        if held:
            yield tile(pa.Table.from_batches(held))

    TILES = pa.schema([("interval", pa.int64()), ("tile", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vecs", pa.binary())])
    with_keys = saved(kept.mapInArrow(keyed, "id long, label long, vec array<long>, pivot int, key double"))
    forget(kept)
    ranged = with_keys.repartitionByRange(min(RANGES, -(-max(told.n, 1) // TILE)), "pivot", "key").sortWithinPartitions("pivot", "key")
    tiles = saved(ranged.mapInArrow(tiled, "interval long, tile int, pivot int, low double, high double, ids array<long>, labels array<long>, vecs binary"))
    forget(with_keys)
    told = tiles.groupBy("interval", "pivot").agg(F.min("low"), F.max("high"), F.count("*")).orderBy("interval").collect()
    return Index(tiles, Directory(pivots, [tuple(r) for r in told]), width)


ASK = "interval long, tile int, kind int, a long, id long, label long, vec array<long>, uppers array<long>, floors array<long>, ids array<long>, labels array<long>, vecs binary"


def best(labels: np.ndarray, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray, upper: int, floor: int, k: int) -> np.ndarray:
    """Rows of the first ``k`` scores from floor to upper, ties by id."""
    rows = np.flatnonzero(allowed & (scores >= floor) & (scores <= upper))
    if len(rows) > k:
        rows = rows[scores[rows] >= np.partition(scores[rows], -k)[-k]]
    return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]


def search(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """anchors: a (a key), id, label, vec, and uppers and floors, the bounds of its questions' scores.

    a, question (its place), place (1 on), id and score of the first ``k`` rows of the anchor's label,
    or of other labels, within each question's bounds.  A saved table.
    """
    shared = anchors.sparkSession.sparkContext.broadcast(index.directory)
    width_of = index.width

    def planned(taken: int, width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = shared.value
            for b in parts(batches, 64):
                rows, out = b.to_pylist(), []
                for r, vec in zip(rows, matrix(b.column("vec"), width_of), strict=True):
                    for i in d.plan(vec, r["uppers"], r["floors"], taken, width)[0]:
                        out += [r | {"interval": d.names[i], "tile": t, "kind": 1} for t in range(d.tiles[i])]
                for at in range(0, len(out), 2048):
                    yield pa.RecordBatch.from_pylist(out[at : at + 2048], ASKED)

        return run

    def unfinished(taken: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches, 256):
                rows = zip(b.column("uppers").to_pylist(), b.column("floors").to_pylist(), matrix(b.column("vec"), width_of), strict=True)
                yield b.filter(pa.array([shared.value.plan(vec, uppers, floors, taken, 0)[1] for uppers, floors, vec in rows], pa.bool_()))

        return run

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels, ids, vecs = None, None, None, None
        for b in parts(batches, ASKS):
            key = list(zip(b.column("interval").to_pylist(), b.column("tile").to_pylist(), b.column("kind").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                part = b.slice(i, j - i)
                if key[i][2] == 0:
                    own = key[i][:2]
                    ids, labels = (np.array(part.column(c)[0].as_py(), np.int64) for c in ("ids", "labels"))
                    vecs = np.frombuffer(part.column("vecs")[0].as_py(), "<i8").reshape(len(ids), width_of)
                    continue
                if own != key[i][:2]:
                    raise ValueError("a tile is missing")
                found: list[tuple] = []
                scores = dot(matrix(part.column("vec"), width_of), vecs)
                asked = zip(*(part.column(c).to_pylist() for c in ("a", "id", "label", "uppers", "floors")), strict=True)
                for row, (a, mine, label, uppers, floors) in zip(scores, asked, strict=True):
                    allowed = (labels == label) if same else (labels != label)
                    allowed &= ids != mine
                    for question, (upper, floor) in enumerate(zip(uppers, floors, strict=True)):
                        found += [(a, question, ids[x], row[x]) for x in best(labels, ids, row, allowed, upper, floor, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c), t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["a", "question", "id", "score"])

    ASKED = pa.schema([("interval", pa.int64()), ("tile", pa.int32()), ("kind", pa.int32()), ("a", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("vec", "uppers", "floors", "ids", "labels")), ("vecs", pa.binary())])
    first = Window.partitionBy("a", "question").orderBy(F.desc("score"), "id")
    tiles = index.tiles.select("interval", "tile", F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("a", "id", "label")), *(F.lit(None).cast("array<long>").alias(c) for c in ("vec", "uppers", "floors")), "ids", "labels", "vecs")
    state, found, taken, width = anchors, None, 0, WIDTH
    while True:
        asks = saved(state.mapInArrow(planned(taken, width), ASK))
        used = tiles.join(asks.select("interval", "tile").distinct(), ["interval", "tile"], "left_semi").select(*asks.columns)
        met = used.unionByName(asks).repartition("interval", "tile").sortWithinPartitions("interval", "tile", "kind").mapInArrow(scored, "a long, question int, id long, score long")
        more = met if found is None else met.unionByName(found.drop("place"))
        held = saved(more.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k))
        forget(asks, *([] if found is None else [found]))
        found, taken, width = held, taken + width, width * GROWTH
        if taken >= len(index.directory.names):
            return found
        # A question's floor is its last place's score, once that is filled.
        last = found.where(F.col("place") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("question", "score"))).alias("__last"))
        joined = anchors.join(last, "a", "left")
        floors = F.transform("floors", lambda x, i: F.coalesce(F.try_element_at("__last", i), x))
        raised = joined.withColumn("floors", F.when(F.col("__last").isNull(), F.col("floors")).otherwise(floors)).select(*anchors.columns)
        after = saved(raised.mapInArrow(unfinished(taken), anchors.schema))
        if state is not anchors:
            forget(state)
        state = after
        if state.isEmpty():
            return found


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """rows: id, label and vec, as ``usable`` gives them.  For each anchor and each of its positives, the negatives of half to 95 hundredths of the positive's score."""
    rows = saved(rows)
    index = build(rows, max(positives + 1, negatives))
    anchors = saved(rows.where(is_anchor).withColumn("a", F.monotonically_increasing_id()))
    whole = anchors.select("a", "id", "label", "vec", F.array(F.lit(HIGH)).alias("uppers"), F.array(F.lit(LOW)).alias("floors"))
    near = search(index, saved(whole), True, positives)
    score = F.col("score")
    # 95 hundredths of a score rounded down, and half of it rounded up, without large products; below 0 nothing is between them.
    asked = near.where("score >= 0").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", (score - F.expr("(score + 19) div 20")).alias("upper"), F.expr("score div 2 + score % 2").alias("floor"), F.col("id").alias("positive_id"), score.alias("positive_score")))).alias("asks"))
    asked = saved(anchors.join(asked, "a"))
    ranges = asked.select("a", "id", "label", "vec", F.col("asks.upper").alias("uppers"), F.col("asks.floor").alias("floors"))
    found = search(index, saved(ranges), False, negatives)
    own = asked.select("a", F.col("id").alias("anchor_id"), F.posexplode("asks").alias("question", "ask"))
    return found.select("a", "question", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(own, ["a", "question"]).select("anchor_id", "ask.positive_id", "rank", "negative_id", "ask.positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))).distinct()
    return hard_negatives(rows, F.col("id") % 50 == 0)


def oracle_sql() -> str:
    """DuckDB's SQL for the query."""
    return f"""
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), TRUE)),
scores AS (
  SELECT a.vec_id AS anchor_id, a.v AS own, a.label AS mine, b.vec_id AS id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, own, mine ORDER BY score DESC, id) AS place FROM scores WHERE label = mine) WHERE place <= {POSITIVES}),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.own, p.mine, p.place ORDER BY n.score DESC, n.id) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND n.own = p.own AND n.mine = p.mine AND n.label <> p.label
  WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {NEGATIVES}"""
