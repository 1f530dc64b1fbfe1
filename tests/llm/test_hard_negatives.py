"""Hard negatives against brute force, on the smallest table and vectors made to be awkward."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cucurbit.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, id long, vec string, a long"


def brute(rows, every=50):
    """rows: vec_id, embedding, label.  Rows of the result by Python's whole numbers."""
    kept = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in kept if j != i)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            near = [(-s, j) for s, j, other in scored if other != label and -50 * p <= -100 * s <= -95 * p][:3]
            out += [(i, positive, k, j, -p, s) for k, (s, j) in enumerate(near, 1)]
    return sorted(out)


def result(frame):
    return sorted(map(tuple, frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def awkward():
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    rows = [(k, [c + r.gauss(0, 0.3) for c in centres[r.randrange(7)]], r.randrange(4)) for k in range(700)]
    same = [0.5, -0.25, 1.0, 0.0, 0.0, 2.0]
    rows += [(1000 + k, same, k % 3) for k in range(350)]  # a third of all rows
    rows += [(2000 + 10 * k, [float(x) for x in r.choices([-1, 0, 1], k=6)], k % 2) for k in range(60)]  # many ties
    rows += [(None, same, 1), (3000, None, 1), (3050, same, None), (3100, [math.nan] + same[1:], 1), (3150, [math.inf] + same[1:], 1), (3200, [None] + same[1:], 1)]
    rows += [(3250, [], 1), (3300, [1.0, 2.0], 1), (3350, [0.0] * 6, 2), (3400, same, 9), (3400, same[::-1], 9), (3450, same, 77), (-50, same, 2)]
    return rows + [rows[0], rows[50], rows[1000]]


@pytest.mark.parametrize("tile, width", [(4096, 8), (16, 1)])
def test_brute_force(spark, monkeypatch, tile, width):
    monkeypatch.setattr(hn, "TILE", tile)
    monkeypatch.setattr(hn, "WIDTH", width)
    docs = spark.createDataFrame([(*x, 5, "v", None) for x in awkward()], SCHEMA)
    rows = hn.usable(docs)
    found = hn.hard_negatives(rows, F.col("id") % 50 == 0)
    assert result(found) == brute(awkward())


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label if r.vec_id % 7 else (r.label + 1) % 10) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(hn.op11_hard_negatives(spark, sf_dir)) == brute(rows)


def test_empty(spark):
    rows = hn.usable(spark.createDataFrame([], SCHEMA))
    assert hn.hard_negatives(rows, F.col("id") % 50 == 0).count() == 0


def test_large_components(spark):
    rows = [(k, [float((k * 37) % 101) * 1e4, float((k * 17) % 89) * 1e4], k % 2) for k in range(150)]
    usable = hn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert result(hn.hard_negatives(usable, F.col("id") % 50 == 0)) == brute(rows)


def test_bounds_hold_and_skip(spark, monkeypatch):
    """All scores lie within the bounds of their interval, and near clusters rule others out."""
    monkeypatch.setattr(hn, "TILE", 16)
    index = hn.build(hn.usable(spark.createDataFrame([(*x, 5, "v", None) for x in awkward()], SCHEMA)))
    held = {}
    for t in index.tiles.collect():
        held.setdefault(t.interval, []).append(np.frombuffer(t.vecs, "<i8").reshape(len(t.ids), index.width))
    skipped = 0
    for vec in (x for parts in held.values() for x in parts[0][:2]):
        least, most, _, _ = index.directory.bounds(vec)
        for k, name in enumerate(index.directory.names):
            scores = hn.dot(vec[None], np.concatenate(held[name]))[0]
            assert least[k] <= scores.min() and scores.max() <= most[k]
        kth = np.sort(np.concatenate([hn.dot(vec[None], np.concatenate(p))[0] for p in held.values()]))[-5]
        skipped += len(index.directory.names) - len(index.directory.plan(vec, [hn.HIGH], [int(kth)], 0, 10_000)[0])
    assert skipped > 0
