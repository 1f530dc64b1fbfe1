"""The model, its losses and gradients, ranking and batches on literal values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cucurbit.functions import chem, sparse
from cucurbit.operators import bins, labels, losses, metrics, model, ranking, training, vectors
from cucurbit.types import Losses, Model, Preprocessing, QualityFilter

CONFIG = Model(fingerprint_size=12, descriptor_width=3, latent_width=4, hidden_widths=(6, 5), bit_frequencies=tuple([0.25] * 12), losses=Losses(min_gap=0.0, candidates=2))


def batch(n=5, seed=0):
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, 12)) < 0.4, np.log1p(r.integers(1, 9, (n, 12))), 0.0)
    who = [[int(j) for j in r.permutation([k for k in range(n) if k != i])[:2]] for i in range(n)]
    return x, r.normal(size=(n, 3)), (who, r.integers(0, 2, n).tolist(), r.random(n))


@pytest.mark.parametrize("off", [(), ("bce_weight",), ("descriptor_weight", "ranking_weight"), ("bce_weight", "descriptor_weight", "ranking_weight")])
def test_gradients_of_all_terms(off):
    """By differences of the total loss, a few entries of each array."""
    from dataclasses import replace

    config = replace(CONFIG, losses=replace(CONFIG.losses, **dict.fromkeys(off, 0.0)))
    w = {k: v.astype(np.float64) for k, v in model.initial_weights(config, 3).items()}
    x, d, labels = batch()
    told, grads = model.batch_losses(w, x, d, labels, config)
    assert told["total"] == pytest.approx(sum(told[t] for t in model.TERMS))
    for term, name in (("bce", "bce_weight"), ("descriptor", "descriptor_weight"), ("ranking", "ranking_weight")):
        assert (told[term] == 0) == (name in off)
    r = np.random.default_rng(1)
    for k, g in grads.items():
        for _ in range(4):
            at = tuple(int(r.integers(0, s)) for s in w[k].shape)
            sides = []
            for step in (1e-6, -1e-6):
                moved = w | {k: w[k].copy()}
                moved[k][at] += step
                sides.append(model.batch_losses(moved, x, d, labels, config, gradients=False)[0]["total"])
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=2e-6), (k, at)


def test_ranking_literals():
    c = Losses(latent_temperature=0.1, min_gap=0.0)
    latent = np.array([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]])
    gap = np.array([0.8, 0.0, 0.0])
    one = model._ranking(latent, [[1, 2]] * 3, [0, 0, 0], gap, c)
    two = model._ranking(latent, [[2, 1]] * 3, [0, 0, 0], gap, c)
    assert one[0] < two[0] and (one[1], two[1]) == (1.0, 0.0) and one[2] == two[2] == 1
    assert model._ranking(latent, [[1, 2]] * 3, [0, 0, 0], np.array([0.001, 0, 0]), Losses(min_gap=0.01))[:3] == (0.0, 0.0, 0)
    assert model._ranking(latent[:2], [[1], [0]], [0, 0], gap[:2], c)[:3] == (0.0, 0.0, 0)
    assert model._ranking(latent, [[1, 2]] * 3, [0, 0, 0], np.array([0.8, 0.5, 0.5]), Losses(pairs_per_batch=1))[2] == 1


def tables(spark, z, q):
    """Long tables of target and predicted log counts."""
    a = [(i, j, float(v)) for i, row in enumerate(z) for j, v in enumerate(row) if v > 0]
    p = [(i, j, float(v)) for i, row in enumerate(q) for j, v in enumerate(row)]
    return spark.createDataFrame(a, "row_id int, idx int, target_log double"), spark.createDataFrame(p, "row_id int, idx int, pred double")


def test_dense_views(spark):
    """Unsorted and repeated entries, none, and some outside the width."""
    rows = [([5, 0, 2], [7, 1, 3]), ([], []), ([3, 3, 1], [4, 9, 2]), ([0, 7], [5, 6]), ([8, -1, 4], [1, 1, 2])]
    frame = spark.createDataFrame(rows, "indices array<int>, counts array<int>")
    i, c = F.col("indices"), F.col("counts")
    got = frame.select(sparse.dense_counts(i, c, 8).alias("d"), sparse.dense_log_counts(i, c, 8).alias("l"), sparse.pairs_sorted(i, c).alias("p")).collect()
    for (indices, counts), r in zip(rows, got, strict=True):
        want = [0] * 8
        for k, n in zip(indices, counts, strict=True):
            if 0 <= k < 8:
                want[k] = n
        assert r.d == want and r.l == pytest.approx([math.log1p(x) for x in want])
        assert [tuple(p) for p in r.p] == sorted(zip(indices, counts, strict=True))
    wide = spark.range(1).select(F.array(F.lit(4095), F.lit(7)).alias("i"), F.array(F.lit(2), F.lit(1)).alias("c")).select(sparse.dense_counts(F.col("i"), F.col("c")).alias("d")).first().d
    assert len(wide) == 4096 and wide[7] == 1 and wide[4095] == 2 and sum(wide) == 3


def test_loss_literals(spark):
    got = lambda frame: frame.first().loss
    z, q = [[1.1, 0, 0.7, 0], [0, 0.3, 0, 0]], [[0.5, 0.4, -0.2, -1.0], [0.2, 1.9, 0.0, -0.3]]
    c = Losses(huber_beta=0.7)
    a, p = tables(spark, z, q)
    assert got(losses.huber_sparse(losses.in_rows(a, p), c)) == pytest.approx(got(losses.huber_dense(a, p, c)), abs=1e-6)
    a, p = tables(spark, [[0, 0, 0, 1.0]], [[-3.0, -0.1, -2.0, 1.0]])
    assert got(losses.huber_dense(a, p, Losses(huber_zero=1.0, huber_active=0.0))) == 0
    a, p = tables(spark, [[1.0, 0, 0, 0]], [[1.0, 0.4, 0.4, 0.4]])
    assert got(losses.huber_dense(a, p, Losses(huber_zero=1.0))) == pytest.approx(0.06)
    a, p = tables(spark, [[1.0, 0]], [[-1.0, 1.0]])
    w = spark.createDataFrame([(0, 3.0, 11.0), (1, 7.0, 5.0)], "idx int, w_pos double, w_neg double")
    assert got(losses.bce_sparse(losses.in_rows(a, p), Losses(bce_zero=1.0), w)) == pytest.approx((3 + 5) * (math.log1p(math.exp(1)) - math.log(2)) / 2)
    a, p = tables(spark, [[1.0, 0]], [[-2.0, -5.0]])
    assert got(losses.bce_sparse(losses.in_rows(a, p), Losses())) == pytest.approx((math.log1p(math.exp(2)) - math.log(2)) / 2, abs=1e-6)
    parts = spark.createDataFrame([(1.0, 0.3, 0.2, 0.4), (1.0, None, None, None)], "reconstruction double, bce double, descriptor double, ranking double")
    assert [round(r.total, 9) for r in losses.total_loss(parts).collect()] == [1.9, 1.0]


def test_a_bin_that_only_the_target_has(spark):
    a = spark.createDataFrame([(1, 5, 0.5)], "row_id int, idx int, target_log double")
    p = spark.createDataFrame([(1, 0, 0.25)], "row_id int, idx int, pred double")
    assert sorted(map(tuple, losses.joined(a, p).collect())) == [(1, 0, 0.25, 0.0), (1, 5, 0.0, 0.5)]


def test_composed_terms_can_be_off(spark):
    a, p = tables(spark, [[1.0, 0]], [[-1.0, 1.0]])
    d = spark.createDataFrame([([1.0], [0.0])], "predicted array<double>, target array<double>")
    ranked = spark.createDataFrame([(2.0,), (4.0,)], "loss double")
    every = losses.composed_loss(losses.in_rows(a, p), d, ranked, Losses()).first()
    assert every.descriptor == pytest.approx(0.05) and every.ranking == pytest.approx(0.3) and every.total == pytest.approx(every.reconstruction + every.bce + 0.35)
    off = losses.composed_loss(losses.in_rows(a, p), d, ranked, Losses(bce_weight=0, descriptor_weight=0, ranking_weight=0)).first()
    assert (off.bce, off.descriptor, off.ranking) == (0, 0, 0) and off.total == pytest.approx(every.reconstruction)


def test_metric_literals(spark):
    lit = lambda v: F.array(*(F.lit(float(x)) for x in v))
    ints = lambda v: F.array(*(F.lit(x) for x in v)).cast("array<int>")
    got = spark.range(1).select(
        sparse.dense_count_tanimoto(lit([2, 0, 1]), lit([1, 3, 1])).alias("third"),
        sparse.dense_count_tanimoto(lit([0, 0]), lit([0, 0])).alias("none"),
        sparse.log_count_tanimoto(lit([2, 0, 1, 0]), lit([math.log(2), math.log(2), 0, -1])).alias("quarter"),
        sparse.log_log_tanimoto(lit([math.log(3), 0]), lit([math.log(2), -1.0])).alias("half"),
        sparse.dense_binary_tanimoto(lit([1, 0, 1]), lit([1, 2, -1])).alias("bits"),
        sparse.dense_binary_tanimoto(lit([0.0]), lit([-1.0])).alias("no_bits"),
        sparse.log_mse(lit([1, 2]), lit([0, 4])).alias("mse"),
        sparse.count_tanimoto(ints([1, 1, 2]), ints([2, 3, 1]), ints([1, 1]), ints([9, 2])).alias("repeated"),
        sparse.count_tanimoto(ints([]), ints([]), ints([]), ints([])).alias("empty"),
        sparse.count_tanimoto(ints([1, 3]), ints([2, 1]), ints([1, 4]), ints([1, 1])).alias("pair"),
    ).first()
    assert got.third == pytest.approx(1 / 3) and got.none == 1 and got.quarter == pytest.approx(0.25) and got.half == pytest.approx(0.5)
    assert got.bits == pytest.approx(1 / 3) and got.no_bits == 1 and got.mse == 2.5 and got.empty == 1 and got.pair == pytest.approx(0.25)
    assert got.repeated == pytest.approx(4 / (6 + 11 - 4))


def test_sampled_steps(spark):
    """Steps are counted over all epochs: of two epochs of ten batches, and each fifth, 1, 5 and 10 and then 15 and 20, not 11."""
    rows = spark.createDataFrame([((s - 1) // 10, s, float(s)) for s in range(1, 21)], "epoch int, step int, loss double")
    taken = lambda n: [r.step for r in rows.where(metrics.sampled(F.col("step"), n)).orderBy("step").collect()]
    assert taken(5) == [1, 5, 10, 15, 20] and taken(0) == [1] and taken(1) == list(range(1, 21))
    got = {r.epoch: (r["mean"], r.batches, r.loss_batches) for r in metrics.epoch_means(rows, 5).collect()}
    assert got == {0: (pytest.approx(16 / 3), 10, 3), 1: (17.5, 10, 2)}
    assert [training.sampled(s, 5) for s in (1, 2, 5, 11, 15)] == [True, False, True, False, True] and not training.sampled(5, 0)
    assert metrics.row_estimates(1001, 100) == (901, 100) and metrics.row_estimates(10, 2000) == (0, 10)
    assert metrics.examples_per_second(10, 0) == 0 and metrics.examples_per_second(10, 2) == 5 and metrics.millis_per_batch(1, 0) == 0 and metrics.millis_per_batch(2, 4) == 500


def test_candidates_of_five(spark):
    rows = [([1, 3], [2, 1]), ([1, 3], [2, 1]), ([2], [5]), ([1, 4], [1, 1]), ([3, 4], [1, 2])]
    frame = spark.createDataFrame([(0, k, k, i, c) for k, (i, c) in enumerate(rows)], "batch_id int, row int, id int, indices array<int>, counts array<int>")
    drawn = ranking.with_candidates(frame, 12345, 4, 5)
    assert [r.candidates for r in drawn.orderBy("row").collect()] == [[3, 2, 1, 4], [3, 2, 0, 4], [1, 0, 4, 3], [2, 4, 0, 1], [1, 2, 3, 0]]
    best = {r.anchor: (r.best_pos, r.best_score) for r in ranking.top2(ranking.candidate_scores(drawn)).collect()}
    assert best[0] == (2, 1.0) and best[1] == (2, 1.0)


def walk(seed, n, k, anchor):
    """The same candidates, step by step."""
    p, state = n - 1, (seed & 0xFFFFFFFF) ^ ((anchor + 1) * ranking.ANCHOR_FACTOR & 0xFFFFFFFF) or ranking.STATE_FOR_ZERO
    drawn = []
    for _ in range(2):
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        drawn.append(state % p)
    stride = drawn[1] + 1
    while math.gcd(stride, p) != 1:
        stride = stride % p + 1
    return [c + (c >= anchor) for c in ((drawn[0] + i * stride) % p for i in range(k))]


def test_candidates_of_a_large_batch(spark):
    n = 24_576 - 2  # 24573 = 3 * 8191 others
    frame = spark.range(n).select(F.lit(0).alias("batch_id"), F.col("id").cast("int").alias("row"))
    got = {r.row: r.candidates for r in ranking.with_candidates(frame, 7, 32, n).where("row % 997 = 0").collect()}
    assert all(got[a] == walk(7, n, 32, a) for a in got) and len(got) == 25
    for size in (31, 211, 2311):  # one more than 30, 210 and 2310, with three to five prime factors
        frame = spark.range(size).select(F.lit(0).alias("batch_id"), F.col("id").cast("int").alias("row"))
        assert all(r.candidates == walk(99, size, 8, r.row) for r in ranking.with_candidates(frame, 99, 8, size).collect())
    small = spark.range(2).select(F.lit(0).alias("batch_id"), F.col("id").cast("int").alias("row"))
    assert [r.candidates for r in ranking.with_candidates(small, 1, 8, 2).collect()] == [[], []]
    assert ranking.ranking_seed(2, 1) == 2 << 32 ^ ranking.SEED_FACTOR


def test_split_batches(spark):
    rows = [(s, k, "validation" if k % 4 == 0 else "train") for s, n in ((0, 10), (1, 3), (2, 9)) for k in range(n)]
    frame = spark.createDataFrame(rows, "shard int, k int, split string")
    # 3 rows of 750 a thousand: plans of 4 source rows, three in shard 0, one in 1, three in 2.
    got = {(r.shard, r.k): (r.batch_id, r.row) for r in ranking.split_batches(frame, "shard", "k", "train", 3, 250).collect()}
    assert set(got) == {(s, k) for s, k, split in rows if split == "train"}
    assert got[(0, 1)] == (0, 0) and got[(0, 5)] == (1, 0) and got[(0, 9)] == (2, 0) and got[(1, 2)] == (3, 1) and got[(2, 1)] == (4, 0)
    limited = {r.batch_id for r in ranking.split_batches(frame, "shard", "k", "train", 3, 250, 2).collect()}
    assert limited == {0, 1}
    with pytest.raises(ValueError):
        ranking.split_batches(frame, "shard", "k", "validation", 3, 0)


def test_sequential_batches(spark):
    keys = [3, 5, 8, 1000, 1001, 70_000, 70_001, 9_000_000]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    got = ranking.sequential_batches(frame, ["k"], 3, F.floor(F.col("k") / 4)).orderBy("k").collect()
    assert [r.batch_id for r in got] == [0, 0, 0, 1, 1, 1, 2, 2]
    assert ranking.sequential_batches(frame, ["k"], 3, F.floor(F.col("k") / 4), 1).count() == 3
    assert ranking.sequential_batches(frame.where("false"), ["k"], 3, F.floor(F.col("k") / 4)).count() == 0


def test_small_batches_get_zeros(spark):
    batches = spark.createDataFrame([(0,), (1,)], "batch_id int")
    logits = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 1.0)], "batch_id int, anchor int, pos int, logit double")
    labels = spark.createDataFrame([(0, 0, 0, 0.5)], "batch_id int, anchor int, best_pos int, top2_gap double")
    got = {r.batch_id: (round(r.loss, 6), r.accuracy, r.valid_pairs) for r in ranking.ranking_loss(logits, labels, batches=batches).collect()}
    assert got == {0: (round(math.log1p(math.exp(-1)), 6), 1.0, 1), 1: (0.0, 0.0, 0)}
    off = ranking.weighted_ranking(batches, logits, labels, 0.0).collect()
    assert sorted((r.batch_id, r.loss, r.accuracy, r.valid_pairs) for r in off) == [(0, 0.0, 0.0, 0), (1, 0.0, 0.0, 0)]
    on = {r.batch_id: r.loss for r in ranking.weighted_ranking(batches, logits, labels, 2.0).collect()}
    assert on[0] == pytest.approx(2 * math.log1p(math.exp(-1)))


def labelled_batches(spark):
    """Three batches of 20, 20 and 13 rows, with labels."""
    rows = vectors.to_arrays(spark.range(53).select("id", F.explode(F.array(F.col("id") % 5, 5 + F.col("id") % 3, 8 + F.col("id") % 4)).alias("i")).select("id", F.col("i").cast("int").alias("idx"), (F.col("id") % 3 + 1).cast("int").alias("cnt")))
    planned = ranking.planned_batches(rows, "id", 20).withColumn("descriptor_targets", F.array(F.lit(0.5), (F.col("id") % 2).cast("double"), F.lit(1.0)))
    return labels.labelled(labels.with_steps(planned), 1, 2)


def one_process(frame, weights, epochs, noise, rate=0.02):
    """The same steps in a loop over whole batches."""
    optimizer, told = training.Adam(rate), []
    for _ in range(epochs):
        for _, own in frame.toPandas().sort_values(["batch_id", "row"]).groupby("batch_id"):
            x, d, marks = model._one(own, CONFIG, np.float32)
            extra = training.noise_of(CONFIG, optimizer.steps + 1, len(own)) if noise else None
            measures, grads = model.batch_losses(weights, x, d, marks, CONFIG, extra)
            weights = optimizer.step(weights, grads)
            told.append(measures)
    return weights, optimizer, told


@pytest.mark.parametrize(("replicas", "noise"), [(1, True), (2, True), (3, False)])
def test_training_steps_by_batch(spark, replicas, noise):
    frame = labelled_batches(spark).cache()
    state, history = training.train(frame, CONFIG, 2, 0.02, seed=1, noise=noise, replicas=replicas, every=2)
    weights, optimizer, told = one_process(frame, model.initial_weights(CONFIG, 1), 2, noise)
    assert state.steps == optimizer.steps == 6
    for kind, want in (("weights", weights), ("first", optimizer.first), ("second", optimizer.second)):
        got = model.load_weights(state.table, kind)
        assert set(got) == set(want) and all(np.abs(got[k] - want[k]).max() < 1e-5 for k in want), kind
    # Steps 1 and 2 of the first epoch, 4 and 6 of the second.
    assert [h["sampled"] for h in history] == [2, 2] and [h["batches"] for h in history] == [3, 3]
    for h, taken in zip(history, ((0, 1), (3, 5)), strict=True):
        for m in model.METRICS:
            assert h[m] == pytest.approx(np.mean([told[k][m] for k in taken]), rel=1e-4, abs=1e-6), m
    assert history[0]["valid_pairs"] > 0


def test_training_goes_on_from_a_checkpoint(spark, tmp_path):
    frame = labelled_batches(spark).cache()
    whole, _ = training.train(frame, CONFIG, 3, 0.02, seed=1, noise=True, replicas=2)
    state, _ = training.train(frame, CONFIG, 2, 0.02, seed=1, noise=True, replicas=2)
    training.save_checkpoint(spark, f"{tmp_path}/run", CONFIG, state, {"completed_epoch": 2})
    config, state, more = training.load_checkpoint(spark, f"{tmp_path}/run")
    assert config == CONFIG and state.steps == 6 and more["completed_epoch"] == 2
    state, history = training.train(frame, config, 1, 0.02, state=state, noise=True, replicas=3)
    a, b = state.weights(), whole.weights()
    assert state.steps == 9 and all(np.abs(a[k] - b[k]).max() < 1e-5 for k in b)


def test_training_falls_and_evaluates(spark):
    frame = labelled_batches(spark).cache()
    _, told = training.train(frame, CONFIG, 6, 0.02, seed=1)
    assert told[-1]["total"] < told[0]["total"]
    weights = model.initial_weights(CONFIG, 1)
    by_batch = model.losses_by_batch(frame, weights, CONFIG)
    assert sorted((r.batch_id, r.rows) for r in by_batch.collect()) == [(0, 20), (1, 20), (2, 13)]
    found = model.evaluate(frame, weights, CONFIG)
    own = frame.toPandas().sort_values(["batch_id", "row"]).groupby("batch_id")
    assert found["total"] == pytest.approx(np.mean([model.batch_losses(weights, *model._one(b, CONFIG, np.float32), CONFIG)[0]["total"] for _, b in own]), rel=1e-5)
    assert model.evaluate(frame.where("false"), weights, CONFIG) is None
    state, none = training.train(frame.where("false"), CONFIG, 1, 0.02, replicas=2)
    assert state.steps == 0 and none == [{"batches": 0, "sampled": 0}]
    # Noise moves the reconstruction alone.
    one = frame.where("batch_id = 0").toPandas().sort_values("row")
    x, d, marks = model._one(one, CONFIG, np.float32)
    quiet, noisy = (model.batch_losses(weights, x, d, marks, CONFIG, extra)[0] for extra in (None, training.noise_of(CONFIG, 5, 20)))
    assert noisy["descriptor"] == quiet["descriptor"] and noisy["ranking"] == quiet["ranking"] and noisy["reconstruction"] != quiet["reconstruction"]


def test_rows_without_a_batch_are_left_out(spark):
    frame = labelled_batches(spark)
    more = frame.unionByName(frame.where("batch_id = 0").withColumn("batch_id", F.lit(None).cast("long")))
    got = model.losses_by_batch(more, model.initial_weights(CONFIG, 1), CONFIG).collect()
    assert sorted((r.batch_id, r.rows) for r in got) == [(0, 20), (1, 20), (2, 13)]


def test_sparse_rows_equal_dense_ones():
    r = np.random.default_rng(2)
    x = np.where(r.random((9, 30)) < 0.3, r.random((9, 30)), 0.0)
    x[4] = 0
    own, w, g = bins.Bins.of_dense(x), r.normal(size=(30, 7)), r.normal(size=(9, 7))
    for cells in (7, 50, 1 << 22):
        bins.CELLS = cells
        assert np.allclose(own.times(w), x @ w) and np.allclose(own.back(g), x.T @ g)
    rows = bins.Bins.of([[3, 1, 3], [], [0]], [[1, 2, 5], [], [7]], 4, np.float64)
    assert rows.row.tolist() == [0, 0, 2] and rows.bin.tolist() == [1, 3, 0] and np.allclose(rows.value, [np.log(3), np.log(2) + np.log(6), np.log(8)])
    q = r.normal(size=(9, 30))
    t, c = np.expm1(x), np.maximum(np.expm1(q), 0)
    count, binary = model.similarities(own, q)
    high, union = np.maximum(t, c).sum(1), ((x > 0) | (q > 0)).sum(1)
    assert np.allclose(count, np.minimum(t, c).sum(1) / high) and np.allclose(binary, ((x > 0) & (q > 0)).sum(1) / union)
    assert np.allclose(model.squared_errors(own, q), ((x - q) ** 2).mean(1))


def test_labels_in_one_pass(spark):
    """Candidates as the expressions draw them, and similarities and best ones as a join finds them."""
    rows = [(b, k, 100 * b + k, [(7 * k + j) % 23 for j in range(k % 4)], [1 + (k + j) % 5 for j in range(k % 4)]) for b, n in ((0, 31), (1, 2), (2, 17)) for k in range(n)]
    frame = spark.createDataFrame(rows, "batch_id int, row int, id int, indices array<int>, counts array<int>")
    frame = frame.withColumn("pairs", F.array_sort(F.arrays_zip("indices", "counts"))).select("batch_id", "row", "id", F.col("pairs.indices").alias("indices"), F.col("pairs.counts").alias("counts"))
    got = {(r.batch_id, r.row): r for r in labels.labelled(labels.with_steps(frame, 40), 3, 8).collect()}
    assert len(got) == len(rows) and {r.step for r in got.values()} == {40, 41, 42}
    for b, n in ((0, 31), (1, 2), (2, 17)):
        seed = ranking.ranking_seed(3, 40 + b)
        drawn = ranking.with_candidates(frame.where(F.col("batch_id") == b), seed, 8, n)
        assert all(got[b, r.row].candidates == r.candidates for r in drawn.collect())
        for r in ranking.top2(ranking.candidate_scores(drawn)).collect():
            assert got[b, r.anchor].best_pos == r.best_pos and got[b, r.anchor].top2_gap == pytest.approx(r.top2_gap)


def test_weights_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(model, "BLOCK", 7)
    table, w = model.weight_table(spark, CONFIG), model.initial_weights(CONFIG)
    assert table.count() > len(w)
    again = model.load_weights(table)
    assert set(again) == set(w) and all((again[k] == w[k]).all() for k in w)


def test_noise(spark):
    entries = spark.createDataFrame([(0, r, i, float(r * (i + 1))) for r in range(4) for i in range(2)], "batch_id int, row_id int, i int, x double")
    scale = model.noise_scale(entries).first().scale
    want = np.array([[r * (i + 1) for i in range(2)] for r in range(4)], float)
    assert scale == pytest.approx(math.sqrt(((want - want.mean(0)) ** 2).mean() + 1e-6))
    assert model.latent_noise(entries, 0.0).collect() == entries.collect()
    many = spark.range(20_000).select(F.lit(0).alias("batch_id"), "id", F.lit(0).alias("i"), (F.col("id") % 2).cast("double").alias("x"))
    moved = model.latent_noise(many, 0.1, 3).join(many.withColumnRenamed("x", "y"), "id").agg(F.stddev(F.col("x") - F.col("y"))).first()[0]
    assert moved == pytest.approx(0.05, rel=0.05)


def test_configurations():
    assert Model.from_json(CONFIG.to_json()) == CONFIG
    for old in ("margin", "tanimoto_ranking_margin"):
        assert Model.from_json(f'{{"tanimoto_ranking": {{"{old}": 0.2}}}}').losses.latent_temperature == 0.2
    assert Model.from_json("{}") == Model() and Model(hidden_widths=(3, 2)).decoder_widths == (2, 3)
    other = Model(hidden_widths=(3, 2), decoder_widths=(5,))
    assert Model.from_json(other.to_json()) == other
    with pytest.raises(ValueError):
        Model.from_json('{"encoder": {"latent_width": 4}, "decoder": {"latent_width": 5}}')
    for bad in (dict(hidden_widths=()), dict(latent_width=0), dict(ecfp_radius=0), dict(latent_noise_std=-1.0), dict(fingerprint_size=2, bit_frequencies=(0.5,)), dict(fingerprint_size=1, bit_frequencies=(1.5,))):
        with pytest.raises(ValueError):
            Model(**bad)
    for bad in (dict(huber_beta=0), dict(latent_temperature=math.inf), dict(bce_weight=-1), dict(candidates=1), dict(min_gap=math.nan)):
        with pytest.raises(ValueError):
            Losses(**bad)
    Losses(candidates=1, ranking_weight=0)
    for bad in (dict(radius=0), dict(fingerprint_size=0), dict(fingerprint_size=65537), dict(validation_permille=1001)):
        with pytest.raises(ValueError):
            Preprocessing(**bad)
    for bad in (dict(min_heavy_atoms=3, max_heavy_atoms=2), dict(min_mass=-1.0), dict(max_mass=math.nan), dict(max_components=0)):
        with pytest.raises(ValueError):
            QualityFilter(**bad)
    assert not QualityFilter().active and QualityFilter(min_charge=0).active


# -- molecules ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("element", list(chem.WEIGHTS))
def test_every_element(element):
    assert chem.parse(f"[{element}]")["atoms"][0]["element"] == element
    assert len(chem.WEIGHTS) == 118


def test_ring_labels_and_repeated_bonds():
    assert chem.parse("C%(123)CCC%(123)")["ring_bonds"] == 4 and chem.parse("C%12CCC%12")["ring_bonds"] == 4
    for n in (10, 70, 400):
        with pytest.raises(ValueError):
            chem.parse(f"C1C({'C' * n})1")


def test_mass_is_a_fold_of_32_bits(spark):
    """An atom's hydrogens are added before it."""
    smiles = ["CCO", "CC(=O)Oc1ccccc1C(=O)O", "CCN(CC)CC" * 9, "[U]CCCl", "[2H]C"]
    got = spark.createDataFrame([(s,) for s in smiles], "s string").select(chem.molecule_graph(F.col("s")).alias("g")).select(chem.descriptors(F.col("g")).alias("d")).collect()
    for s, r in zip(smiles, got, strict=True):
        m, h = np.float32(0), np.float32(chem.WEIGHTS["H"])
        for a in chem.parse(s)["atoms"]:
            m = np.float32(np.float32(m + np.float32(a["hydrogens"]) * h) + np.float32(chem.WEIGHTS[a["element"]]))
        assert np.float32(r.d.molecular_mass).tobytes() == m.tobytes(), s


def test_fingerprints(spark):
    frame = spark.createDataFrame([("CCO",), ("OCC",), ("c1ccccc1",), ("(",)], "s string").withColumn("graph", chem.molecule_graph(F.col("s")))
    got = [r.fingerprint for r in chem.counted_fingerprint(frame, radius=2, size=256).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None
    assert sum(got[2].counts) == 18 and len(got[2].indices) == 3 and all(0 <= i < 256 for i in got[2].indices)
    for bad in (dict(radius=0), dict(radius=256), dict(size=0), dict(size=65537)):
        with pytest.raises(ValueError):
            chem.counted_fingerprint(frame, **bad)
