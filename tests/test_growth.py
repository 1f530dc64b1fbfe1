"""What a query moves between tasks, and over how many tasks its work is spread."""

import re

import pytest

from cucurbit.queries import QUERIES


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["log_mse_rows", "log_count_tanimoto", "sparse_vs_dense_tanimoto", "binary_tanimoto_sparse", "binary_tanimoto_dense", "log_log_tanimoto"])
def test_only_lines_travel(spark, sf_dir, name):
    """One exchange, of the lines; bins are neither exploded nor joined."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Generate" not in plan and "Join" not in plan


def test_dense_bins_are_paired_once(spark, sf_dir):
    """The arrays of a row are filled and paired once, not for each count over again."""
    plan = plan_of(QUERIES["binary_tanimoto_dense"](spark, sf_dir))
    assert plan.count("zip_with(") == 1 and plan.count("array_sort(") == 1


def test_evaluation_deals_rows_twice(spark, sf_dir):
    """Lines by order and orders by batch; then measures of batches, and one row."""
    plan = plan_of(QUERIES["evaluation"](spark, sf_dir))
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 3 and len(re.findall(r"\bExchange\b", plan)) == 4


@pytest.mark.parametrize("labelled", [False, True])
def test_batches_are_measured_together(monkeypatch, labelled):
    """Many small batches go through the model at once, wherever the stream is cut, and get what each gets for itself."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from cucurbit.operators import model
    from cucurbit.types import Losses, Model

    config = Model(fingerprint_size=16, descriptor_width=3, latent_width=4, hidden_widths=(6,), losses=Losses())
    w, draw, rows = {k: v.astype(np.float64) for k, v in model.initial_weights(config, 3).items()}, np.random.default_rng(5), []
    for batch, n in enumerate(draw.permutation([1, 2, 3, 7, 40] * 30).tolist()):
        for row in range(n):
            own = np.sort(draw.permutation(16)[: draw.integers(0, 6)]).tolist()
            # Every third batch has no labels.
            others = [k for k in range(n) if k != row][:4] if labelled and batch % 3 and n > 2 else []
            rows.append({"batch_id": batch, "row": row, "indices": own, "counts": draw.integers(1, 9, len(own)).tolist(), "descriptor_targets": draw.random(3).tolist(), "candidates": others, "best_pos": int(draw.integers(0, 2)), "top2_gap": float(draw.random())})
    kinds = {"batch_id": pa.int64(), "row": pa.int32(), "indices": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "descriptor_targets": pa.list_(pa.float64()), "candidates": pa.list_(pa.int32()), "best_pos": pa.int32(), "top2_gap": pa.float64()}
    table, frame = pa.Table.from_pylist(rows, pa.schema(list(kinds.items()))), pd.DataFrame(rows)
    want = [model.batch_losses(w, *model._one(b, config, np.float64), config, gradients=False)[0] for _, b in frame.groupby("batch_id")]
    assert any(r["ranking"] for r in want) == labelled
    for cut, most in ((17, 500), (1, 30), (10_000, 1), (10_000, 1 << 20)):
        passes, real = [], model.similarities
        monkeypatch.setattr(model, "similarities", lambda *a, real=real: passes.append(1) or real(*a))
        got = [r for part in model._whole(iter(table.to_batches(max_chunksize=cut)), most) for r in model._measured(w, part, config).to_pylist()]
        monkeypatch.setattr(model, "similarities", real)
        assert [r["batch_id"] for r in got] == list(range(150)) and [r["rows"] for r in got] == frame.groupby("batch_id").size().tolist()
        assert len(passes) <= len(rows) / most + 1
        for g, x in zip(got, want, strict=True):
            assert {m: g[m] for m in model.METRICS} == pytest.approx({m: x[m] for m in model.METRICS}, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("name", ["grammar_descriptors", "smiles_descriptors", "regression_targets", "ecfp_fingerprints"])
def test_molecules_are_spread(spark, sf_dir, name):
    """The table is one small split, and parsing its rows is work for all cores."""
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_molecule_is_read_once_a_batch(monkeypatch):
    import pyarrow as pa

    from cucurbit.functions import chem

    real, seen = chem.read, []
    monkeypatch.setattr(chem, "read", lambda x: seen.append(x) or real(x))
    batch = ["CCO", None, "c1ccccc1", "(", "CCO", "", "[Na+].C", "(", "c1ccccc1"]
    got = chem._graph(pa.array(batch)).to_pylist()
    assert sorted(seen) == sorted({x or "" for x in batch})
    for x, g in zip(batch, got, strict=True):
        try:
            assert g == chem.parse(x or "")
        except ValueError as e:
            assert g == dict.fromkeys(g) | {"error": str(e)}


@pytest.mark.parametrize("rule", ["none", "low", "random"])
def test_links_need_no_sample(rule):
    """The sampled counts of shingles are an order of cost: whatever they are, linked sets have a signature in common."""
    import numpy as np

    from cucurbit.llm import jaccard_join

    draw = np.random.default_rng(3)
    for size in (40, 90, 300, 1000):
        base = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
        lost = len(base) // 4  # the most that a subset may lack: 75 of 100 are left
        other = np.sort(draw.permutation(base)[lost:])
        counts = {"none": (base[:0], np.zeros(0, np.int64)), "low": (base, np.arange(len(base))), "random": (base, draw.integers(0, 99, len(base)))}[rule]
        h, whose = np.concatenate([base, other]), np.repeat([0, 1], [len(base), len(other)])
        sigs, texts = jaccard_join.signatures(h, whose, np.array([len(base), len(other)]), counts)
        assert set(sigs[texts == 0].tolist()) & set(sigs[texts == 1].tolist())
