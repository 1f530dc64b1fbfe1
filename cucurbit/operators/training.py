"""Training: an epoch is one barrier stage whose tasks hold the weights, share each batch's rows and step together.

The rows of a batch are dealt to the tasks by their number.  For each batch the tasks add up what its
losses need of all rows (latent vectors, gradients) in a ring, and each makes the same Adam step, so
all hold the same weights.  Weights and moments come to the tasks as rows of the stage's input and
leave as rows of its result, a saved table; the driver sees one row for each sampled step.  If a task
is lost, Spark runs the epoch again from its saved beginning.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import saved
from ..types import Model
from . import model
from .ring import Alone, Ring

#: Most tasks of a stage: more make batches' shares small against what goes round.
REPLICAS = 8


class Adam:
    """Moments by layer; ``step`` returns the next weights."""

    def __init__(self, rate: float = 1e-3, steps: int = 0, first: dict | None = None, second: dict | None = None):
        self.rate, self.steps, self.first, self.second = rate, steps, dict(first or {}), dict(second or {})

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.steps += 1
        out = dict(weights)
        for k, g in grads.items():
            kind = weights[k].dtype
            self.first[k] = (0.9 * self.first.get(k, 0) + 0.1 * g).astype(kind)
            self.second[k] = (0.999 * self.second.get(k, 0) + 0.001 * g * g).astype(kind)
            m, v = self.first[k] / (1 - 0.9**self.steps), self.second[k] / (1 - 0.999**self.steps)
            out[k] = (weights[k] - self.rate * m / (np.sqrt(v) + 1e-8)).astype(kind)
        return out


@dataclass
class State:
    """Weights and moments as a table (``model.WEIGHTS``; kinds weights, first and second), and the steps made."""

    table: DataFrame
    steps: int = 0

    @classmethod
    def first(cls, spark: SparkSession, config: Model, seed: int = 0) -> State:
        return cls(saved(model.weight_table(spark, config, seed)))

    def weights(self) -> dict[str, np.ndarray]:
        return model.load_weights(self.table)


def noise_of(config: Model, step: int, n: int) -> np.ndarray:
    """Of each row and dimension of a step's batch, in shares of the latent vectors' deviation."""
    return np.random.default_rng([config.ecfp_radius, step]).normal(0, config.latent_noise_std, (n, config.latent_width))


def sampled(step: int, every: int) -> bool:
    """Whether a step, counted from 1 over all epochs, has its metrics taken: the first, and each whose number ``every`` divides."""
    return step == 1 or every > 0 and step % every == 0


OUT = model.WEIGHTS + ", step long, told array<double>"


def steps_of(group, parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame | None, int]]:
    """The batches in order, as all tasks of the group agree: id, the task's own rows or none, and the rows of all."""
    own = next(parts, None)
    while True:
        told = np.zeros((group.size, 2))
        told[group.rank] = (own["batch_id"].iloc[0] + 1, len(own)) if own is not None else (0, 0)
        told = group.add(told)
        if not told.any():
            return
        least = told[told[:, 0] > 0, 0].min()
        n = int(told[told[:, 0] == least, 1].sum())
        mine = own if own is not None and own["batch_id"].iloc[0] + 1 == least else None
        yield int(least) - 1, mine, n
        if mine is not None:
            own = next(parts, None)


COLUMNS = ["batch_id", "row", "indices", "counts", "descriptor_targets", "candidates", "best_pos", "top2_gap"]


def fit(group, weights: dict[str, np.ndarray], optimizer: Adam, parts: Iterator[pd.DataFrame], config: Model, noise: bool, every: int) -> Iterator[tuple]:
    """Steps over the batches of an epoch.  Yields the weights, with the step and its metrics where it is sampled."""
    empty = pd.DataFrame({c: [] for c in COLUMNS})
    for _, own, n in steps_of(group, parts):
        own = empty if own is None else own
        step = optimizer.steps + 1
        x, descriptors, labels = model._one(own, config, model.precision(weights))
        extra = noise_of(config, step, n) if noise and config.latent_noise_std > 0 else None
        told, grads = model.batch_losses(weights, x, descriptors, labels, config, extra, group=group, rows=own["row"].to_numpy(np.int64), n=n)
        if sampled(step, every) and not math.isfinite(told["total"]):
            raise ValueError(f"the loss is not finite at step {step}")
        weights = optimizer.step(weights, grads)
        yield weights, step, [told[m] for m in model.METRICS] if sampled(step, every) else None


def epoch(state: State, batches: DataFrame, config: Model, rate: float, noise: bool, every: int, replicas: int) -> tuple[State, DataFrame]:
    """One epoch over labelled batches.  The next state, and step and told (``model.METRICS``) of sampled steps."""
    spark = batches.sparkSession
    rows = model.labels_filled(batches).select(*COLUMNS)
    none = F.lit(None)
    parts = rows.select((F.col("row") % replicas).alias("rank"), F.lit(1).alias("tag"), *(none.cast(t).alias(c) for c, t in (x.split(" ") for x in model.WEIGHTS.split(", "))), *COLUMNS)
    each = state.table.select(F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("rank"), F.lit(0).alias("tag"), "kind", "layer", "shape", "block", "data", *(none.cast(rows.schema[c].dataType).alias(c) for c in COLUMNS))
    dealt = each.unionByName(parts).repartitionById(replicas, F.col("rank").cast("int")).sortWithinPartitions("tag", "kind", "layer", "block", "batch_id", "row")
    steps, block = state.steps, model.BLOCK

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Ring(BarrierTaskContext.get()) if replicas > 1 else Alone()
        held: dict[str, list] = {"weights": [], "first": [], "second": []}
        rest: list[pa.RecordBatch] = []

        def examples() -> Iterator[pd.DataFrame]:
            while rest:
                yield rest.pop().select(COLUMNS).to_pandas()
            for b in stream:
                yield b.select(COLUMNS).to_pandas()

        for b in stream:
            tag = np.asarray(b.column("tag"))
            cut = int((tag == 0).sum())
            for r in b.slice(0, cut).select(["kind", "layer", "shape", "block", "data"]).to_pylist():
                held[r["kind"]].append((r["layer"], r["shape"], r["block"], r["data"]))
            if cut < len(b):
                rest.append(b.slice(cut))
                break
        weights, *moments = (model.arrays_of(held.pop(k)) for k in ("weights", "first", "second"))
        optimizer = Adam(rate, steps, *moments)
        try:
            for weights, step, told in fit(group, weights, optimizer, model._batches(examples()), config, noise, every):
                if told is not None and group.rank == 0:
                    yield pa.RecordBatch.from_pylist([{"kind": "step", "step": step, "told": told}], OUT_SCHEMA)
            if group.rank == 0:
                yield pa.RecordBatch.from_pylist([{"kind": "steps", "step": optimizer.steps}], OUT_SCHEMA)
            # All tasks hold the same; each writes its share.
            for kind, arrays in (("weights", weights), ("first", optimizer.first), ("second", optimizer.second)):
                for b in model.weight_blocks(kind, arrays, block, lambda n: n % group.size == group.rank):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.list_(pa.float64()))], schema=OUT_SCHEMA)
        finally:
            group.close()

    OUT_SCHEMA = pa.schema([("kind", pa.string()), ("layer", pa.string()), ("shape", pa.list_(pa.int32())), ("block", pa.int32()), ("data", pa.binary()), ("step", pa.int64()), ("told", pa.list_(pa.float64()))])
    out = saved(dealt.mapInArrow(run, OUT, barrier=replicas > 1))
    made = out.where("kind = 'steps'").first()
    return State(out.where("kind in ('weights', 'first', 'second')").select("kind", "layer", "shape", "block", "data"), made.step if made else steps), out.where("kind = 'step'").select("step", "told")


def train(batches: DataFrame | Callable[[int, int], DataFrame], config: Model, epochs: int = 5, rate: float = 1e-3, seed: int = 0, state: State | None = None, noise: bool = False, after=None, every: int = 1, replicas: int | None = None, spark: SparkSession | None = None) -> tuple[State, list[dict]]:
    """An Adam step for each batch, epoch by epoch.

    batches: batch_id, row, indices, counts, descriptor_targets and the labels, if any; or what makes
    them of the epoch (1 on) and of the steps made before it.  ``every`` tells which steps' metrics
    are taken, by their number over all epochs.  ``after(epoch, state, means)`` is called behind each
    epoch, to validate or to save.  Returns the state and each epoch's means of sampled steps.
    """
    spark = spark or (batches.sparkSession if isinstance(batches, DataFrame) else SparkSession.active())
    state = state or State.first(spark, config, seed)
    replicas = replicas or min(REPLICAS, spark.sparkContext.defaultParallelism)
    history = []
    for k in range(1, epochs + 1):
        before = state.steps
        own = batches if isinstance(batches, DataFrame) else batches(k, before)
        state, told = epoch(state, own, config, rate, noise, every, replicas)
        taken = np.array([r.told for r in told.orderBy("step").collect()]).reshape(-1, len(model.METRICS))
        means = dict(zip(model.METRICS, taken.mean(0).tolist(), strict=True)) if len(taken) else {}
        history.append(means | {"batches": state.steps - before, "sampled": len(taken)})
        if after:
            after(k, state, history[-1])
    return state, history


# -- checkpoints --------------------------------------------------------------------------------------


def save_checkpoint(spark: SparkSession, folder: str, config: Model, state: State, more: dict, rate: float = 1e-3) -> None:
    """model-config.json, the weights and the optimizer's moments as Parquet, written by the executors, and last state.json."""
    from ..plans.preprocess import write_text

    folder = folder.rstrip("/")
    write_text(spark, f"{folder}/model-config.json", config.to_json())
    state.table.where("kind = 'weights'").write.mode("overwrite").parquet(f"{folder}/model")
    state.table.where("kind <> 'weights'").write.mode("overwrite").parquet(f"{folder}/optimizer")
    write_text(spark, f"{folder}/state.json", json.dumps(more | {"optimizer_steps": state.steps, "learning_rate": rate}, indent=2))


def load_checkpoint(spark: SparkSession, folder: str) -> tuple[Model, State, dict]:
    """What save_checkpoint wrote; a folder without a state gives the weights alone."""
    from ..plans.preprocess import exists

    folder = folder.rstrip("/")
    config = Model.from_json(spark.read.text(f"{folder}/model-config.json", wholetext=True).first()[0])
    weights = spark.read.schema(model.WEIGHTS).parquet(f"{folder}/model")
    if not exists(spark, f"{folder}/state.json"):
        return config, State(weights), {}
    more = json.loads(spark.read.text(f"{folder}/state.json", wholetext=True).first()[0])
    # Saved apart: the folder may be written again while a later state still comes from this one.
    both = saved(weights.unionByName(spark.read.schema(model.WEIGHTS).parquet(f"{folder}/optimizer")))
    return config, State(both, more["optimizer_steps"]), more
