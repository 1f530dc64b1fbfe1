"""The autoencoder: weights as a table of blocks, forward pass in Arrow functions or as joins, and the losses of a batch with their gradients.

A batch is a group of rows with one batch_id; its size is bounded by the plan that made it.  Tasks
read whole batches as sorted streams, so the ranking term finds a batch's other rows beside its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..types import ENCODING, Losses, Model
from .bins import Bins
from .metrics import mean_of_means
from .ring import Alone

LN2 = 0.6931471805599453
TERMS = ("reconstruction", "bce", "descriptor", "ranking")
#: Values in one row of a table of weights, stored as little-endian bytes.
BLOCK = 1 << 18
#: Bins of whole batches that are restored at a time.
CELLS = 1 << 18
WEIGHTS = "kind string, layer string, shape array<int>, block int, data binary"


# -- weights ------------------------------------------------------------------------------------------


def initial_weights(config: Model, seed: int = 0) -> dict[str, np.ndarray]:
    """Uniform in +-1/sqrt(inputs) by a seed; biases too."""
    rng = np.random.default_rng(seed)
    up, down = [config.fingerprint_size, *config.hidden_widths, config.latent_width], [config.latent_width, *config.decoder_widths, config.fingerprint_size]
    stacks = {"encoder": up, "decoder": down, "descriptor": [config.latent_width, config.descriptor_width]}
    out = {}
    for name, widths in stacks.items():
        for k, (a, b) in enumerate(zip(widths[:-1], widths[1:], strict=True)):
            bound = 1 / np.sqrt(a)
            out[f"{name}.{k}.weight"] = rng.uniform(-bound, bound, (a, b)).astype(np.float32)
            out[f"{name}.{k}.bias"] = rng.uniform(-bound, bound, b).astype(np.float32)
    return out


def weight_blocks(kind: str, arrays: dict[str, np.ndarray], block: int, keep=lambda block: True) -> Iterator[pa.RecordBatch]:
    """Rows of at most ``block`` values of arrays; ``keep`` takes a row's number among all of them."""
    n = 0
    for layer, v in arrays.items():
        flat = v.ravel()
        for i in range(0, v.size, block):
            if keep(n):
                row = {"kind": kind, "layer": layer, "shape": list(v.shape), "block": i // block, "data": flat[i : i + block].astype(v.dtype.newbyteorder("<")).tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("kind", pa.string()), ("layer", pa.string()), ("shape", pa.list_(pa.int32())), ("block", pa.int32()), ("data", pa.binary())]))
            n += 1


def weight_table(spark: SparkSession, config: Model, seed: int = 0) -> DataFrame:
    """First weights, made by a task: kind ('weights'), layer, shape, block, and data, values of 4 bytes."""
    block = BLOCK
    return spark.range(1).coalesce(1).mapInArrow(lambda _: weight_blocks("weights", initial_weights(config, seed), block), WEIGHTS)


def arrays_of(rows) -> dict[str, np.ndarray]:
    """rows: layer, shape, block and data of one kind.  The arrays, of 4 bytes a value."""
    parts: dict[str, dict[int, np.ndarray]] = {}
    shapes: dict[str, list[int]] = {}
    for layer, shape, block, data in rows:
        parts.setdefault(layer, {})[block], shapes[layer] = np.frombuffer(bytes(data), "<f4"), shape
    return {k: np.concatenate([v[i] for i in sorted(v)]).reshape(shapes[k]) for k, v in parts.items()}


def load_weights(table: DataFrame, kind: str = "weights") -> dict[str, np.ndarray]:
    """The arrays of a model, to be sent to the tasks that apply it: 4 bytes a weight, which fit in a worker's memory by its configuration."""
    return arrays_of(table.where(F.col("kind") == kind).select("layer", "shape", "block", "data").toLocalIterator())


# -- forward ------------------------------------------------------------------------------------------


def stack(weights: dict[str, np.ndarray], name: str, x: np.ndarray | Bins) -> list:
    """Inputs of each layer and the output; ReLU after all but the last."""
    out, k = [x], 0
    while f"{name}.{k}.weight" in weights:
        w = weights[f"{name}.{k}.weight"]
        x = (x.times(w) if isinstance(x, Bins) else x @ w) + weights[f"{name}.{k}.bias"]
        k += 1
        if f"{name}.{k}.weight" in weights:
            x = np.maximum(x, 0)
        out.append(x)
    return out


def precision(weights: dict[str, np.ndarray]) -> np.dtype:
    """That of the first encoder layer: inputs and outputs follow it."""
    return weights["encoder.0.weight"].dtype


def similarities(x: Bins, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: counted and binary similarity of target and restored log counts; a bin that the target sets is a bit, and a restored value above 0."""
    p = np.maximum(np.expm1(np.minimum(back.astype(np.float64), 50)), 0)
    t, own = np.expm1(x.value.astype(np.float64)), p[x.row, x.bin]
    low, high = x.by_row(np.minimum(t, own)), p.sum(1) + x.by_row(np.maximum(t - own, 0))
    said = back > 0
    both = x.by_row(said[x.row, x.bin].astype(np.float64))
    union = said.sum(1) + x.by_row(np.ones(len(x.row))) - both
    return np.where(high <= 0, 1.0, low / np.maximum(high, 1e-12)), np.where(union == 0, 1.0, both / np.maximum(union, 1))


def squared_errors(x: Bins, back: np.ndarray) -> np.ndarray:
    """By row, the mean squared distance of target and restored log counts."""
    return ((back**2).sum(1) + x.by_row((back[x.row, x.bin] - x.value) ** 2 - back[x.row, x.bin] ** 2)) / x.shape[1]


def encode(vectors: DataFrame, weights: dict[str, np.ndarray], config: Model, batch: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """vectors: smiles, indices, counts and columns to keep.  Those, how well each is restored, and its latent vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)
    width = config.fingerprint_size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                x = Bins.of(part["indices"], part["counts"], width)
                latent = stack(w, "encoder", x)[-1]
                back = stack(w, "decoder", latent)[-1]
                count, binary = similarities(x, back)
                yield pd.DataFrame({
                    **{c: part[c].to_numpy() for c in keep},
                    "smiles": part["smiles"].to_numpy(),
                    "count_tanimoto": count.astype(np.float32),
                    "binary_tanimoto": binary.astype(np.float32),
                    "log_mse": squared_errors(x, back).astype(np.float32),
                    "latent": list(latent.astype(np.float32)),
                })

    kinds = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in keep)
    return vectors.select(*keep, "smiles", "indices", "counts").mapInPandas(run, kinds + ENCODING)


def forward(vectors: DataFrame, weights: dict[str, np.ndarray], config: Model, keep: tuple[str, ...] = ("cid",), batch: int = 1024) -> DataFrame:
    """vectors: indices and counts.  The columns to keep, latent, reconstructed_log_counts and descriptor_predictions."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)
    width, kind = config.fingerprint_size, precision(weights)
    array = "array<double>" if kind == np.float64 else "array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                latent = stack(w, "encoder", Bins.of(part["indices"], part["counts"], width, kind))[-1]
                made = {"latent": latent, "reconstructed_log_counts": stack(w, "decoder", latent)[-1], "descriptor_predictions": stack(w, "descriptor", latent)[-1]}
                yield pd.DataFrame({c: part[c].to_numpy() for c in keep} | {k: list(v.astype(kind)) for k, v in made.items()})

    kinds = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in keep)
    return vectors.select(*keep, "indices", "counts").mapInPandas(run, kinds + ", ".join(f"{c} {array}" for c in ("latent", "reconstructed_log_counts", "descriptor_predictions")))


def linear_join(inputs: DataFrame, weights: DataFrame, bias: DataFrame, relu: bool = False) -> DataFrame:
    """A layer as a join: inputs row_id, i, x; weights i, j, w; bias j, b.  Returns row_id, j, y."""
    summed = inputs.join(weights, "i").groupBy("row_id", "j").agg(F.sum(F.col("x") * F.col("w")).alias("s"))
    y = F.col("s") + F.col("b")
    return summed.join(F.broadcast(bias), "j").select("row_id", "j", (F.greatest(y, F.lit(0.0)) if relu else y).alias("y"))


def noise_scale(entries: DataFrame) -> DataFrame:
    """entries: batch_id, i (dimension) and x of each row.  By batch, the root of the mean squared distance from the dimensions' means."""
    own = Window.partitionBy("batch_id", "i")
    return entries.withColumn("__m", F.avg("x").over(own)).groupBy("batch_id").agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("__m"), 2)) + 1e-6).alias("scale"))


def latent_noise(entries: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """entries with normal noise of ``share`` of their batch's scale; 0 leaves them as they are."""
    if share <= 0:
        return entries
    noisy = entries.join(noise_scale(entries), "batch_id")
    return noisy.withColumn("x", F.col("x") + F.randn(seed) * share * F.col("scale")).drop("scale")


# -- losses of a batch, and their gradients -----------------------------------------------------------


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _ranking(latent: np.ndarray, candidates, best, gap: np.ndarray, c: Losses, rows: np.ndarray | None = None, group=None) -> tuple[float, float, int, np.ndarray]:
    """Loss, accuracy, valid pairs, and the loss's gradient by latent vector, of one batch.

    ``latent`` has all rows of the batch.  If a group shares the batch, the labels are those of the
    task's own ``rows`` and what is returned is the sum over the group.
    """
    group = group or Alone()
    rows = np.arange(len(latent)) if rows is None else rows
    grad = np.zeros_like(latent)
    own = np.flatnonzero(rows < (c.pairs_per_batch or len(latent)))
    short = np.array([float(any(len(candidates[k]) < 2 for k in own))])
    if len(latent) < 3 or group.add(short)[0]:
        return 0.0, 0.0, 0, grad
    told = np.zeros(4)
    if len(own):
        at, who, best, gap = rows[own], np.stack([np.asarray(candidates[k], np.int64) for k in own]), np.asarray(best, np.int64)[own], gap[own]
        norm = np.sqrt((latent**2).sum(1) + 1e-6)
        a, b, na, nb = latent[at][:, None, :], latent[who], norm[at][:, None], norm[who]
        cos = (a * b).sum(2) / (na * nb)
        logits = np.clip(cos, -1, 1) / max(c.latent_temperature, 1e-6)
        shifted = logits - logits.max(1, keepdims=True)
        p = np.exp(shifted) / np.exp(shifted).sum(1, keepdims=True)
        each, valid = np.arange(len(own)), gap > c.min_gap
        w = np.where(valid, gap, 0.0)
        told[:] = (-np.log(np.maximum(p[each, best], 1e-300)) * w).sum(), w.sum(), ((logits.argmax(1) == best) & valid).sum(), valid.sum()
        d = p.copy()
        d[each, best] -= 1
        d *= w[:, None] / max(c.latent_temperature, 1e-6) * (np.abs(cos) <= 1)
        grad[at] += (d[:, :, None] * (b / (na * nb)[:, :, None] - a * (cos / na**2)[:, :, None])).sum(1)
        np.add.at(grad, who, d[:, :, None] * (a / (na * nb)[:, :, None] - b * (cos / nb**2)[:, :, None]))
    summed = group.add(np.concatenate([grad.ravel(), told]))
    loss, total, right, valid = summed[-4:]
    return float(loss / max(total, 1e-6)), float(right / max(valid, 1)), int(valid), summed[:-4].reshape(grad.shape) / max(total, 1e-6)


def _bin_terms(q: np.ndarray, x: Bins, config: Model, gradients: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """By row, the sums over bins of the reconstruction and bce terms, and their gradient by q; the caller divides by the bins of all rows of a batch."""
    c, at, own = config.losses, (x.row, x.bin), q[x.row, x.bin]
    # As if no bin were set, and then the set ones.
    delta, weight = np.maximum(q, 0), np.full(q.shape, c.huber_zero, np.float64)
    delta[at], weight[at] = own - x.value, c.huber_active
    size = np.abs(delta)
    reconstruction = (np.where(size <= c.huber_beta, 0.5 / c.huber_beta * delta**2, size - 0.5 * c.huber_beta) * weight).sum(1)
    grad = np.clip(delta / c.huber_beta, -1, 1) * weight if gradients else None
    bce = np.zeros(len(q))
    if c.bce_weight > 0:
        bins, wrong = np.full(q.shape, c.bce_zero, np.float64), q.copy()
        bins[at], wrong[at] = c.bce_active, -own
        if config.bit_frequencies:
            f = np.asarray(config.bit_frequencies)
            set_bins = c.bce_active * -np.log(f + 1e-6)
            bins *= -np.log(1 - f + 1e-6)
            bins[at] = set_bins[x.bin]
        bins *= c.bce_weight
        bce = (np.maximum(_softplus(wrong) - LN2, 0) * bins).sum(1)
        if gradients:
            slope = np.where(wrong > 0, _sigmoid(wrong), 0) * bins
            slope[at] *= -1
            grad += slope
    return reconstruction, bce, grad


def batch_losses(w: dict[str, np.ndarray], x, descriptors: np.ndarray, labels: tuple | None, config: Model, noise: np.ndarray | None = None, gradients: bool = True, group=None, rows: np.ndarray | None = None, n: int | None = None) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """The weighted terms, accuracy, valid_pairs, similarities and total of one batch, and the gradients of the total.

    x: log counts of the rows, as ``Bins`` or dense.  noise: for each row, in shares of the latent
    vectors' deviation, which counts as a constant.  If a ``group`` of tasks shares a batch of ``n``
    rows, each has some, numbered ``rows`` among all of them, and all get the sums.
    """
    group = group or Alone()
    x = x if isinstance(x, Bins) else Bins.of_dense(x)
    c, width = config.losses, x.shape[1]
    n, rows = (x.shape[0], np.arange(x.shape[0])) if n is None else (n, rows)
    enc = stack(w, "encoder", x)
    latent = enc[-1]
    every = np.zeros((n, latent.shape[1]), latent.dtype)
    every[rows] = latent
    every = group.add(every)
    if noise is None:
        dec = stack(w, "decoder", latent)
    else:
        scale = np.sqrt(((every - every.mean(0)) ** 2).mean() + 1e-6)
        dec = stack(w, "decoder", (latent + noise[rows] * scale).astype(latent.dtype))
    head = stack(w, "descriptor", latent)
    q = dec[-1].astype(np.float64)
    out = dict.fromkeys(TERMS, 0.0)
    *by_row, grad = _bin_terms(q, x, config, gradients)
    out["reconstruction"], out["bce"] = (float(v.sum() / (n * width)) for v in by_row)
    by_latent = np.zeros(latent.shape)
    by_head = np.zeros(head[-1].shape)
    if c.descriptor_weight > 0:
        off = head[-1] - descriptors
        out["descriptor"] = float((off.astype(np.float64) ** 2).sum() / (n * off.shape[1]) * c.descriptor_weight)
        by_head = 2 * off * c.descriptor_weight / (n * off.shape[1])
    count, binary = similarities(x, dec[-1])
    sums = group.add(np.array([*(out[t] for t in TERMS), count.sum() / n, binary.sum() / n]))
    out = dict(zip(TERMS, map(float, sums[:4]), strict=True)) | {"accuracy": 0.0, "valid_pairs": 0.0}
    if c.ranking_weight > 0 and labels is not None:
        loss, out["accuracy"], out["valid_pairs"], g = _ranking(every.astype(np.float64), *labels, c, rows, group)
        out["ranking"] = loss * c.ranking_weight
        by_latent += g[rows] * c.ranking_weight
    out["total"] = sum(out[t] for t in TERMS)
    out |= {"count_tanimoto": float(sums[4]), "binary_tanimoto": float(sums[5])}
    total: dict[str, np.ndarray] = {}
    if not gradients:
        return out, total

    def back(name: str, inputs: list, g: np.ndarray) -> np.ndarray:
        for k in range(len(inputs) - 2, -1, -1):
            total[f"{name}.{k}.weight"] = inputs[k].back(g) if isinstance(inputs[k], Bins) else inputs[k].T @ g
            total[f"{name}.{k}.bias"] = g.sum(0)
            if isinstance(inputs[k], Bins):
                break
            g = g @ w[f"{name}.{k}.weight"].T
            if k:
                g = g * (inputs[k] > 0)
        return g

    back("encoder", enc, back("decoder", dec, grad / (n * width)) + back("descriptor", head, by_head) + by_latent)
    if group.size > 1:
        # One sum for all arrays, in the weights' precision.
        flat = group.add(np.concatenate([total[k].ravel() for k in total]).astype(w["encoder.0.weight"].dtype))
        ends = np.cumsum([total[k].size for k in total])
        total = {k: part.reshape(total[k].shape) for k, part in zip(total, np.split(flat, ends[:-1]), strict=True)}
    return out, total


METRICS = [*TERMS, "total", "accuracy", "valid_pairs", "count_tanimoto", "binary_tanimoto"]


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each batch, from a stream in the order of batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for _, part in frame.groupby("batch_id", sort=False):
            if held and held[-1]["batch_id"].iloc[0] != part["batch_id"].iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def labels_filled(batches: DataFrame) -> DataFrame:
    """What the losses read of batches; without labels, those of the ranking term are empty."""
    names = ["batch_id", "row", "indices", "counts", "descriptor_targets"]
    empty = {"candidates": F.array().cast("array<int>"), "best_pos": F.lit(0), "top2_gap": F.lit(0.0)}
    return batches.select(*names, *((F.coalesce(k, v) if k in batches.columns else v).alias(k) for k, v in empty.items()))


def _dealt(batches: DataFrame) -> DataFrame:
    """Whole batches by task, in order; rows without a batch are left out."""
    return labels_filled(batches.where(F.col("batch_id").isNotNull())).repartition("batch_id").sortWithinPartitions("batch_id", "row")


def _whole(stream: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Whole batches, from a stream in their order: as many at a time as have ``most`` rows together."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for b in stream:
        if not b.num_rows:
            continue
        ids = b["batch_id"].to_numpy()
        at = 0
        for start in np.flatnonzero(np.append(last is not None and ids[0] != last, ids[1:] != ids[:-1])).tolist():
            if rows + start - at >= most:
                yield _joined([*held, b.slice(at, start - at)])
                held, rows, at = [], 0, start
        held.append(b.slice(at))
        rows, last = rows + b.num_rows - at, ids[-1]
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _one(batch: pd.DataFrame, config: Model, kind: np.dtype) -> tuple[Bins, np.ndarray, tuple]:
    x = Bins.of(batch["indices"], batch["counts"], config.fingerprint_size, kind)
    descriptors = np.stack(batch["descriptor_targets"].to_list()) if len(batch) else np.zeros((0, config.descriptor_width))
    return x, descriptors, (batch["candidates"].to_list(), batch["best_pos"].to_list(), batch["top2_gap"].to_numpy(np.float64))


def _measured(w: dict[str, np.ndarray], part: pa.RecordBatch, config: Model) -> pa.RecordBatch:
    """The measures of whole batches, in one pass over all their rows; only the ranking term of labelled ones looks at each batch for itself."""
    c, width, n = config.losses, config.fingerprint_size, part.num_rows
    ids = part["batch_id"].to_numpy()
    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    rows = np.diff(start, append=n)
    lengths = lambda name: part[name].value_lengths().to_numpy(zero_copy_only=False)
    flat = lambda name: part[name].flatten().to_numpy(zero_copy_only=False)
    mean = lambda by_row: np.add.reduceat(by_row, start) / rows
    x = Bins.of_flat(lengths("indices"), flat("indices"), flat("counts"), width, precision(w))
    latent = stack(w, "encoder", x)[-1]
    back = stack(w, "decoder", latent)[-1]
    by_row = _bin_terms(back.astype(np.float64), x, config, False)[:2]
    out = dict(zip(TERMS[:2], (mean(v) / width for v in by_row), strict=True)) | {m: np.zeros(len(start)) for m in (*TERMS[2:], "accuracy", "valid_pairs")}
    if c.descriptor_weight > 0:
        if len(np.unique(lengths("descriptor_targets"))) > 1:
            raise ValueError("rows differ in their number of descriptors")
        off = (stack(w, "descriptor", latent)[-1] - flat("descriptor_targets").reshape(n, -1)).astype(np.float64)
        out["descriptor"] = mean((off**2).sum(1)) / off.shape[1] * c.descriptor_weight
    if c.ranking_weight > 0:
        asked = lengths("candidates")
        best, gap = part["best_pos"].to_numpy(), part["top2_gap"].to_numpy()
        # A batch whose rows have no two candidates has no ranking term.
        for k in np.flatnonzero(np.maximum.reduceat(asked, start) > 1):
            own = slice(start[k], start[k] + rows[k])
            loss, out["accuracy"][k], out["valid_pairs"][k], _ = _ranking(latent[own].astype(np.float64), part["candidates"][own].to_pylist(), best[own], gap[own], c)
            out["ranking"][k] = loss * c.ranking_weight
    out["total"] = sum(out[t] for t in TERMS)
    out["count_tanimoto"], out["binary_tanimoto"] = map(mean, similarities(x, back))
    return pa.RecordBatch.from_pydict({"batch_id": ids[start].astype(np.int64), "rows": rows.astype(np.int64)} | {m: out[m] for m in METRICS})


def losses_by_batch(batches: DataFrame, weights: dict[str, np.ndarray], config: Model) -> DataFrame:
    """batches: batch_id, row, indices, counts, descriptor_targets, and candidates, best_pos and top2_gap if they are labelled.  One row a batch: rows and the measures of METRICS."""
    shared = batches.sparkSession.sparkContext.broadcast(weights)
    most = max(1, CELLS // config.fingerprint_size)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_measured(shared.value, part, config) for part in _whole(stream, most))

    return _dealt(batches).mapInArrow(run, "batch_id long, rows long, " + ", ".join(f"{m} double" for m in METRICS))


def evaluate(batches: DataFrame, weights: dict[str, np.ndarray], config: Model) -> dict[str, float] | None:
    """The means over batches of their measures; none without batches, and an error if the loss isn't finite."""
    found = mean_of_means(losses_by_batch(batches, weights, config), *METRICS).first().asDict()
    if found["total"] is None:
        return None
    if not np.isfinite(found["total"]):
        raise ValueError("the validation loss is not finite")
    return found
