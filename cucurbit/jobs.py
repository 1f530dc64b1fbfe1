"""Command-line jobs: ``python -m cucurbit.jobs embed INPUT OUTPUT --checkpoint DIR`` and ``... train SHARDS CHECKPOINT_DIR``.

Paths are any that Spark reads and writes.  Options that set threads, devices or prefetching have no
counterpart: Spark's own configuration does that.
"""

from __future__ import annotations

import argparse
import json
import math
import sys

from pyspark.sql import Observation, SparkSession

from .operators import labels, model, ranking, training
from .plans import embed as embedding
from .plans import preprocess
from .sources import encodings, molecules, shards
from .types import Losses, Model, Preprocessing, QualityFilter


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError(f"must be positive: {text}")
    return n


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def widths(text: str) -> tuple[int, ...]:
    return tuple(positive(x) for x in names(text))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cucurbit")
    jobs = out.add_subparsers(dest="job", required=True)
    e = jobs.add_parser("embed", help="encodings of the molecules of a file")
    e.add_argument("input", help="'-' for standard input, or .smi .smiles .csv .tsv .mgf (compressed or not) .parquet")
    e.add_argument("output", help="'-' for standard output, or .tsv .csv .jsonl .parquet")
    e.add_argument("--checkpoint", required=True)
    e.add_argument("--batch-size", type=positive, default=4096)
    e.add_argument("--smiles-column", default="smiles")
    e.add_argument("--parquet-compression")

    t = jobs.add_parser("train", help="make shards if asked to, and train on them")
    t.add_argument("shards", help="folder of the shards, or a manifest")
    t.add_argument("checkpoint_dir")
    t.add_argument("--datasets", type=names, default=[])
    t.add_argument("--pubchem", help="the PubChem dump to read")
    t.add_argument("--zinc20", help="the folder of the ZINC20 chunks to read")
    t.add_argument("--zinc20-chunks", type=molecules.chunk_range)
    t.add_argument("--rows-per-shard", type=positive, default=10_000_000)
    t.add_argument("--force-preprocess", action="store_true")
    t.add_argument("--resume", action="store_true")
    t.add_argument("--epochs", type=positive, default=10)
    t.add_argument("--batch-size", type=positive, default=4096)
    t.add_argument("--learning-rate", type=float, default=1e-3)
    t.add_argument("--latent-width", type=positive, default=Model.latent_width)
    t.add_argument("--latent-noise-std", type=float, default=Model.latent_noise_std)
    t.add_argument("--hidden-widths", type=widths, default=Model.hidden_widths)
    t.add_argument("--checkpoint-every", type=int, default=1)
    t.add_argument("--validate-every", type=int, default=1)
    t.add_argument("--max-train-batches", type=positive)
    t.add_argument("--max-valid-batches", type=positive, default=64)
    t.add_argument("--full-validation", action="store_true")
    t.add_argument("--metric-every", type=int, default=10, help="take the metrics of the first step and of each so many")
    t.add_argument("--replicas", type=positive, help="tasks that share each batch")
    t.add_argument("--descriptor-weight", type=float, default=Losses.descriptor_weight)
    t.add_argument("--tanimoto-ranking-weight", type=float, default=Losses.ranking_weight)
    t.add_argument("--tanimoto-ranking-latent-temperature", "--tanimoto-ranking-margin", type=float, default=Losses.latent_temperature)
    t.add_argument("--tanimoto-ranking-metric-temperature", type=float, default=Losses.metric_temperature)
    t.add_argument("--tanimoto-ranking-min-gap", type=float, default=Losses.min_gap)
    t.add_argument("--tanimoto-ranking-candidates", type=positive, default=Losses.candidates)
    t.add_argument("--tanimoto-ranking-pairs-per-batch", type=int, default=Losses.pairs_per_batch)
    t.add_argument("--bce-weight", type=float, default=Losses.bce_weight)
    t.add_argument("--bce-zero-weight", type=float, default=Losses.bce_zero)
    t.add_argument("--bce-nonzero-weight", type=float, default=Losses.bce_active)
    t.add_argument("--ecfp-radius", type=positive, default=Preprocessing.radius)
    t.add_argument("--fingerprint-size", type=positive, default=Preprocessing.fingerprint_size)
    t.add_argument("--min-heavy-atoms", type=int)
    t.add_argument("--max-heavy-atoms", type=int)
    t.add_argument("--min-molecular-mass", type=float)
    t.add_argument("--max-molecular-mass", type=float)
    t.add_argument("--min-formal-charge", type=int)
    t.add_argument("--max-formal-charge", type=int)
    t.add_argument("--max-connected-components", type=int)
    return out


def quality_filter(a: argparse.Namespace) -> QualityFilter:
    return QualityFilter(a.min_heavy_atoms, a.max_heavy_atoms, a.min_molecular_mass, a.max_molecular_mass, a.min_formal_charge, a.max_formal_charge, a.max_connected_components)


def model_config(a: argparse.Namespace, size: int, radius: int, frequencies: list[float] | None) -> Model:
    terms = Losses(
        bce_weight=a.bce_weight, bce_active=a.bce_nonzero_weight, bce_zero=a.bce_zero_weight, descriptor_weight=a.descriptor_weight, ranking_weight=a.tanimoto_ranking_weight,
        latent_temperature=a.tanimoto_ranking_latent_temperature, metric_temperature=a.tanimoto_ranking_metric_temperature, min_gap=a.tanimoto_ranking_min_gap,
        candidates=a.tanimoto_ranking_candidates, pairs_per_batch=a.tanimoto_ranking_pairs_per_batch,
    )
    return Model(fingerprint_size=size, latent_width=a.latent_width, hidden_widths=a.hidden_widths, ecfp_radius=radius, latent_noise_std=a.latent_noise_std, bit_frequencies=tuple(frequencies or ()), losses=terms)


def prepared(spark: SparkSession, a: argparse.Namespace) -> tuple[str, dict]:
    """The folder of the shards and their manifest: made from the datasets named, unless one made so is there."""
    path, cache = preprocess.manifest_path(spark, a.shards)
    folder = path.rsplit("/", 1)[0]
    config = Preprocessing(radius=a.ecfp_radius, fingerprint_size=a.fingerprint_size, quality=quality_filter(a))
    if a.datasets and cache:
        label = molecules.source_label(a.datasets, a.zinc20_chunks)
        if preprocess.exists(spark, path) and not a.force_preprocess:
            found = preprocess.read_manifest(spark, path)
            if preprocess.reusable(found, label, config):
                print(f"using_cached_manifest={path} source={label}")
                return folder, found
        parts = []
        for name, where in (("pubchem", a.pubchem), ("zinc20", a.zinc20)):
            if name in a.datasets:
                if not where:
                    raise ValueError(f"--{name} names the files of {name}")
                parts.append(molecules.read_pubchem(spark, where) if name == "pubchem" else molecules.read_zinc20(spark, where, *(a.zinc20_chunks or (1, 20))))
        processed = preprocess.process(molecules.union_sources(*parts), config)
        return folder, preprocess.write_cache(processed, folder, label, config, a.rows_per_shard, "source_ord")
    elif a.zinc20_chunks:
        molecules.source_label(a.datasets, a.zinc20_chunks)
    return folder, preprocess.backfilled(spark, folder, preprocess.read_manifest(spark, path))


def train_job(spark: SparkSession, a: argparse.Namespace) -> dict:
    folder, manifest = prepared(spark, a)
    stored = manifest["preprocessing"]
    if a.resume:
        config, state, more = training.load_checkpoint(spark, a.checkpoint_dir)
    else:
        config = model_config(a, stored["fingerprint_size"], stored["radius"], preprocess.bit_frequencies(manifest))
        state, more = training.State.first(spark, config), {}
    shards.check_shape(manifest, config)
    rows = shards.read_shards(spark, folder, manifest)
    done, best = more.get("completed_epoch", 0), more.get("best_validation_loss")
    history = []

    def batches(split: str, limit: int | None, epoch: int, first_step: int):
        """The split's batches, with labels by a seed of each batch and epoch if the ranking term is on."""
        planned = ranking.split_batches(rows, "shard_id", "row_in_shard", split, a.batch_size, stored["validation_permille"], limit)
        if config.losses.ranking_weight <= 0:
            return planned
        return labels.labelled(labels.with_steps(planned, first_step), epoch, config.losses.candidates)

    def after(k: int, state: training.State, means: dict) -> None:
        nonlocal best
        own = {"epoch": done + k, "train": means}
        if a.validate_every and k % a.validate_every == 0 and stored["validation_permille"]:
            own["validation"] = model.evaluate(batches("validation", None if a.full_validation else a.max_valid_batches, done + k, 0), state.weights(), config)
            if own["validation"]:
                best = min(own["validation"]["total"], math.inf if best is None else best)
        history.append(own)
        print(json.dumps(own))
        if k == a.epochs or a.checkpoint_every and k % a.checkpoint_every == 0:
            training.save_checkpoint(spark, a.checkpoint_dir, config, state, {"completed_epoch": done + k, "best_validation_loss": best}, a.learning_rate)

    made = lambda k, steps: batches("train", a.max_train_batches, done + k, steps)
    state, _ = training.train(made, config, a.epochs, a.learning_rate, state=state, noise=True, after=after, every=a.metric_every, replicas=a.replicas, spark=spark)
    return {"epochs": history, "best_validation_loss": best, "steps": state.steps}


def embed_job(spark: SparkSession, a: argparse.Namespace) -> dict:
    config, state, _ = training.load_checkpoint(spark, a.checkpoint)
    rows = molecules.in_order(molecules.read_molecules(spark, a.input, a.smiles_column, places=True))
    watch = Observation()
    encodings.write_encodings(embedding.embed(rows, state.weights(), config, a.batch_size, watch=watch), a.output, config.latent_width, a.parquet_compression)
    left = watch.get["skipped"]
    print(f"embed_skip={left}", file=sys.stderr)
    return {"skipped": left}


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"cucurbit {a.job}").getOrCreate()
    return {"embed": embed_job, "train": train_job}[a.job](spark, a)


if __name__ == "__main__":
    main()
