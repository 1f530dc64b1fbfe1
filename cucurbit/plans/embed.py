"""Embedding: any table of SMILES, batch or stream, to encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import chem
from ..operators import model
from ..types import Model


def fingerprinted(molecules: DataFrame, config: Model, keep: tuple[str, ...] = (), watch: Observation | None = None) -> DataFrame:
    """smiles, indices and counts, with the columns to keep; molecules that can't be read are left out, without any quality filter.

    ``watch`` gets their number as ``skipped``, once the rows have been written.
    """
    parsed = molecules.select(*keep, "smiles").withColumn("graph", chem.molecule_graph(F.col("smiles")))
    if watch:
        parsed = parsed.observe(watch, F.count_if(F.col("graph.error").isNotNull()).alias("skipped"))
    done = chem.counted_fingerprint(parsed, radius=config.ecfp_radius, size=config.fingerprint_size)
    return done.where("fingerprint is not null").select(*keep, "smiles", "fingerprint.indices", "fingerprint.counts")


def embed(molecules: DataFrame, weights: dict, config: Model, batch: int = 4096, keep: tuple[str, ...] = (), watch: Observation | None = None) -> DataFrame:
    return model.encode(fingerprinted(molecules, config, keep, watch), weights, config, batch, keep)


def embed_all(molecules: DataFrame, weights: dict, config: Model, key: str, batch: int = 4096) -> DataFrame:
    """A row for each input, by its key (a unique column): the encodings, null where the molecule can't be read."""
    made = embed(molecules, weights, config, batch, (key,))
    return molecules.select(key, "smiles").join(made.drop("smiles"), key, "left")


def skipped(molecules: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The molecules that embedding leaves out, and why."""
    return molecules.select(*keep, "smiles", chem.molecule_graph(F.col("smiles"))["error"].alias("error")).where("error is not null")
