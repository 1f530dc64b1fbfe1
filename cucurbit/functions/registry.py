"""The library's functions under SQL names, for one session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import chem, ids

#: Names, arguments, types and bodies of the functions that are SQL themselves.
SHARED = "aggregate(zip_with(ia, ca, (i, c) -> least(greatest(c, 0), greatest(coalesce(try_element_at(map_from_arrays(ib, cb), i), 0), 0))), 0.0D, (a, x) -> a + x)"
POSITIVE = "aggregate({0}, 0.0D, (a, x) -> a + greatest(x, 0))"
EXPRESSIONS = {
    "count_tanimoto": ("ia ARRAY<INT>, ca ARRAY<INT>, ib ARRAY<INT>, cb ARRAY<INT>", "DOUBLE", f"(SELECT CASE WHEN both - s <= 1e-8 THEN 1.0D ELSE least(greatest(s / (both - s), 0.0D), 1.0D) END FROM (SELECT {SHARED} AS s, {POSITIVE.format('ca')} + {POSITIVE.format('cb')} AS both))"),
    "binary_tanimoto": ("ia ARRAY<INT>, ib ARRAY<INT>", "DOUBLE", "CASE WHEN size(array_union(ia, ib)) = 0 THEN 1.0D ELSE size(array_intersect(ia, ib)) / size(array_union(ia, ib)) END"),
}


def _descriptors(s: pd.Series) -> pd.DataFrame:
    """The descriptors of each molecule, from its graph; null where it can't be read."""
    out = []
    for x in s:
        try:
            g = chem.parse(x or "")
        except ValueError:
            out.append(dict.fromkeys(chem.DESCRIPTORS))
            continue
        atoms, hydrogen = g["atoms"], np.float32(chem.WEIGHTS["H"])
        mass = np.float32(0)
        for a in atoms:
            mass = np.float32(mass + np.float32(a["hydrogens"]) * hydrogen)
            mass = np.float32(mass + np.float32(chem.WEIGHTS.get(a["element"], 0.0)))
        hydrogens = sum(a["hydrogens"] + (a["element"] == "H") for a in atoms)
        out.append({
            "molecular_mass": float(mass), "formal_charge": sum(a["charge"] for a in atoms), "hydrogen_count": hydrogens, "total_hydrogen_count": hydrogens,
            "heavy_atom_count": sum(a["element"] not in "H*" for a in atoms), "ring_atom_count": g["ring_atoms"], "ring_bond_count": g["ring_bonds"],
            "connected_component_count": g["components"], "aromatic_atom_count": sum(a["aromatic"] for a in atoms),
        } | {c: sum(a["element"] == e for a in atoms) for c, e in chem.ELEMENT_COLUMNS.items()})
    frame = pd.DataFrame(out, columns=chem.DESCRIPTORS)
    return frame.astype({c: "Int32" for c in chem.DESCRIPTORS[1:]})


def register(spark: SparkSession) -> list[str]:
    """smiles_descriptors, count_tanimoto, binary_tanimoto (SQL), stable_molecule_id and split_for_id.

    Vectors in SQL must not repeat a bin.  For fingerprints of a table use chem.counted_fingerprint.
    """
    for name, (arguments, returns, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    _descriptors.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    kinds = ", ".join(f"{c} {'float' if c == 'molecular_mass' else 'int'}" for c in chem.DESCRIPTORS)
    spark.udf.register("smiles_descriptors", F.pandas_udf(_descriptors, kinds))

    @F.pandas_udf("long")
    def stable(dataset: pd.Series, record: pd.Series) -> pd.Series:
        return pd.Series([ids.stable_id_of(d, r) for d, r in zip(dataset, record, strict=True)], dtype="Int64")

    @F.pandas_udf("string")
    def split(stable_id: pd.Series, permille: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(x) else "validation" if ids.splitmix64_of(int(x)) % 1000 < p else "train" for x, p in zip(stable_id, permille, strict=True)], dtype=object)

    spark.udf.register("stable_molecule_id", stable)
    spark.udf.register("split_for_id", split)
    return [*EXPRESSIONS, "smiles_descriptors", "stable_molecule_id", "split_for_id"]
