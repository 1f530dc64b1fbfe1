"""Ids, molecules and vectors on literal values."""

import pytest
from pyspark.sql import functions as F

from cucurbit.functions import chem, ids

UNSIGNED = 1 << 64
#: What splitmix64 makes of 0 and 702, and a packed ZINC id.
MIXED = [(16294208416658607535, 535), (10445710285370694797, 797)]
ZINC_ID = 0x8001000000000001


def test_splitmix(spark):
    found = spark.createDataFrame([(0,), (702,)], "x long").select(ids.splitmix64(F.col("x")), ids.unsigned_mod(ids.splitmix64(F.col("x")), 1000)).collect()
    assert [(r[0] % UNSIGNED, r[1]) for r in found] == MIXED


def test_ids(spark):
    rows = [("pubchem-smiles", "702"), ("zinc20-smiles", "ZINC000000000001_1"), ("pubchem-smiles", "not-a-cid"), ("fixture-smiles", "record-1"), ("fixture-smiles", "record-2")]
    frame = spark.createDataFrame(rows, "d string, r string")
    found = frame.select(ids.stable_molecule_id(F.col("d"), F.col("r")), ids.record_status(F.col("d"), F.col("r"))).collect()
    assert found[0][0] == 702 and found[1][0] % UNSIGNED == ZINC_ID
    assert [r[1] for r in found] == ["ok", "ok", "error", "ok", "ok"]
    assert found[3][0] >> 62 == 1 and found[3][0] != found[4][0]


@pytest.mark.parametrize(
    "smiles, want",
    [
        ("CCO", {"carbon_count": 2, "oxygen_count": 1, "hydrogen_count": 6, "heavy_atom_count": 3, "connected_component_count": 1}),
        ("c1ccccc1", {"ring_atom_count": 6, "ring_bond_count": 6, "aromatic_atom_count": 6}),
        ("[NH4+]", {"formal_charge": 1, "nitrogen_count": 1, "hydrogen_count": 4, "connected_component_count": 1}),
        ("CC.O", {"connected_component_count": 2, "carbon_count": 2, "oxygen_count": 1}),
    ],
)
def test_descriptors(spark, smiles, want):
    d = spark.createDataFrame([(smiles,)], "s string").select(chem.molecule_graph(F.col("s")).alias("g")).select(chem.descriptors(F.col("g")).alias("d")).first().d
    assert {k: d[k] for k in want} == want


@pytest.mark.parametrize("bad", ["", "(", "C(", "C1CC", "C=", "[Xx]", "C)"])
def test_bad_molecules(bad):
    with pytest.raises(ValueError):
        chem.parse(bad)
