"""Bond orders, aromaticity and environments of literal molecules."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cucurbit.functions import aromatic, chem

#: SMILES in both notations, and their aromatic atoms and hydrogens.
BOTH = [
    (["c1ccccc1", "C1=CC=CC=C1", "C1C=CC=CC=1"], 6, 6),  # benzene
    (["c1ccc2ccccc2c1", "C1=CC=C2C=CC=CC2=C1", "C1=CC2=CC=CC=C2C=C1"], 10, 8),  # naphthalene
    (["c1cc[nH]c1", "[nH]1cccc1", "C1=CNC=C1"], 5, 5),  # pyrrole
    (["c1ccsc1", "C1=CSC=C1"], 5, 4),  # thiophene
    (["c1ccoc1", "C1=COC=C1"], 5, 4),  # furan
    (["c1ccncc1", "C1=CC=NC=C1"], 6, 5),  # pyridine
    (["c1cnc[nH]1", "C1=CN=CN1"], 5, 4),  # imidazole
    (["c1ccccccc1", "C1=CC=CC=CC=C1"], 0, 8),  # cyclooctatetraene
    (["c1cc2cccccc2c1", "C1=CC2=CC=CC=CC2=C1", "C1=CC=C2C=CC=C2C=C1"], 10, 8),  # azulene
    (["c1ccc2[nH]ccc2c1", "C1=CC=C2C(=C1)C=CN2"], 9, 7),  # indole
    (["O=c1cccc[nH]1", "O=C1C=CC=CN1"], 6, 5),  # 2-pyridone
    (["c1ccc(cc1)-c1ccccc1", "C1=CC=C(C=C1)C1=CC=CC=C1"], 12, 10),  # biphenyl
    (["[cH-]1cccc1", "[CH-]1C=CC=C1"], 5, 5),  # cyclopentadienide
    (["[cH+]1cccccc1", "[CH+]1C=CC=CC=C1"], 7, 7),  # tropylium
    (["c1cc[n+](C)cc1", "C1=CC=[N+](C)C=C1"], 6, 8),  # N-methylpyridinium
    (["Cn1cccc1", "CN1C=CC=C1"], 5, 7),  # N-methylpyrrole
    (["c1ccc2c(c1)ccc1ccccc12", "C1=CC=C2C(=C1)C=CC1=CC=CC=C12"], 14, 10),  # phenanthrene
    (["Cc1ccccc1O", "CC1=CC=CC=C1O"], 6, 8),  # cresol
]
NOT_AROMATIC = ["C1=CC=CC1", "C1CCCCC1", "C1=CCC=CC1", "C=C1C=CC=C1", "O=C1C=CC(=O)C=C1", "C1=CC=C1", "CC=CC"]
REFUSED = ["c1cccc1", "c1ccnc1", "c1cccccc1", "n1cccc1", "c1ccc2cccc2c1"]


@pytest.mark.parametrize(("forms", "n", "hydrogens"), BOTH)
def test_both_notations(forms, n, hydrogens):
    for smiles in forms:
        found = chem.parse(smiles)
        assert (sum(a["aromatic"] for a in found["atoms"]), sum(a["hydrogens"] for a in found["atoms"])) == (n, hydrogens), smiles
    kinds = [Counter((a["element"], a["aromatic"], a["hydrogens"], tuple(sorted(b["kind"] for b in a["near"]))) for a in chem.parse(s)["atoms"]) for s in forms]
    if n:
        assert all(k == kinds[0] for k in kinds)


@pytest.mark.parametrize("smiles", NOT_AROMATIC)
def test_not_aromatic(smiles):
    assert not any(a["aromatic"] for a in chem.parse(smiles)["atoms"])


@pytest.mark.parametrize("smiles", REFUSED)
def test_no_bond_orders(smiles):
    with pytest.raises(ValueError):
        chem.parse(smiles)


def test_matching_is_a_largest_one():
    """Against all choices of edges, on random graphs with many odd rings."""
    r = random.Random(4)
    for _ in range(400):
        n = r.randrange(2, 9)
        edges = [e for e in itertools.combinations(range(n), 2) if r.random() < 0.4]
        near = {v: [b if a == v else a for a, b in edges if v in (a, b)] for v in range(n)}
        mate = aromatic.matching(near)
        assert all(mate[mate[v]] == v and mate[v] in near[v] for v in mate)
        best = 0
        for size in range(n // 2, 0, -1):
            if any(len({x for e in some for x in e}) == 2 * size for some in itertools.combinations(edges, size)):
                best = size
                break
        assert len(mate) == 2 * best, edges


def test_basis_has_all_rings():
    """As many rings as bonds beyond a tree, none made of others."""
    for smiles, sizes in (("C1CCCCC1", [6]), ("C1CC2CCC1C2", [5, 5]), ("C12C3C4C1C5C2C3C45", [4] * 5), ("C1CC1CC1CC1", [3, 3]), ("c1ccc2ccccc2c1", [6, 6])):
        g = chem.parse(smiles)
        bonds = [[b["a"], b["b"], 1] for b in g["bonds"]]
        near = [[(b["other"], b["bond"]) for b in a["near"]] for a in g["atoms"]]
        _, bridges = chem._components_and_bridges(near)
        basis = aromatic.cycle_basis(len(near), bonds, near, set(range(len(bonds))) - bridges)
        assert sorted(x.bit_count() for x in basis) == sizes


def slow_fingerprint(smiles, radius):
    """How many environments there are after those of the same bonds are one, by radius, and their classes by symmetry."""
    atoms = chem.parse(smiles)["atoms"]
    code = [str((a["element"], a["charge"], a["hydrogens"], a["aromatic"], len(a["near"]))) for a in atoms]
    own, counts, seen = [frozenset()] * len(atoms), Counter(code), {}
    for r in range(1, radius + 1):
        grown = [frozenset(b["bond"] for b in a["near"]).union(*(own[b["other"]] for b in a["near"])) for a in atoms]
        code = [str((r, code[i], sorted((b["kind"], code[b["other"]]) for b in a["near"]))) for i, a in enumerate(atoms)]
        own = grown
        for bonds, c in zip(own, code, strict=True):
            if bonds:
                seen.setdefault(bonds, set()).add((r, c))
    return sorted(counts.values()), sum(counts.values()) + len(seen), seen


@pytest.mark.parametrize(("smiles", "total"), [("C", 1), ("CC", 3), ("CCO", 6), ("c1ccccc1", 18), ("CC(=O)O", 8)])
def test_environments_by_hand(spark, smiles, total):
    """CCO: three atoms, and the bonds {1}, {2} and {1, 2}; radius 2 has no others."""
    got = spark.createDataFrame([(smiles,)], "s string").withColumn("graph", chem.molecule_graph(F.col("s")))
    found = chem.counted_fingerprint(got, radius=2, size=65536).first().fingerprint
    assert sum(found.counts) == total == slow_fingerprint(smiles, 2)[1]


def test_fingerprints_of_both_notations(spark):
    pairs = [(f[0], other) for f, n, _ in BOTH if n for other in f[1:]]
    frame = spark.createDataFrame([(k, s) for k, p in enumerate(pairs) for s in p], "k int, s string").withColumn("graph", chem.molecule_graph(F.col("s")))
    found = {}
    for r in chem.counted_fingerprint(frame, radius=3, size=65536).collect():
        found.setdefault(r.k, []).append((tuple(r.fingerprint.indices), tuple(r.fingerprint.counts)))
        assert sum(r.fingerprint.counts) == slow_fingerprint(r.s, 3)[1] and list(r.fingerprint.indices) == sorted(set(r.fingerprint.indices))
    assert all(a == b for a, b in found.values())


@pytest.mark.parametrize("bad", [0.0, -1.0, float("inf"), float("nan")])
def test_scales_have_to_be_positive(spark, bad):
    for name in ("mass_scale", "charge_scale", "count_scale"):
        with pytest.raises(ValueError):
            chem.regression_targets(F.lit(None), **{name: bad})
