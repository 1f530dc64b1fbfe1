"""SMILES to atoms and bonds by a small Arrow function; descriptors and counted circular fingerprints as expressions on them.

The parser covers the organic subset, bracket atoms, bonds, branches, ring closures, dots,
aromatic lower case and the wildcard.  Aromaticity is found on the graph: c1ccccc1 and C1=CC=CC=C1
are the same molecule.  Fingerprint bits are this library's own: hashes of atom environments,
counted by bin.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aromatic import aromatic_rings, double_bonds

#: Standard atomic weights.
WEIGHTS = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.95, "K": 39.098, "Ca": 40.078,
    "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38,
    "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798, "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224,
    "Nb": 92.906, "Mo": 95.95, "Tc": 97.0, "Ru": 101.07, "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71,
    "Sb": 121.76, "Te": 127.60, "I": 126.90, "Xe": 131.29, "Cs": 132.91, "Ba": 137.33, "La": 138.91, "Ce": 140.12, "Pr": 140.91, "Nd": 144.24,
    "Pm": 145.0, "Sm": 150.36, "Eu": 151.96, "Gd": 157.25, "Tb": 158.93, "Dy": 162.50, "Ho": 164.93, "Er": 167.26, "Tm": 168.93, "Yb": 173.05,
    "Lu": 174.97, "Hf": 178.49, "Ta": 180.95, "W": 183.84, "Re": 186.21, "Os": 190.23, "Ir": 192.22, "Pt": 195.08, "Au": 196.97, "Hg": 200.59,
    "Tl": 204.38, "Pb": 207.2, "Bi": 208.98, "Po": 209.0, "At": 210.0, "Rn": 222.0, "Fr": 223.0, "Ra": 226.0, "Ac": 227.0, "Th": 232.04,
    "Pa": 231.04, "U": 238.03, "Np": 237.0, "Pu": 244.0, "Am": 243.0, "Cm": 247.0, "Bk": 247.0, "Cf": 251.0, "Es": 252.0, "Fm": 257.0,
    "Md": 258.0, "No": 259.0, "Lr": 266.0, "Rf": 267.0, "Db": 268.0, "Sg": 269.0, "Bh": 270.0, "Hs": 269.0, "Mt": 278.0, "Ds": 281.0,
    "Rg": 282.0, "Cn": 285.0, "Nh": 286.0, "Fl": 289.0, "Mc": 290.0, "Lv": 293.0, "Ts": 294.0, "Og": 294.0,
}
#: Normal valences of the organic subset.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
#: The order of descriptors and regression targets.
DESCRIPTORS = [
    "molecular_mass", "formal_charge", "carbon_count", "hydrogen_count", "nitrogen_count", "oxygen_count", "phosphorus_count", "sulfur_count", "fluorine_count",
    "chlorine_count", "bromine_count", "iodine_count", "heavy_atom_count", "total_hydrogen_count", "ring_atom_count", "ring_bond_count", "connected_component_count", "aromatic_atom_count",
]
ELEMENT_COLUMNS = {"carbon_count": "C", "nitrogen_count": "N", "oxygen_count": "O", "phosphorus_count": "P", "sulfur_count": "S", "fluorine_count": "F", "chlorine_count": "Cl", "bromine_count": "Br", "iodine_count": "I"}

TOKEN = re.compile(r"(\[[^\]]*\])|(Br|Cl|[BCNOPSFI*]|[bcnops])|([-=#$:/\\~])|(%\(\d+\)|%\d\d|\d)|([().])")
BRACKET = re.compile(r"\[(\d+)?(\*|[A-Z][a-z]?|[a-z][a-z]?)(@{0,2}\w{0,0}(?:TH\d|AL\d|SP\d|TB\d+|OH\d+)?)(H\d*)?([+-]+\d*|\d*)?(?::\d+)?\]")
ORDER = {"-": 1, "/": 1, "\\": 1, "=": 2, "#": 3, "$": 4, ":": 4, "~": 1}
AROMATIC = 5

GRAPH = "struct<atoms:array<struct<element:string,charge:int,hydrogens:int,aromatic:boolean,near:array<struct<kind:int,other:int,bond:int>>>>,bonds:array<struct<a:int,b:int,kind:int>>,components:int,ring_atoms:int,ring_bonds:int,error:string>"


def read(smiles: str) -> tuple[list[list], list[list[int]], list[list[tuple[int, int]]], int, int, int]:
    """Atoms (element, charge, hydrogens, aromatic, bracket), bonds (two atoms, kind), each atom's neighbours (atom, bond), components, ring atoms and ring bonds of one molecule; raises ValueError."""
    atoms: list[list] = []
    bonds: list[list[int]] = []
    open_rings: dict[int, tuple[int, int | None]] = {}
    branches: list[int | None] = []
    last, order, at = None, None, 0
    joined: set[tuple[int, int]] = set()
    if not smiles:
        raise ValueError("no atoms")

    def bond(a: int, b: int, kind: int | None) -> None:
        if a == b or (min(a, b), max(a, b)) in joined:
            raise ValueError(f"bond of atoms {a} and {b} is given twice")
        joined.add((min(a, b), max(a, b)))
        bonds.append([a, b, kind or (AROMATIC if atoms[a][3] and atoms[b][3] else 1)])

    while at < len(smiles):
        m = TOKEN.match(smiles, at)
        if not m:
            raise ValueError(f"unexpected {smiles[at]!r} at {at}")
        at = m.end()
        bracket, organic, symbol, ring, mark = m.groups()
        if bracket:
            b = BRACKET.fullmatch(bracket)
            if not b:
                raise ValueError(f"bad atom {bracket}")
            name, h, charge = b[2], b[4], b[5] or ""
            element = name.capitalize() if name != "*" else "*"
            if element not in WEIGHTS and element != "*":
                raise ValueError(f"unknown element {name}")
            digits = charge.lstrip("+-")
            size = int(digits) if digits else len(charge)
            atoms.append([element, -size if charge.startswith("-") else size, (int(h[1:] or 1) if h else 0), name.islower(), True])
        elif organic:
            atoms.append([organic.capitalize(), 0, 0, organic.islower(), False])
        if bracket or organic:
            if last is not None:
                bond(last, len(atoms) - 1, order)
            last, order = len(atoms) - 1, None
        elif symbol:
            if order is not None or last is None:
                raise ValueError(f"unexpected bond at {at - 1}")
            order = ORDER[symbol] if symbol != ":" else AROMATIC
        elif ring:
            if last is None:
                raise ValueError("ring closure before an atom")
            k = int(ring.strip("%()"))
            if k in open_rings:
                other, kind = open_rings.pop(k)
                bond(other, last, order or kind)
            else:
                open_rings[k] = (last, order)
            order = None
        elif mark == "(":
            if last is None:
                raise ValueError("branch before an atom")
            branches.append(last)
        elif mark == ")":
            if not branches or order is not None:
                raise ValueError("unexpected )")
            last = branches.pop()
        else:
            if order is not None:
                raise ValueError("bond before a dot")
            last = None
    if branches or open_rings or order is not None or last is None:
        raise ValueError("open branch, ring or bond")
    near: list[list[tuple[int, int]]] = [[] for _ in atoms]
    for i, (a, b, _) in enumerate(bonds):
        near[a].append((b, i))
        near[b].append((a, i))
    double = double_bonds(atoms, bonds, near, AROMATIC)
    for k, b in enumerate(bonds):
        if b[2] == AROMATIC:
            b[2] = 2 if k in double else 1
    for i, atom in enumerate(atoms):
        if not atom[4] and atom[0] in VALENCES:
            used = sum(bonds[k][2] for _, k in near[i])
            choices = VALENCES[atom[0]][:1] if atom[3] else VALENCES[atom[0]]
            atom[2] = next((v - used for v in choices if v >= used), 0)
    components, bridges = _components_and_bridges(near)
    in_ring = [k for k in range(len(bonds)) if k not in bridges]
    atoms_found, bonds_found = aromatic_rings(atoms, bonds, near, set(in_ring))
    for i, atom in enumerate(atoms):
        atom[3] = i in atoms_found
    for k in bonds_found:
        bonds[k][2] = AROMATIC
    return atoms, bonds, near, components, len({x for k in in_ring for x in bonds[k][:2]}), len(in_ring)


def parse(smiles: str) -> dict:
    """Atoms, bonds, components and rings of one molecule by name; raises ValueError."""
    atoms, bonds, near, components, ring_atoms, ring_bonds = read(smiles)
    return {
        "atoms": [dict(zip(("element", "charge", "hydrogens", "aromatic"), a[:4], strict=True)) | {"near": [{"kind": bonds[k][2], "other": b, "bond": k} for b, k in near[i]]} for i, a in enumerate(atoms)],
        "bonds": [dict(zip(("a", "b", "kind"), b, strict=True)) for b in bonds],
        "components": components,
        "ring_atoms": ring_atoms,
        "ring_bonds": ring_bonds,
        "error": None,
    }


def _components_and_bridges(near: list[list[tuple[int, int]]]) -> tuple[int, set[int]]:
    """A bond is in a ring unless it is a bridge: no way back to the upper side from below it."""
    seen, low, bridges, components, clock = {}, {}, set(), 0, 0
    for root in range(len(near)):
        if root in seen:
            continue
        components += 1
        stack = deque([(root, -1, iter(near[root]))])
        seen[root] = low[root] = clock
        clock += 1
        while stack:
            v, via, rest = stack[-1]
            for w, k in rest:
                if k == via:
                    continue
                if w in seen:
                    low[v] = min(low[v], seen[w])
                else:
                    seen[w] = low[w] = clock
                    clock += 1
                    stack.append((w, k, iter(near[w])))
                    break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[v])
                    if low[v] > seen[up]:
                        bridges.add(via)
    return components, bridges


def _lists(sizes: list[int], values: pa.Array, missing: np.ndarray | None = None) -> pa.ListArray:
    """Lists of these sizes over the values, null where missing."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, values, mask=None if missing is None else pa.array(missing))


def _structs(rows: list, **types: pa.DataType) -> pa.StructArray:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def graphs(smiles: list[str]) -> pa.StructArray:
    """The graphs of molecules, as the columns of ``GRAPH``: flat lists of all atoms, neighbours and bonds with their ends."""
    atoms, near, bonds, n_atoms, n_near, n_bonds, whole, errors = [], [], [], [], [], [], [], []
    for x in smiles:
        try:
            own_atoms, own_bonds, own_near, *numbers = read(x)
        except ValueError as e:
            n_atoms.append(0)
            n_bonds.append(0)
            whole.append((None, None, None))
            errors.append(str(e))
            continue
        atoms += [a[:4] for a in own_atoms]
        bonds += own_bonds
        for n in own_near:
            near += [(own_bonds[k][2], j, k) for j, k in n]
            n_near.append(len(n))
        n_atoms.append(len(own_atoms))
        n_bonds.append(len(own_bonds))
        whole.append(numbers)
        errors.append(None)
    int32, missing = pa.int32(), np.array([e is not None for e in errors], bool)
    flat = _structs(atoms, element=pa.string(), charge=int32, hydrogens=int32, aromatic=pa.bool_())
    each = pa.StructArray.from_arrays([*flat.flatten(), _lists(n_near, _structs(near, kind=int32, other=int32, bond=int32))], ["element", "charge", "hydrogens", "aromatic", "near"])
    counts = _structs(whole, components=int32, ring_atoms=int32, ring_bonds=int32)
    columns = [_lists(n_atoms, each, missing), _lists(n_bonds, _structs(bonds, a=int32, b=int32, kind=int32), missing), *counts.flatten(), pa.array(errors, pa.string())]
    return pa.StructArray.from_arrays(columns, ["atoms", "bonds", "components", "ring_atoms", "ring_bonds", "error"])


def _graph(s: pa.Array) -> pa.Array:
    """Molecules that a batch has several times are parsed once."""
    coded = s.fill_null("").dictionary_encode()
    return graphs(coded.dictionary.to_pylist()).take(coded.indices)


def molecule_graph(smiles: Column) -> Column:
    """The graph as a struct, or its error.  Evaluated once a row: it is marked so that filters don't repeat it."""
    _graph.__annotations__ = {"s": pa.Array, "return": pa.Array}
    return F.arrow_udf(_graph, GRAPH).asNondeterministic()(smiles)


def _count(atoms: Column, test) -> Column:
    return F.size(F.filter(atoms, lambda a: test(a))).cast("int")


def descriptors(graph: Column) -> Column:
    """The struct of 18; the mass adds 32-bit floats in the order of atoms, an atom's hydrogens before it.  Null for a graph with an error."""
    atoms = graph["atoms"]
    table = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    weight = lambda a: F.coalesce(F.try_element_at(table, a["element"]), F.lit(0.0)).cast("float")
    mass = F.aggregate(atoms, F.lit(0.0).cast("float"), lambda m, a: ((m + a["hydrogens"].cast("float") * F.lit(WEIGHTS["H"]).cast("float")).cast("float") + weight(a)).cast("float"))
    attached = F.aggregate(atoms, F.lit(0), lambda n, a: n + a["hydrogens"])
    hydrogens = (attached + _count(atoms, lambda a: a["element"] == "H")).cast("int")
    values = {
        "molecular_mass": mass,
        "formal_charge": F.aggregate(atoms, F.lit(0), lambda n, a: n + a["charge"]),
        "hydrogen_count": hydrogens,
        "heavy_atom_count": _count(atoms, lambda a: ~a["element"].isin("H", "*")),
        "total_hydrogen_count": hydrogens,
        "ring_atom_count": graph["ring_atoms"],
        "ring_bond_count": graph["ring_bonds"],
        "connected_component_count": graph["components"],
        "aromatic_atom_count": _count(atoms, lambda a: a["aromatic"]),
    } | {c: _count(atoms, lambda a, e=e: a["element"] == F.lit(e)) for c, e in ELEMENT_COLUMNS.items()}
    return F.when(graph["error"].isNull(), F.struct(*(values[d].alias(d) for d in DESCRIPTORS)))


def regression_targets(d: Column, mass_scale: float = 1000.0, charge_scale: float = 8.0, count_scale: float = 128.0) -> Column:
    """The descriptors over their scales, in the fixed order."""
    if not all(0 < s < float("inf") for s in (mass_scale, charge_scale, count_scale)):
        raise ValueError("scales must be finite and positive")
    scales = {"molecular_mass": mass_scale, "formal_charge": charge_scale}
    return F.array(*((d[n].cast("float") / F.lit(scales.get(n, count_scale)).cast("float")).cast("float") for n in DESCRIPTORS))


def counted_fingerprint(molecules: DataFrame, graph: str = "graph", to: str = "fingerprint", radius: int = 2, size: int = 4096) -> DataFrame:
    """Adds struct<indices, counts, size>: how often atom environments up to the radius fall in each bin.

    An environment's code is a hash of its atom's code and of its neighbours' codes by bond, one
    radius less; it doesn't depend on the order of atoms.  Environments of the same bonds are one, the
    one of the least radius and then of the least code: around the atoms of a small molecule they
    soon are all its bonds.  (Atoms alone, of radius 0, count each.)  Within the row, without a shuffle.
    """
    if not 1 <= radius <= 255 or not 0 < size <= 65536:
        raise ValueError("radius must be 1 to 255 and size 1 to 65536")
    g = F.col(graph)
    first = F.transform(g["atoms"], lambda a: F.xxhash64(a["element"], a["charge"], a["hydrogens"], a["aromatic"], F.size(a["near"])))
    out = molecules.withColumn("__code0", first).withColumn("__set0", F.transform(g["atoms"], lambda a: F.array().cast("array<int>")))
    for r in range(1, radius + 1):
        before, grown = F.col(f"__code{r - 1}"), F.col(f"__set{r - 1}")
        code = F.transform(g["atoms"], lambda a, i: F.xxhash64(F.lit(r), F.get(before, i), F.array_sort(F.transform(a["near"], lambda b: F.xxhash64(b["kind"], F.get(before, b["other"]))))))
        own = F.transform(g["atoms"], lambda a: F.array_sort(F.array_distinct(F.concat(F.transform(a["near"], lambda b: b["bond"]), F.flatten(F.transform(a["near"], lambda b: F.get(grown, b["other"])))))))
        out = out.withColumn(f"__code{r}", code).withColumn(f"__set{r}", own)
    def environments(r: int) -> Column:
        return F.transform(f"__code{r}", lambda c, i: F.struct(F.get(f"__set{r}", i).alias("bonds"), F.lit(r).alias("r"), c.alias("code")))

    each = [environments(r) for r in range(1, radius + 1)]
    out = out.withColumn("__all", F.array_sort(F.filter(F.concat(*each), lambda x: F.size(x["bonds"]) > 0)))
    others = F.filter("__all", lambda x, i: (i == 0) | (F.get("__all", i - 1)["bonds"] != x["bonds"]))
    codes = F.concat("__code0", F.transform(others, lambda x: x["code"]))
    out = out.withColumn("__bins", F.array_sort(F.transform(codes, lambda c: F.pmod(c, F.lit(size)).cast("int"))))
    # Runs of equal bins: where they start, and how far it is to the next.
    starts = F.filter(F.transform("__bins", lambda b, i: i), lambda i: (i == 0) | (F.get("__bins", i - 1) != F.get("__bins", i)))
    out = out.withColumn("__starts", starts)
    indices = F.transform("__starts", lambda i: F.get("__bins", i))
    counts = F.transform("__starts", lambda i, k: F.least(F.coalesce(F.get("__starts", k + 1), F.size("__bins")) - i, F.lit(65535)))
    value = F.when(g["error"].isNull(), F.struct(indices.alias("indices"), counts.alias("counts"), F.lit(size).alias("size")))
    return out.withColumn(to, value).drop("__all", "__bins", "__starts", *(f"__{x}{r}" for x in ("code", "set") for r in range(radius + 1)))
