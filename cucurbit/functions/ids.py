"""Stable molecule ids and the train/validation split, as Catalyst expressions.

Ids are unsigned 64-bit numbers held as the bits of a long.  ANSI mode forbids overflow, so sums
and products modulo 2**64 go by limbs.  ``let`` names each step, or the expression would double
in size with every use of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The constants of splitmix64 and of 64-bit FNV-1a.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: The top bits of the id spaces.
ZINC_BIT, HASH_BIT, HASH_MASK = 1 << 63, 1 << 62, (1 << 62) - 1
ZINC_MOST, SUFFIX_MOST = (1 << 48) - 1, 0x7FFF

M32 = 0xFFFFFFFF


def signed(x: int) -> int:
    """The long with the bits of an unsigned number."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _long(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def _low(x: Column) -> Column:
    return x.bitwiseAND(_long(M32))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2**64; a and b are used twice."""
    return let(_low(a) + _low(b), lambda low: F.shiftleft(_low(_high(a) + _high(b) + _high(low)), 32).bitwiseOR(_low(low)))


def _times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers."""
    upper = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(_long(0xFFFF))
    return _low(F.shiftleft(upper, 16) + a.bitwiseAND(_long(0xFFFF)) * b)


def mul64(a: Column, k: int) -> Column:
    """a * k modulo 2**64."""
    kl, kh = _long(k & M32), _long(k >> 32)

    def product(v: Column) -> Column:
        al, ah = _low(v), _high(v)
        high = _low(_times32(ah, kl) + _times32(al, kh))
        upper, lower = F.shiftleft(F.shiftrightunsigned(al, 16) * kl, 16), al.bitwiseAND(_long(0xFFFF)) * kl
        return let(add64(upper, lower), lambda low: add64(low, F.shiftleft(high, 32)))

    return let(a, product)


def _xor_shifted(x: Column, n: int) -> Column:
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)))


def splitmix64(x: Column) -> Column:
    z = let(x, lambda v: add64(v, _long(GOLDEN)))
    z = mul64(_xor_shifted(z, 30), MIX_1)
    z = mul64(_xor_shifted(z, 27), MIX_2)
    return _xor_shifted(z, 31)


def unsigned_mod(x: Column, m: int) -> Column:
    """x % m with x read as unsigned; m below 2**31."""
    return let(x, lambda v: (_high(v) % m * ((1 << 32) % m) + _low(v) % m) % m)


def unsigned(x: Column) -> Column:
    """The unsigned number as decimal(20,0), to show or order by."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def split_for_id(stable_id: Column, validation_permille: int = 100) -> Column:
    """'validation' for so many of a thousand ids, else 'train'."""
    if not 0 <= validation_permille <= 1000:
        raise ValueError(f"validation_permille must be 0 to 1000: {validation_permille}")
    return F.when(unsigned_mod(splitmix64(stable_id), 1000) < validation_permille, "validation").otherwise("train")


def zinc_id(record_id: Column) -> Column:
    """ZINC<number>[_<suffix>] packed into bit 63, 15 bits of suffix and 48 of number; null if it is no such id."""
    number = F.regexp_extract(record_id, r"^ZINC\+?([0-9]+)(?:_\+?([0-9]+))?$", 1)
    suffix = F.regexp_extract(record_id, r"^ZINC\+?([0-9]+)(?:_\+?([0-9]+))?$", 2)
    n, s = number.try_cast("long"), F.when(suffix == "", F.lit(0)).otherwise(suffix.try_cast("long"))
    return F.when((n <= ZINC_MOST) & (s <= SUFFIX_MOST), _long(ZINC_BIT).bitwiseOR(F.shiftleft(s, 48)).bitwiseOR(n))


def pubchem_id(record_id: Column) -> Column:
    """A record id that is an unsigned 64-bit number, as a long; else null."""
    d = F.when(record_id.rlike(r"^\+?[0-9]+$"), record_id).try_cast("decimal(38,0)")
    top = F.lit("9223372036854775807").cast("decimal(38,0)")
    wrapped = (d - F.lit("18446744073709551616").cast("decimal(38,0)")).try_cast("long")
    return F.when(d <= top, d.try_cast("long")).when(d <= F.lit("18446744073709551615").cast("decimal(38,0)"), wrapped)


def fnv1a64(*parts: Column) -> Column:
    """64-bit FNV-1a over the UTF-8 bytes of the strings, with a byte 255 between two."""
    digits = F.concat_ws("FF", *(F.hex(F.encode(p, "UTF-8")) for p in parts))
    values = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(values, _long(FNV_OFFSET), lambda h, b: mul64(h.bitwiseXOR(b), FNV_PRIME))


def stable_molecule_id(dataset: Column, record_id: Column) -> Column:
    """The number itself for PubChem, packed for ZINC20, else a hash with top bits 01."""
    hashed = splitmix64(fnv1a64(dataset, record_id)).bitwiseAND(_long(HASH_MASK)).bitwiseOR(_long(HASH_BIT))
    known = F.when(dataset == "pubchem-smiles", pubchem_id(record_id)).when(dataset == "zinc20-smiles", zinc_id(record_id))
    return F.coalesce(known, hashed)


def record_status(dataset: Column, record_id: Column) -> Column:
    """'error' for a PubChem or ZINC20 record whose id can't be read, else 'ok'."""
    bad = ((dataset == "pubchem-smiles") & pubchem_id(record_id).isNull()) | ((dataset == "zinc20-smiles") & zinc_id(record_id).isNull())
    return F.when(bad, "error").otherwise("ok")


# -- the same for single values, for functions registered under SQL names -------------------------------


def splitmix64_of(x: int) -> int:
    m = (1 << 64) - 1
    z = (x + GOLDEN) & m
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        z = ((z ^ z >> shift) * factor) & m
    return z ^ z >> 31


def stable_id_of(dataset: str | None, record_id: str | None) -> int | None:
    """The id as a long; null for a null."""
    if dataset is None or record_id is None:
        return None
    if dataset == "pubchem-smiles" and re.fullmatch(r"\+?[0-9]+", record_id) and int(record_id) < 1 << 64:
        return signed(int(record_id))
    if dataset == "zinc20-smiles" and (m := re.fullmatch(r"ZINC\+?([0-9]+)(?:_\+?([0-9]+))?", record_id)):
        n, suffix = int(m[1]), int(m[2] or 0)
        if n <= ZINC_MOST and suffix <= SUFFIX_MOST:
            return signed(ZINC_BIT | suffix << 48 | n)
    h = FNV_OFFSET
    for b in dataset.encode() + b"\xff" + record_id.encode():
        h = ((h ^ b) * FNV_PRIME) & ((1 << 64) - 1)
    return HASH_BIT | splitmix64_of(h) & HASH_MASK
