"""Order-independent membership hash (FNV-1a, 32 bit) of a set of codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: FNV-1a 32-bit parameters
OFFSET_BASIS = 0x811C9DC5
PRIME = 0x01000193
MASK = 0xFFFFFFFF


def _fold(hash_so_far: Column, text: Column) -> Column:
    characters = F.split(text, "")
    return F.reduce(
        F.filter(characters, lambda c: c != ""),
        hash_so_far,
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long").bitwiseAND(F.lit(255))) * PRIME).bitwiseAND(F.lit(MASK)),
    )


def membership_hash(codes: Column) -> Column:
    """Hash of an array of codes, sorted, each followed by a comma."""
    joined = F.transform(F.array_sort(codes), lambda c: F.concat(c, F.lit(",")))
    value = F.reduce(joined, F.lit(OFFSET_BASIS).cast("long"), _fold)
    return F.concat(F.lit("fnv1a32:"), F.lpad(F.lower(F.hex(value)), 8, "0"))
