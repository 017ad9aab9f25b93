"""String hashes as columns, for fingerprints that other programs store: FNV-1a, djb2, and SHA-256 of canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = 0xFFFFFFFF
# Start and factor of FNV-1a (32 bits), start of djb2.
FNV_START, FNV_PRIME, DJB_START = 2166136261, 16777619, 5381


def code_units(c: Column) -> Column:
    """The UTF-16 code units of a string; characters beyond the basic plane are two."""
    point = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    pair = lambda p: F.array(0xD800 + F.shiftright(p - 0x10000, 10), 0xDC00 + (p - 0x10000).bitwiseAND(F.lit(0x3FF)))
    return F.flatten(F.transform(point, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(pair(p))))


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, as a long."""
    return F.aggregate(code_units(c), F.lit(FNV_START).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(_WORD)))


def djb2(c: Column) -> Column:
    """djb2 (times 33 plus), 32 bits, as a long."""
    return F.aggregate(code_units(c), F.lit(DJB_START).cast("long"), lambda h, u: (h * 33 + u).bitwiseAND(F.lit(_WORD)))


def hex32(h: Column) -> Column:
    return F.lower(F.hex(h))


def _ordered(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType)) if isinstance(kind.elementType, (T.StructType, T.ArrayType)) else c
    return c


def canonical_json(c: Column, kind: T.StructType) -> Column:
    """JSON of a struct with the fields of every level in order of their names, nulls written."""
    return F.to_json(_ordered(c, kind), {"ignoreNullFields": "false"})


def canonical_sha256(c: Column, kind: T.StructType) -> Column:
    return F.sha2(canonical_json(c, kind), 256)
