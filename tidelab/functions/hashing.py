"""Deterministic hash keys as pure column expressions (split keys, sampling keys)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a offset basis and prime, and the 2^32 - 1 normaliser.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
U32_MAX = 4294967295


def fnv1a_unit(*parts, sep: str = "|") -> Column:
    """FNV-1a (32 bit) over ``parts`` joined by ``sep``, scaled into [0, 1].

    Runs as a higher-order ``aggregate`` over the characters; ASCII input is assumed (the
    original hashes UTF-16 code units, ``ascii`` returns the code point).
    """
    text = F.concat_ws(sep, *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("long"))
    h = F.aggregate(
        codes,
        F.lit(FNV_OFFSET).cast("long"),
        lambda acc, code: ((acc.bitwiseXOR(code)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(U32_MAX)),
    )
    return h.cast("double") / F.lit(float(U32_MAX))


def md5_key(seed, key) -> Column:
    """First 15 hex digits of ``md5(seed || '|' || key)`` as a non-negative bigint."""
    text = F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def md5_unit(seed, key) -> Column:
    """``md5_key`` scaled into [0, 1)."""
    return md5_key(seed, key).cast("double") / F.lit(float(16 ** 15))
