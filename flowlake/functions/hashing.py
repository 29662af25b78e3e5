"""Seeded hash keys that any SQL engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52


def hash_key(column: Column, seed: int) -> Column:
    """52-bit non-negative hash of a key: first 13 hex digits of an MD5."""
    text = F.concat(column.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def hash_unit(column: Column, seed: int) -> Column:
    """Uniform number in [0, 1) derived from :func:`hash_key`."""
    return hash_key(column, seed) / F.lit(float(2 ** HASH_BITS))
