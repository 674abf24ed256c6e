"""Deterministic, engine-portable randomness.

All sampling, shuffling, splitting and masking in retort is keyed by
``md5(concat_ws('|', seed, key...))``.  md5 is a built-in in Spark and in
common SQL engines, so a split made here can be re-derived elsewhere, and a
re-run gives the same rows whatever the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed: int, *cols) -> Column:
    """32-hex md5 of 'seed|k1|k2..' — a sort key for a seeded random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def hash_u32(seed: int, *cols) -> Column:
    """First 8 hex digits of the md5 key as an integer in [0, 2^32)."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("bigint")


def hash_unit(seed: int, *cols) -> Column:
    """Uniform double in [0, 1) from the md5 key."""
    return hash_u32(seed, *cols) / F.lit(4294967296.0)


def md5_u32(text) -> Column:
    """First 8 hex digits of md5(text) as an integer."""
    return F.conv(F.substring(F.md5(_c(text)), 1, 8), 16, 10).cast("bigint")
