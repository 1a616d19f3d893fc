"""Deterministic split of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(key: Column) -> Column:
    """The first four bytes of the key's SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def assign_split(key: Column, held_out_ratio: float) -> Column:
    """held_out for a share of the keys, else public; the same key always gets the same answer."""
    if not 0 <= held_out_ratio <= 1:
        raise ValueError(f"held_out_ratio must be within 0 and 1, not {held_out_ratio}")
    return F.when(unit_hash(key) < held_out_ratio, "held_out").otherwise("public")
