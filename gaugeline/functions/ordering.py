"""Repeatable pseudo-random order from a key and a seed (same digits in any SQL engine with md5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(key: str | Column, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def unit_hex(fraction: float) -> str:
    """Eight hex digits below which a digest prefix falls with the given probability."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    return "g" if fraction == 1 else f"{int(fraction * 16**8):08x}"


def below(key: str | Column, seed: int, fraction: float) -> Column:
    return F.substring(digest(key, seed), 1, 8) < F.lit(unit_hex(fraction))
