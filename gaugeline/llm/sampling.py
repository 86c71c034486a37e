"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id's text modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % divisor


def labelled(labels: DataFrame, id_col: str, label_col: str, divisor: int, held: int, limit: int) -> DataFrame:
    """At most ``limit`` rows ``(doc, label)`` of the learning folds, the same for the same labels.

    Ids with differing labels, null ids and null labels are left out.
    """
    rows = labels.where(remainder(id_col, divisor) != held).where(F.col(f"`{label_col}`").isin(0, 1))
    rows = rows.groupBy(F.col(f"`{id_col}`").alias("doc")).agg(F.min(f"`{label_col}`").cast("int").alias("label"), F.max(f"`{label_col}`").alias("other")).where("label = other")
    return rows.orderBy(F.xxhash64("doc"), "doc").limit(limit).select("doc", "label")
