"""Average absolute error as plain aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(predict, actual) -> tuple[Column, Column]:
    p = F.col(predict) if isinstance(predict, str) else predict
    a = F.col(actual) if isinstance(actual, str) else actual
    known = p.isNotNull() & a.isNotNull()
    return F.when(known, F.abs(p - a)), F.when(known, F.greatest(p, a))


def ratio(predict="predict", actual="actual") -> Column:
    """|p-a| / max(p,a); 0/0 is null (skipped by averages), n/0 is infinite."""
    num, den = _parts(predict, actual)
    return F.when((den == 0) & (num > 0), F.lit(float("inf"))).otherwise(F.try_divide(num, den))


def ratio_zero(predict="predict", actual="actual") -> Column:
    """Same, but a zero denominator counts as no error."""
    num, den = _parts(predict, actual)
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num, den))


def aae(predict="predict", actual="actual") -> Column:
    return F.avg(ratio(predict, actual))


def aae_zero(predict="predict", actual="actual") -> Column:
    return F.avg(ratio_zero(predict, actual))
