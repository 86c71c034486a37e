"""Zone-free time arithmetic: timestamps without zone as microseconds since 1970 and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_micros(ts: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _col(ts))


def from_micros(us: str | Column) -> Column:
    return F.timestamp_add("MICROSECOND", _col(us), F.expr(_EPOCH))


def floor_div(value: Column, size: int | Column) -> Column:
    """Integer division rounding down, also below zero; stays BIGINT."""
    size = F.lit(size).cast("bigint") if isinstance(size, int) else size
    return F.call_function("div", value - F.pmod(value, size), size)


def shift(ts: str | Column, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds).cast("bigint"), _col(ts))


def calendar_part(name: str, ts: str | Column) -> Column:
    """month, day, weekday (Monday = 0), hour, minute."""
    part = {"month": F.month, "day": F.dayofmonth, "weekday": F.weekday, "hour": F.hour, "minute": F.minute}
    return part[name](_col(ts))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
