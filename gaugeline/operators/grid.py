"""Irregular samples -> one gap-free, optionally forward-filled grid per entity, with history features.

The raw rows are reduced to bins by one pre-aggregated shuffle on (entity, bin). Everything order-sensitive
then runs in one more shuffle on (entity, part), where a part is a fixed number of consecutive bins plus as
many earlier bins as the longest history feature looks back. No task ever holds more than one part of an
entity, so a single very long or very dense series is spread like any other data. What a part must know of
the time before it (the last known values) comes from a small per-part summary, which is unioned in as one
extra row at the part's beginning.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions import durations, timecols
from gaugeline.functions.durations import DAY_US, MICROS, Feature
from gaugeline.operators.lookup import attach

PART_ROWS = 65_536


def value_columns(df: DataFrame, entity: str, ts: str, skip=()) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the string columns besides the keys."""
    fields = [f for f in df.schema.fields if f.name not in (entity, ts, *skip)]
    return (
        [f.name for f in fields if isinstance(f.dataType, T.NumericType)],
        [f.name for f in fields if isinstance(f.dataType, T.StringType)],
    )


def bins(df, entity: str, ts: str, step, numeric=(), strings=(), order=()) -> DataFrame:
    """Non-empty bins: ``(entity, _origin, _bin, *numeric, *strings)``; bin start = _origin + _bin * step.

    Numbers are averaged, strings take the first non-null value by time (ties by ``order``). Bins count from
    midnight of the entity's first day. When the step divides a day, any midnight will do. Otherwise rows are
    first reduced to the finest bins that fit both the step and a day, and only those meet the entity's origin.
    """
    size = durations.micros(step)
    fine = gcd(size, DAY_US)
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in numeric]
    rows = df.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(
        entity, timecols.to_micros(ts).alias("_us"), *clean, *strings, *[o for o in order if o not in strings]
    )
    rows = rows.withColumn("_bin", timecols.floor_div(F.col("_us"), fine))
    rank = F.struct("_us", *order)
    firsts = {c: F.when(F.col(c).isNotNull(), rank) for c in strings}

    if fine == size:
        aggs = [F.avg(c).alias(c) for c in numeric] + [F.min_by(c, firsts[c]).alias(c) for c in strings]
        return _grouped(rows, [entity, "_bin"], aggs).select(
            entity, F.lit(0).cast("bigint").alias("_origin"), "_bin", *numeric, *strings
        )

    aggs = [F.sum(c).alias(c) for c in numeric] + [F.count(c).alias(f"_n_{c}") for c in numeric]
    aggs += [F.min_by(c, firsts[c]).alias(c) for c in strings] + [F.min(firsts[c]).alias(f"_at_{c}") for c in strings]
    small = _grouped(rows, [entity, "_bin"], aggs)
    per_day = DAY_US // fine
    origins = small.groupBy(entity).agg(
        (timecols.floor_div(F.min("_bin"), per_day) * per_day).alias("_first"), F.count("*").alias("_rows")
    )
    placed = attach(small, origins, entity, "_rows", [entity, "_bin"])
    placed = placed.withColumn("_bin", timecols.floor_div(F.col("_bin") - F.col("_first"), size // fine))
    placed = placed.withColumn("_origin", F.col("_first") * fine)
    aggs = [F.try_divide(F.sum(c), F.sum(f"_n_{c}")).alias(c) for c in numeric]
    aggs += [F.min_by(c, f"_at_{c}").alias(c) for c in strings]
    return _grouped(placed, [entity, "_origin", "_bin"], aggs).select(entity, "_origin", "_bin", *numeric, *strings)


def regular(
    df,
    entity: str,
    ts: str,
    step,
    numeric=(),
    strings=(),
    order=(),
    fill: bool = True,
    max_fill=None,
    history: list[Feature] = (),
    target: str | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Gap-free grid ``(entity, ts, *numeric, *strings, *history)`` from each entity's first to last bin.

    ``fill`` carries the last known value of every column forward, without limit or, with ``max_fill``, at
    most that long. History features of ``target`` read the filled grid.
    """
    numeric, strings = list(numeric), list(strings)
    values = numeric + strings
    if history and (target is None or target not in numeric):
        raise ValueError("history features need a numeric target")
    unit = durations.seconds(step)
    on_grid = [f for f in history if f.shift % unit == 0]
    back = max([f.rows_back(unit) for f in on_grid], default=0)
    size = max(part_rows, back)
    limit = durations.seconds(max_fill) // unit if fill and max_fill is not None else None

    found = bins(df, entity, ts, step, numeric, strings, order)
    # With a fill limit each carried value travels with the bin it came from.
    states = {c: F.struct(F.col(c).alias("v"), F.col("_bin").alias("at")) if limit is not None else F.col(c) for c in values}
    body = found.select(
        entity, "_origin", "_bin", *[F.when(F.col(c).isNotNull(), s).alias(c) for c, s in states.items()]
    )
    body = body.withColumn("_seg", timecols.floor_div(F.col("_bin") + back, size))
    # Both branches read the same columns, so the raw table is reduced to bins only once.
    heads = _heads(body, entity, values, size, back)

    part = F.col("_seg")
    if back:  # bins shortly before a part's first own bin are also read by that part
        part = F.explode(
            F.when(F.col("_bin") < F.col("_seg") * size, F.array(F.col("_seg") - 1, F.col("_seg"))).otherwise(F.array("_seg"))
        )
    body = body.withColumn("_part", part).withColumns({"_end": F.lit(None).cast("bigint"), "_body": F.lit(True)})
    cols = [entity, "_origin", "_part", "_bin", "_end", "_body", *values]
    both = body.select(cols).unionByName(heads.withColumn("_body", F.lit(False)).select(cols))
    # A bin can grow into many grid rows further down, so the partition count must not be derived from the size
    # of the bins: a stated number keeps adaptive execution from merging these partitions.
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(slots, entity, "_origin", "_part")

    in_part = Window.partitionBy(entity, "_origin", "_part")
    ordered = in_part.orderBy("_bin", "_body")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = {c: F.last(c, ignorenulls=True).over(so_far) if fill else F.col(c) for c in values}
    both = both.select(
        entity, "_origin", "_part", "_bin", "_body", *[s.alias(c) for c, s in state.items()],
        F.coalesce(F.lead("_bin").over(ordered), F.max("_end").over(so_far)).alias("_next"),
    )
    grid = both.filter("_next > _bin").withColumn("_at", F.explode(F.sequence(F.col("_bin"), F.col("_next") - 1)))
    if limit is not None:
        grid = grid.withColumns({c: F.when(F.col("_at") - F.col(c)["at"] <= limit, F.col(c)["v"]) for c in values})
    elif not fill:
        own = F.col("_body") & (F.col("_at") == F.col("_bin"))
        grid = grid.withColumns({c: F.when(own, F.col(c)) for c in values})

    made = []
    by_time = in_part.orderBy("_at")
    for f in history:
        if f not in on_grid:
            made.append(F.lit(None).cast("double").alias(f.name))
            continue
        lag = f.shift // unit
        if f.window is None:
            made.append(F.lag(target, lag).over(by_time).alias(f.name))
        else:
            frame = by_time.rowsBetween(-(lag + f.window_rows(unit) - 1), -lag)
            made.append(F.avg(target).over(frame).alias(f.name))
    if made:
        grid = grid.select("*", *made)
    if back:
        grid = grid.filter(F.col("_at") >= F.col("_part") * size)
    when = timecols.from_micros(F.col("_origin") + F.col("_at") * (unit * MICROS)).alias(ts)
    return grid.select(entity, when, *values, *[f.name for f in history])


def _heads(body: DataFrame, entity: str, values: list[str], size: int, back: int) -> DataFrame:
    """One row per (entity, part): where it begins, where it ends, and the values known just before it."""
    last_known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_bin"))).alias(c) for c in values]
    segments = _grouped(
        body, [entity, "_origin", "_seg"], [F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"), *last_known]
    )
    whole = Window.partitionBy(entity, "_origin")
    w = whole.orderBy("_seg")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segments = segments.select(
        entity, "_origin", "_seg", *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in values],
        F.min("_lo").over(whole).alias("_first"), F.max("_hi").over(whole).alias("_last"),
        F.lead("_seg").over(w).alias("_next_seg"), F.row_number().over(w).alias("_nr"),
    )
    last_part = timecols.floor_div(F.col("_last"), size)
    start = F.when(F.col("_nr") == 1, timecols.floor_div(F.col("_first"), size)).otherwise(F.col("_seg") + 1)
    stop = F.least(F.coalesce("_next_seg", last_part), last_part)
    parts = segments.withColumns({"_from": start, "_to": stop}).filter("_from <= _to")
    parts = parts.withColumn("_part", F.explode(F.sequence("_from", "_to")))
    after = F.col("_part") > F.col("_seg")
    return parts.select(
        entity, "_origin", "_part",
        F.greatest(F.col("_part") * size - back, F.col("_first")).alias("_bin"),
        F.least((F.col("_part") + 1) * size, F.col("_last") + 1).alias("_end"),
        *[F.when(after, F.col(c)).alias(c) for c in values],
    )


def resample_mean(df, entity: str, ts: str, step, numeric, **kw) -> DataFrame:
    """Averages per bin with empty bins present and null."""
    return regular(df, entity, ts, step, numeric=numeric, fill=False, **kw)


def _grouped(df: DataFrame, keys: list[str], aggs: list) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
