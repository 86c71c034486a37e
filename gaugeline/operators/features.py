"""Calendar and history features, row survival checks, and the full transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions import durations, timecols
from gaugeline.operators import clean
from gaugeline.operators import grid as g


def add_calendar(df: DataFrame, ts: str, names=durations.CALENDAR) -> DataFrame:
    return df.withColumns({n: timecols.calendar_part(n, ts) for n in names})


def history_exact(df: DataFrame, entity: str, ts: str, target: str, name: str) -> DataFrame:
    """History feature on samples that were not resampled: exists only where a sample lies exactly one shift
    earlier. Time of one sample per (entity, ts) is assumed, as in any indexed series."""
    f = durations.feature(name)
    past = df.select(entity, ts, F.col(target).alias("_value"))
    if f.window is not None:
        past = _trailing_mean(past, entity, ts, f.window)
    past = past.select(entity, timecols.shift(ts, f.shift).alias(ts), F.col("_value").alias(f.name))
    return df.join(past, [entity, ts], "left").select(*df.columns, f.name)


def _trailing_mean(past: DataFrame, entity: str, ts: str, window: int) -> DataFrame:
    """Mean over (t - window, t] per row. A row is visible in its own block of time and in the next one, so a
    task sees two blocks of one entity and never its whole series."""
    width = window * durations.MICROS
    rows = past.withColumn("_us", timecols.to_micros(ts)).withColumn("_own", timecols.floor_div(F.col("_us"), width))
    rows = rows.withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(entity, "_block").orderBy("_us").rangeBetween(-(width - 1), 0)
    return rows.withColumn("_value", F.avg("_value").over(w)).filter("_block = _own").select(entity, ts, "_value")


def drop_incomplete(df: DataFrame, features: list[str]) -> DataFrame:
    """Drop rows with a null in any feature; the target may be null."""
    return df.dropna(subset=features) if features else df


def survival(df: DataFrame, entity: str, features: list[str]) -> DataFrame:
    """Per entity: rows before and after dropping incomplete ones, and whether more than half were lost."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    counts = df.groupBy(entity).agg(F.count("*").alias("before"), F.count_if(whole).alias("after"))
    return counts.select(
        entity, "before", "after", (F.col("before") - F.col("after")).alias("dropped"),
        (F.col("after") * 2 < F.col("before")).alias("warn"),
    )


def transform(
    df: DataFrame,
    entity: str,
    ts: str,
    target: str,
    names: list[str],
    step="15min",
    numeric_only: bool = False,
    drop: bool = True,
    fill: bool = True,
    order=(),
    part_rows: int = g.PART_ROWS,
) -> DataFrame:
    """Raw samples of all entities -> ``(entity, ts, *features, target)`` on the grid, complete rows only.

    Only the columns that are asked for are read. ``numeric_only`` leaves string columns out, as the
    single-series mode does. ``step=None`` skips resampling. The entity itself may be named as a feature.
    """
    wanted = durations.features(names)
    raw = [f.name for f in wanted if f.kind == "raw" and f.name not in (entity, target)]
    missing = [c for c in [entity, ts, target, *raw] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the input: {missing}")
    df = df.select(*dict.fromkeys([entity, ts, target, *raw, *order]))
    history = [f for f in wanted if f.kind == "history"]
    flags = [f.name for f in df.schema.fields if f.name in raw and isinstance(f.dataType, T.BooleanType)]
    df = df.withColumns({c: F.col(c).cast("int").cast("double") for c in flags})  # averaged as 0 and 1
    if step is None:
        made = clean.nan_to_null(df)
        for f in history:
            made = history_exact(made, entity, ts, target, f.name)
    else:
        numeric, strings = g.value_columns(df.select(entity, ts, target, *raw), entity, ts)
        if numeric_only:
            strings = []
        made = g.regular(
            df, entity, ts, step, numeric, strings, order,
            fill=fill, history=history, target=target, part_rows=part_rows,
        )
    made = add_calendar(made, ts, [f.name for f in wanted if f.kind == "calendar"])
    kept = [f.name for f in wanted]
    missing = [c for c in kept if c not in made.columns]
    if missing:
        raise ValueError(f"features that cannot be made from this table: {missing}")
    if drop:
        made = drop_incomplete(made, kept)
    return made.select(*dict.fromkeys([entity, ts, *kept, target]))
