"""Daily views of predicted against actual values, and their errors.

Input everywhere: a prediction frame ``(entity, ts, predict, actual)`` on a grid, so one entity has at most
86,400 / step rows per day. That bounds every (entity, day) group, including the exact percentiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import errors
from gaugeline.operators import grid, perbin

ALL_VIEWS = ("original", "percentile", "std", "variance", "busy_hour", "busy_avg")
SERIES = ("predict", "actual")


def hourly_means(pred: DataFrame, entity: str = "entity", ts: str = "ts", series=SERIES) -> DataFrame:
    """Hourly averages with empty hours present and null."""
    return grid.resample_mean(pred, entity, ts, "1h", list(series))


def forward_average(hourly: DataFrame, column: str, name: str, entity: str = "entity", ts: str = "ts", period: int = 4):
    """For each hour the mean of it and the next ``period - 1`` hours, cut off at the end of the day."""
    day = F.to_date(ts)
    w = Window.partitionBy(entity, day).orderBy(ts).rowsBetween(0, period - 1)
    return hourly.withColumn(name, F.avg(column).over(w))


def _best(series: str, mode: str) -> Column:
    """The best (score, hour) of a day, from ``_scores``: forward averages by start hour, ``_from.._to``.

    ``argmax``: highest score, earliest hour on ties, unknown scores ignored. ``reference``: running comparison in
    which a best score of zero is replaced by whatever follows and a leading unknown score stays.
    """
    if mode == "argmax":
        known = F.filter("_scores", lambda s: s[series].isNotNull() & (s["start"] >= F.col("_from")))
        return F.array_max(F.transform(known, lambda s: F.struct(s[series].alias("score"), (-s["start"]).alias("back"))))
    if mode == "reference":

        def score(h):
            here = F.filter("_scores", lambda s: s["start"] == h)
            return F.struct(F.get(here, 0)[series].alias("score"), (-h).alias("back"))

        return F.aggregate(
            F.transform(F.sequence("_from", "_to"), score),
            F.lit(None).cast("struct<score:double,back:int>"),
            lambda acc, x: F.when(acc.isNull() | (acc["score"] == 0) | (x["score"] > acc["score"]), x).otherwise(acc),
        )
    raise ValueError(f"unknown mode {mode!r}")


def _day_scores(placed: DataFrame, entity: str, period: int) -> DataFrame:
    """Per (entity, day) the forward averages of all start hours that reach a known hour, at most 24.

    Every hour counts for itself and the ``period - 1`` start hours before it, also where those hours are empty.
    """
    hours = placed.groupBy(entity, "_day", "_hour").agg(*[F.avg(c).alias(c) for c in SERIES])
    starts = F.sequence(F.greatest(F.col("_hour") - (period - 1), F.lit(0)), F.col("_hour"))
    scores = hours.withColumn("start", F.explode(starts)).groupBy(entity, "_day", "start").agg(
        F.min("_hour").alias("_hour"), *[F.avg(c).alias(c) for c in SERIES]
    )
    return scores.groupBy(entity, "_day").agg(
        F.collect_list(F.struct("start", *SERIES)).alias("_scores"), F.min("_hour").alias("_min"), F.max("start").alias("_max")
    )


def _by_day(pred: DataFrame, entity: str, ts: str) -> DataFrame:
    rows = pred.select(entity, ts, F.to_date(ts).alias("_day"), *SERIES)
    return rows.filter(F.col(entity).isNotNull() & F.col("_day").isNotNull()).repartition(entity, "_day")


def daily(pred: DataFrame, entity: str = "entity", ts: str = "ts", pctile: int = 95, busy: int = 4, mode: str = "argmax",
          views=ALL_VIEWS, custom: dict[str, perbin.BinFunction] | None = None) -> DataFrame:
    """One wide row per (entity, day), days without data included; a struct (predict, actual) per view.

    ``custom`` adds a view per entry, a function of a day's values in time order. Predictions are shuffled once, by (entity, day); the day
    and hour aggregates and the functions read that shuffle.
    """
    placed = _by_day(pred, entity, ts)
    both = {
        "percentile": lambda c: F.percentile(c, F.lit(pctile / 100)),
        "std": F.stddev_pop,
        "variance": F.var_pop,
    }
    chosen = {v: f for v, f in both.items() if v in views}
    custom = custom or {}
    taken = set(custom) & set(ALL_VIEWS)
    if taken:
        raise ValueError(f"views {sorted(taken)} are built in")
    wants_busy = "busy_hour" in views or "busy_avg" in views
    stats = None
    if chosen or not wants_busy:
        stats = placed.groupBy(entity, "_day").agg(
            F.max(ts).alias("_seen"), *[F.struct(*[f(c).alias(c) for c in SERIES]).alias(v) for v, f in chosen.items()]
        )
    if wants_busy:
        hours = _day_scores(placed.withColumn("_hour", F.hour(ts)), entity, busy)
        stats = hours if stats is None else stats.join(hours, [entity, "_day"])
    if custom:
        stats = stats.join(perbin.per_group(placed, [entity, "_day"], ts, list(SERIES), custom), [entity, "_day"])
    if "_seen" in stats.columns:  # keeps the shuffled columns equal in all branches, so there is one shuffle
        stats = stats.withColumn("_day", F.to_date("_seen"))
    w = Window.partitionBy(entity).orderBy("_day")
    stats = stats.withColumns({"_next": F.lead("_day").over(w), "_nr": F.row_number().over(w)})
    until = F.coalesce(F.date_sub("_next", 1), F.col("_day"))
    days = stats.withColumn("_date", F.explode(F.sequence("_day", until, F.expr("interval 1 day"))))
    own = F.col("_date") == F.col("_day")
    days = days.withColumns({v: F.when(own, F.col(v)) for v in (*chosen, *custom)})
    if wants_busy:
        first, last = own & (F.col("_nr") == 1), F.col("_next").isNull()
        none = F.array().cast(days.schema["_scores"].dataType)
        days = days.withColumns({
            "_scores": F.when(own, F.col("_scores")).otherwise(none),
            "_from": F.when(first, F.col("_min")).otherwise(0),
            "_to": F.when(last, F.col("_max")).otherwise(23),
        })
        days = days.withColumns({f"_{c}": _best(c, mode) for c in SERIES})
        days = days.withColumns({
            "busy_hour": F.struct(*[(-F.col(f"_{c}")["back"]).cast("double").alias(c) for c in SERIES]),
            "busy_avg": F.struct(*[F.col(f"_{c}")["score"].alias(c) for c in SERIES]),
        })
    kept = [v for v in ALL_VIEWS if v in views and v != "original"] + list(custom)
    return days.select(entity, F.col("_date").cast("timestamp_ntz").alias(ts), *kept)


def view_name(view: str, pctile: int = 95, busy: int = 4) -> str:
    if view == "percentile":
        return f"percentile_{pctile}"
    return f"{view}_{busy}H" if view.startswith("busy") else view


def build(pred: DataFrame, entity: str = "entity", ts: str = "ts", pctile: int = 95, busy: int = 4, mode: str = "argmax",
          views=ALL_VIEWS, custom: dict[str, perbin.BinFunction] | None = None) -> DataFrame:
    """All chosen views, and one per entry of ``custom``, as one long table ``(entity, view, ts, predict, actual)``."""
    unknown = set(views) - set(ALL_VIEWS)
    if unknown:
        raise ValueError(f"unknown views: {sorted(unknown)}")
    parts = []
    built_in = [v for v in ALL_VIEWS if v in views and v != "original"]
    by_day = built_in + list(custom or {})
    if "original" in views:
        rows = _by_day(pred, entity, ts) if by_day else pred  # with daily views, read their shuffle
        parts.append(rows.select(entity, F.lit("original").alias("view"), ts, *SERIES))
    if by_day:
        wide = daily(pred, entity, ts, pctile, busy, mode, built_in, custom)
        rows = F.explode(
            F.array(*[
                F.struct(F.lit(view_name(v, pctile, busy)).alias("view"), *[F.col(v)[c].alias(c) for c in SERIES])
                for v in by_day
            ])
        )
        parts.append(wide.select(entity, ts, rows.alias("r")).select(entity, "r.view", ts, "r.predict", "r.actual"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def view_errors(views: DataFrame, entity: str = "entity") -> DataFrame:
    """``(entity, view, error)`` for the percentile and busy-average views."""
    scored = views.filter(F.col("view").startswith("percentile_") | F.col("view").startswith("busy_avg_"))
    return scored.groupBy(entity, "view").agg(errors.aae().alias("error"))


def report(views: DataFrame, entity: str = "entity") -> DataFrame:
    """One row per entity: its views in order with row count and, where defined, error."""
    has_error = F.col("view").startswith("percentile_") | F.col("view").startswith("busy_avg_")
    per_view = views.groupBy(entity, "view").agg(F.count("*").alias("rows"), errors.aae().alias("error"))
    entry = F.struct("view", "rows", F.when(has_error, F.col("error")).alias("error"))
    return per_view.groupBy(entity).agg(F.array_sort(F.collect_list(entry)).alias("views"))

