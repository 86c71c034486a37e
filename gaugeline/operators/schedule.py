"""Walk-forward schedules: which rows train and which rows are predicted in every window.

Rows are never copied into the windows they overlap. They are first added up per slot (the largest stretch of
time no window boundary cuts), and only these few sums are spread over the windows that contain the slot.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import timecols
from gaugeline.functions.durations import micros
from gaugeline.operators.lookup import attach


@dataclass(frozen=True)
class Regimen:
    """Train on ``train``, predict the following ``predict``, step forward by ``predict``."""

    train: str | int = "31D"
    predict: str | int = "1D"
    min_train: int = 300
    min_predict: int = 1

    @property
    def train_us(self) -> int:
        return micros(self.train)

    @property
    def predict_us(self) -> int:
        return micros(self.predict)

    @property
    def slot_us(self) -> int:
        return gcd(self.train_us, self.predict_us)


def time_range(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("range_start"), F.max(ts).alias("range_end"))


def measured_range(df: DataFrame, ts: str) -> DataFrame:
    """The same one row with its values fixed by one job now. Everything derived from it then holds literals
    instead of subqueries, which keeps the plans of long flows small."""
    row = time_range(df, ts).first()
    start, end = (f"TIMESTAMP_NTZ'{v}'" if v is not None else "CAST(NULL AS TIMESTAMP_NTZ)" for v in row)
    return df.sparkSession.sql(f"SELECT {start} AS range_start, {end} AS range_end")


def windows(span: DataFrame, regimen: Regimen) -> DataFrame:
    """Shared schedule from a one-row ``(range_start, range_end)``: starts at the raw first sample, goes on while
    the training interval ends within the range. A shorter range gives no window."""
    first = timecols.to_micros("range_start")
    room = timecols.to_micros("range_end") - first - regimen.train_us
    ids = span.filter(room >= 0).select(
        first.alias("_s"), F.explode(F.sequence(F.lit(0).cast("bigint"), timecols.floor_div(room, regimen.predict_us))).alias("window_id")
    )
    return _bounds(ids, regimen).select("window_id", "train_start", "train_stop", "predict_start", "predict_stop")


def _bounds(ids: DataFrame, regimen: Regimen) -> DataFrame:
    start = F.col("_s") + F.col("window_id") * regimen.predict_us
    stop = start + regimen.train_us
    return ids.withColumns({
        "train_start": timecols.from_micros(start),
        "train_stop": timecols.from_micros(stop),
        "predict_start": timecols.from_micros(stop),
        "predict_stop": timecols.from_micros(stop + regimen.predict_us),
    })


def range_start_us(span: DataFrame) -> Column:
    """The schedule's first moment as a scalar subquery."""
    return span.select(timecols.to_micros("range_start")).scalar()


def predict_window(ts: str | Column, start_us: Column, regimen: Regimen) -> Column:
    """The one window that predicts a row (negative before the first predict interval)."""
    since = timecols.to_micros(ts) - start_us - regimen.train_us
    return timecols.floor_div(since, regimen.predict_us)


def train_window_range(slot: Column, regimen: Regimen) -> tuple[Column, Column]:
    """First and last window whose training interval contains a slot (slots count from the first moment)."""
    per_train, per_step = regimen.train_us // regimen.slot_us, regimen.predict_us // regimen.slot_us
    first = timecols.floor_div(slot - per_train, per_step) + 1
    return F.greatest(first, F.lit(0).cast("bigint")), timecols.floor_div(slot, per_step)


def slot_of(ts: str | Column, start_us: Column, regimen: Regimen) -> Column:
    return timecols.floor_div(timecols.to_micros(ts) - start_us, regimen.slot_us)


def spread_over_windows(slots: DataFrame, regimen: Regimen) -> DataFrame:
    """One row per (slot row, window that trains on it); expects ``_slot``."""
    first, last = train_window_range(F.col("_slot"), regimen)
    inside = slots.filter("_slot >= 0").withColumns({"_a": first, "_b": last}).filter("_a <= _b")
    return inside.withColumn("window_id", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def window_statistics(features: DataFrame, span: DataFrame, regimen: Regimen, entity: str, ts: str, target: str) -> DataFrame:
    """Per window: bounds, train rows and entities, first and last train row, predict rows, and eligibility
    (enough train rows over all entities, at least two target values).

    An entity counts in the stretch of windows that its slots reach without a break: each stretch is one row where it begins and
    one behind its end, whatever the ratio of the training to the predicted interval.
    """
    slots = features.select(F.struct(entity).alias("e"), slot_of(ts, range_start_us(span), regimen).alias("_slot")).filter("_slot >= 0").distinct()
    first, last = train_window_range(F.col("_slot"), regimen)
    own = Window.partitionBy("e").orderBy("_slot")
    # A slot that no training interval holds (train shorter than predict) reaches no window.
    reach = slots.withColumns({"a": first, "b": last}).filter("a <= b")
    reach = reach.withColumns({"begins": F.coalesce(F.col("a") > F.lag("b").over(own) + 1, F.lit(True)), "ends": F.coalesce(F.lead("a").over(own) > F.col("b") + 1, F.lit(True))})
    steps = F.array(F.struct(F.col("a").alias("w"), F.col("begins").cast("long").alias("d")), F.struct((F.col("b") + 1).alias("w"), (-F.col("ends").cast("long")).alias("d")))
    changes = reach.select(F.explode(steps).alias("s")).filter("s.d != 0").groupBy("s.w").agg(F.sum("s.d").alias("d"))
    # One row per window at most from here on; windows without a change keep the count before them.
    known = windows(span, regimen).select(F.col("window_id").alias("w"), F.lit(0).cast("long").alias("d")).unionByName(changes)
    so_far = known.groupBy("w").agg(F.sum("d").alias("d")).select(F.col("w").alias("window_id"), F.sum("d").over(Window.orderBy("w")).alias("entities"))
    table = _statistics(features, span, regimen, ts, target).join(so_far, "window_id")
    return table.select("window_id", "train_start", "train_stop", "predict_start", "predict_stop", "train_rows", "entities", *[c for c in table.columns[6:] if c != "entities"])


def eligible_windows(features, span, regimen: Regimen, ts: str, target: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The eligible windows with the same statistics but the entities: only one sum per slot is spread, however many entities there are.

    With ``by``, a few runs kept in one table, each run has its own eligible windows.
    """
    return _statistics(features, span, regimen, ts, target, by).filter("eligible")


def _statistics(features: DataFrame, span: DataFrame, regimen: Regimen, ts: str, target: str, by: tuple[str, ...] = ()) -> DataFrame:
    start = range_start_us(span)
    rows = features.select(*by, ts, target).withColumn("_slot", slot_of(ts, start, regimen))
    rows = rows.withColumn("_pw", predict_window(ts, start, regimen))
    small = rows.filter("_slot >= 0").groupBy(*by, "_slot", "_pw").agg(
        F.count("*").alias("n"), F.min(target).alias("lo"), F.max(target).alias("hi"),
        F.min(ts).alias("first"), F.max(ts).alias("last"),
    )
    train = spread_over_windows(small, regimen).groupBy(*by, "window_id").agg(
        F.sum("n").alias("train_rows"), F.coalesce(F.min("lo") < F.max("hi"), F.lit(False)).alias("valid_target"),
        F.min("first").alias("first_row"), F.max("last").alias("last_row"),
    )
    predicted = small.filter("_pw >= 0").groupBy(*by, F.col("_pw").alias("window_id")).agg(F.sum("n").alias("predict_rows"))
    # A window without train rows is listed for a single run; among several runs it would belong to none.
    table = windows(span, regimen).join(train, "window_id", "inner" if by else "left").join(predicted, [*by, "window_id"], "left")
    table = table.fillna(0, ["train_rows", "predict_rows"]).fillna(False, ["valid_target"])
    return table.withColumn("eligible", (F.col("train_rows") >= regimen.min_train) & F.col("valid_target"))


def sums_by_window(slots: DataFrame, regimen: Regimen, groups: list[str], sums: list[str], count: str) -> DataFrame:
    """``window_id, groups, sums, count`` over each window's training interval, for ``slots (_slot, groups, sums, count)``.

    A slot's numbers are added where the first window that trains on it begins and taken off behind the last one, so two rows per slot are
    moved, whatever the ratio of the two intervals; sums are then running sums over the windows. Windows in which a group
    has no rows are left out. Sums must be finite.
    """
    first, last = train_window_range(F.col("_slot"), regimen)
    inside = slots.filter("_slot >= 0").withColumns({"_a": first, "_b": last}).filter("_a <= _b")
    moves = F.explode(F.array(F.struct(F.col("_a").alias("w"), F.lit(1).alias("sign")), F.struct((F.col("_b") + 1).alias("w"), F.lit(-1).alias("sign"))))
    named = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    keys = [f"_g{i}" for i in range(len(groups))]
    numbers = [*sums, count]
    deltas = inside.withColumn("_m", moves).select(*named, F.col("_m.w").alias("w"), *[(F.col("_m.sign") * F.col(c)).alias(c) for c in numbers])
    # Dealt out by group once: both the sums per window and the running sums find their rows together.
    deltas = deltas.repartition(*keys).groupBy(*keys, "w").agg(*[F.sum(c).alias(c) for c in numbers])
    own = Window.partitionBy(*keys).orderBy("w")
    so_far = deltas.select(*keys, "w", *[F.sum(c).over(own).alias(c) for c in numbers], F.lead("w").over(own).alias("_next"))
    spread = so_far.filter((F.col(count) > 0) & F.col("_next").isNotNull()).withColumn("window_id", F.explode(F.sequence("w", F.col("_next") - 1)))
    return spread.select("window_id", *[F.col(k).alias(g) for k, g in zip(keys, groups)], *numbers)


def assign_predict(features: DataFrame, span: DataFrame, regimen: Regimen, ts: str) -> DataFrame:
    """Rows that fall into a predict interval of the schedule, with its ``window_id``."""
    end = span.select(timecols.to_micros("range_end")).scalar()
    start = range_start_us(span)
    last = timecols.floor_div(end - start - regimen.train_us, regimen.predict_us)
    placed = features.withColumn("window_id", predict_window(ts, start, regimen))
    return placed.filter((F.col("window_id") >= 0) & (F.col("window_id") <= last))


def assign_train(features: DataFrame, span: DataFrame, regimen: Regimen, ts: str) -> DataFrame:
    """Every row once per window that trains on it. Multiplies rows by train / predict: for inspection only."""
    end = span.select(timecols.to_micros("range_end")).scalar()
    start = range_start_us(span)
    last = timecols.floor_div(end - start - regimen.train_us, regimen.predict_us)
    placed = spread_over_windows(features.withColumn("_slot", slot_of(ts, start, regimen)), regimen)
    return placed.filter(F.col("window_id") <= last).drop("_slot")


def first_interval(features: DataFrame, ts: str, length, entity: str | None = None, span: DataFrame | None = None) -> DataFrame:
    """Rows of the first ``length`` of time: of each entity, or of the whole table when ``entity`` is None
    (from ``span`` if given, otherwise from the table's own first row)."""
    if entity is None:
        start = range_start_us(span if span is not None else time_range(features, ts))
        us = timecols.to_micros(ts)
        return features.filter((us >= start) & (us < start + micros(length)))
    starts = features.groupBy(entity).agg(F.min(timecols.to_micros(ts)).alias("_s"), F.count("*").alias("_rows"))
    placed = attach(features, starts, entity, "_rows", [ts])
    return placed.filter(timecols.to_micros(ts) < F.col("_s") + micros(length)).select(features.columns)


def entity_windows(features: DataFrame, regimen: Regimen, entity: str, ts: str, target: str, closed: bool = False) -> DataFrame:
    """Single-series schedule for every entity on its own.

    It starts at the entity's first feature row and ends before the first window with too few train rows or no
    row to predict. ``trained`` is false for windows whose train target is constant; those are passed over, not
    fatal. With ``closed`` both intervals include their end moment, as the oldest variant does (and then the
    target check is not made).
    """
    small = _entity_slots(features, regimen, entity, ts, target)
    train = spread_over_windows(small, regimen).select(entity, "_s", "window_id", "n", "lo", "hi", F.lit(0).alias("p"))
    per_train, per_step = regimen.train_us // regimen.slot_us, regimen.predict_us // regimen.slot_us
    ahead = F.col("_slot") - per_train
    predicted = small.filter(ahead >= 0).select(
        entity, "_s", timecols.floor_div(ahead, per_step).alias("window_id"), F.lit(0).alias("n"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.col("n").alias("p"),
    )
    parts = train.unionByName(predicted)
    if closed:  # rows exactly on a boundary count in the interval that ends there as well
        edges = small.filter("edge > 0").withColumns({
            "_tw": timecols.floor_div(ahead, per_step), "_on": F.pmod(ahead, F.lit(per_step).cast("bigint")),
            "_pw": timecols.floor_div(ahead, per_step) - 1,
        }).filter("_on = 0")
        parts = parts.unionByName(edges.filter("_tw >= 0").select(
            entity, "_s", F.col("_tw").alias("window_id"), F.col("edge").alias("n"), F.col("edge_lo").alias("lo"),
            F.col("edge_hi").alias("hi"), F.lit(0).alias("p")))
        parts = parts.unionByName(edges.filter("_pw >= 0").select(
            entity, "_s", F.col("_pw").alias("window_id"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"), F.col("edge").alias("p")))
    per_window = parts.groupBy(entity, "_s", "window_id").agg(
        F.sum("n").alias("train_rows"), F.sum("p").alias("predict_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    good = per_window.filter((F.col("train_rows") >= regimen.min_train) & (F.col("predict_rows") >= regimen.min_predict))
    # Ids start at 0, so a window is reached if exactly its own number of good windows precede it.
    nr = F.row_number().over(Window.partitionBy(entity).orderBy("window_id")) - 1
    reached = good.withColumn("_nr", nr).filter("_nr = window_id")
    trained = F.lit(True) if closed else F.coalesce(F.col("lo") < F.col("hi"), F.lit(False))
    return _bounds(reached, regimen).select(
        entity, "window_id", "train_start", "train_stop", "predict_start", "predict_stop",
        "train_rows", "predict_rows", trained.alias("trained"),
    )


def _entity_slots(features: DataFrame, regimen: Regimen, entity: str, ts: str, target: str) -> DataFrame:
    placed = with_entity_start(features.select(entity, ts, F.col(target).cast("double").alias("_y")), entity, ts)
    us = timecols.to_micros(ts)
    on_edge = F.pmod(us - F.col("_s"), F.lit(regimen.slot_us).cast("bigint")) == 0
    return placed.groupBy(entity, "_s", slot_of(ts, F.col("_s"), regimen).alias("_slot")).agg(
        F.count("*").alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi"),
        F.count_if(on_edge).alias("edge"), F.min(F.when(on_edge, F.col("_y"))).alias("edge_lo"),
        F.max(F.when(on_edge, F.col("_y"))).alias("edge_hi"),
    )


def with_entity_start(features: DataFrame, entity: str, ts: str) -> DataFrame:
    """Adds ``_s``, the entity's first moment in microseconds."""
    starts = features.groupBy(entity).agg(F.min(timecols.to_micros(ts)).alias("_s"), F.count("*").alias("_rows"))
    return attach(features, starts, entity, "_rows", [ts])


def assign_predict_per_entity(features: DataFrame, regimen: Regimen, entity: str, ts: str, target: str, closed: bool = False) -> DataFrame:
    """Rows predicted under the single-series schedule, with ``window_id``; with ``closed`` a row on a boundary
    appears in the window that ends there and in the one that begins there."""
    plan = entity_windows(features, regimen, entity, ts, target, closed).filter("trained").select(entity, "window_id")
    placed = with_entity_start(features, entity, ts)
    since = timecols.to_micros(ts) - F.col("_s") - regimen.train_us
    own = timecols.floor_div(since, regimen.predict_us)
    if closed:
        edge = F.pmod(since, F.lit(regimen.predict_us).cast("bigint")) == 0
        own = F.explode(F.when(edge, F.array(own - 1, own)).otherwise(F.array(own)))
    placed = placed.withColumn("window_id", own).filter("window_id >= 0").drop("_s")
    return placed.join(plan, [entity, "window_id"], "left_semi").select("window_id", *features.columns)
