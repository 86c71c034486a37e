"""Walk-forward backtests: train on a sliding interval, predict the next one, advance, repeat.

Features are computed once by the caller. Predictions always have the columns
``(window_id, entity, ts, predict, actual)``.
"""

from __future__ import annotations

import uuid
from math import prod
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from gaugeline.functions import errors, timecols
from gaugeline.functions.durations import canonical
from gaugeline.operators import clean, encode, models, schedule, scores, seasonal, trees
from gaugeline.operators.features import transform
from gaugeline.operators.models import ModelKind
from gaugeline.operators.schedule import Regimen
from gaugeline.plans import forecast
from gaugeline.session import materialize
from gaugeline.sources import store

PREDICTION_COLUMNS = ["window_id", "entity", "ts", "predict", "actual"]


def _shape(df: DataFrame, entity: str, ts: str, target: str) -> DataFrame:
    return df.select(
        F.col("window_id"), F.col(entity).alias("entity"), F.col(ts).alias("ts"), "predict", F.col(target).alias("actual")
    )


def naive(features, span, regimen: Regimen, entity: str, ts: str, target: str, history: str = "hist_1D") -> DataFrame:
    """Seasonal-naive predictions in every eligible window; fully lazy."""
    rows = schedule.assign_predict(features.select(entity, ts, target, history), span, regimen, ts)
    allowed = schedule.eligible_windows(features, span, regimen, ts, target).select("window_id")
    # The schedule has one row per step of the regimen, however large the data is.
    rows = rows.join(F.broadcast(allowed), "window_id", "left_semi")
    return _shape(models.seasonal_naive(rows, history), entity, ts, target)


def naive_per_entity(features, regimen: Regimen, entity: str, ts: str, target: str, history: str = "hist_1D", closed: bool = False):
    """Seasonal-naive predictions under each entity's own schedule; fully lazy."""
    rows = schedule.assign_predict_per_entity(features.select(entity, ts, target, history), regimen, entity, ts, target, closed)
    return _shape(models.seasonal_naive(rows, history), entity, ts, target)


def group_mean(
    features, span, regimen: Regimen, entity: str, ts: str, target: str, keys=("weekday", "hour"), per_entity: bool = False
) -> DataFrame:
    """Mean of the train interval per group (calendar keys, with the entity if asked for); lazy but for the number of windows.

    Sums are taken per slot and group and run over the windows (``schedule.sums_by_window``). A row whose group has no train row is not
    predicted. Means of calendar keys alone, at most ``SENT_MEANS`` of them by the keys' own ranges, are broadcast, as each of them belongs to a
    large share of the rows.
    """
    groups = ([entity] if per_entity else []) + list(keys)
    start = schedule.range_start_us(span)
    slots = features.withColumn("_slot", schedule.slot_of(ts, start, regimen)).filter(F.col(target).isNotNull())
    slots = slots.groupBy(*groups, "_slot").agg(F.sum(target).alias("s"), F.count("*").alias("n"))
    means = schedule.sums_by_window(slots, regimen, groups, ["s"], "n").withColumn("predict", F.col("s") / F.col("n")).drop("s", "n")
    allowed = schedule.eligible_windows(features, span, regimen, ts, target).select("window_id")
    means = means.join(F.broadcast(allowed), "window_id", "left_semi")
    if all(k in CALENDAR for k in groups) and schedule.windows(span, regimen).count() * prod(CALENDAR[k] for k in groups) <= SENT_MEANS:
        means = F.broadcast(means)
    rows = schedule.assign_predict(features.select(*dict.fromkeys([entity, ts, target, *groups])), span, regimen, ts)
    return _shape(rows.join(means, ["window_id", *groups]), entity, ts, target)


CALENDAR = {"month": 12, "day": 31, "weekday": 7, "hour": 24, "minute": 60}
SENT_MEANS = 1 << 20


def learned(
    features: DataFrame,
    span: DataFrame,
    regimen: Regimen,
    entity: str,
    ts: str,
    target: str,
    names: list[str],
    kind: ModelKind,
    out: str,
    parallelism: int = 4,
) -> DataFrame:
    """One model over all entities per window. Runs jobs; results land in ``out``.

    The features are written once, by day. Trees of all windows that fit in a task (``trees.LOCAL`` training rows) grow in
    shared jobs, ``TOGETHER`` windows each; larger windows, and models that are not trees, are fitted one window after the other, reading only
    the days they cover.

    Finished windows are listed in a ledger and skipped when the call is repeated, so a lost driver costs only
    the windows that were under way. Ineligible windows are passed over and the schedule goes on.
    """
    spark = features.sparkSession
    features = _numbered(features, ts, out)
    plan = schedule.eligible_windows(features, span, regimen, ts, target).filter("predict_rows > 0")
    todo = store.pending(plan, f"{out}/done", ["window_id"]).orderBy("window_id").collect()
    ledger_schema = "window_id bigint, path string"
    growth = kind.growth()
    small = [w for w in todo if growth is not None and w["train_rows"] <= trees.LOCAL]
    for first in range(0, len(small), TOGETHER):
        some = small[first : first + TOGETHER]
        rows = _window_rows(features, span, regimen, ts, [w["window_id"] for w in some])
        pred = _grown(rows, features, ["window_id"], entity, ts, target, [("", names, kind)], len(some))
        path = f"{out}/predictions/part-{uuid.uuid4().hex}"
        pred.select(PREDICTION_COLUMNS).write.parquet(path)
        spark.createDataFrame([(w["window_id"], path) for w in some], ledger_schema).coalesce(1).write.mode("append").parquet(f"{out}/done")

    def run(window) -> tuple:
        train = _between(features, ts, window["train_start"], window["train_stop"])
        test = _between(features, ts, window["predict_start"], window["predict_stop"])
        model = forecast.fit(train, names, target, kind)
        rows = model.transform(test).withColumn("window_id", F.lit(window["window_id"]).cast("bigint"))
        path = f"{out}/predictions/part-{window['window_id']}"
        _shape(rows, entity, ts, target).write.mode("overwrite").parquet(path)
        return window["window_id"], path

    done = {w["window_id"] for w in small}
    _run_all(spark, run, [w for w in todo if w["window_id"] not in done], parallelism, f"{out}/done", ledger_schema)
    return store.finished(spark, f"{out}/done", _empty_schema(features, entity, ts, target))


ROW = "_row"
TOGETHER = 64  # windows in one job


def _numbered(features: DataFrame, ts: str, out: str) -> DataFrame:
    """The features written once by day, each row with a number that stays."""
    return store.write_by_day(features.withColumn(ROW, F.monotonically_increasing_id()), ts, f"{out}/features")


def _window_rows(features: DataFrame, span: DataFrame, regimen: Regimen, ts: str, windows: list[int]) -> DataFrame:
    """Rows of the given windows with ``window_id`` and ``test``: a window's model needs its own copy of its rows."""
    wanted = F.broadcast(features.sparkSession.createDataFrame([(w,) for w in windows], "window_id bigint"))
    train = schedule.assign_train(features, span, regimen, ts).withColumn("test", F.lit(False))
    test = schedule.assign_predict(features, span, regimen, ts).withColumn("test", F.lit(True))
    return train.unionByName(test).join(wanted, "window_id", "left_semi")


def _grown(rows: DataFrame, features: DataFrame, model: list[str], entity: str, ts: str, target: str, variations, models_: int) -> DataFrame:
    """Predictions ``(work, model..., entity, ts, predict, actual)`` of every variation ``(name, features, kind)`` for every model's rows.

    String features become their position among the sorted values of the whole table, which a task turns into the position among its
    model's own training values.
    """
    spark = rows.sparkSession
    names = list(dict.fromkeys(canonical(n) for _, some, _ in variations for n in some))
    text = encode.string_columns(features, names)
    keep = [c for c in rows.columns if c in {*model, "test", ROW, target, *names}]
    inputs = rows.select(*keep, *[F.col(m).alias(f"_m{i}") for i, m in enumerate(model)])
    if text:
        inputs = encode.encode_strings(inputs, text, {c: encode.fit_codes(features, c) for c in text}, [ROW], fitted_on=True)
    x = F.array(*[F.col(n).cast("double") for n in names])
    inputs = inputs.select(*[f"_m{i}" for i in range(len(model))], F.col(ROW).alias("row"), x.alias("x"), F.col(target).cast("double").alias("y"), "test")
    work = []
    for name, some, kind in variations:
        at = tuple(names.index(canonical(n)) for n in some)
        work.append(trees.Work(name, at, kind.growth(), kind.scaled, tuple(i for i in at if names[i] in text)))
    # About four tasks for each place to run one, so that uneven tasks even out.
    total, slots = sum(w.growth.trees for w in work), spark.sparkContext.defaultParallelism
    at_once = max(1, -(-total * models_ // (4 * slots)))
    groups = models_ * len(trees.shares(work, at_once))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * groups, 16 * slots))
    keys = [f"_m{i}" for i in range(len(model))]
    found = trees.fit_predict(inputs, keys, work, len(names), at_once, tasks)
    facts = features.select(F.col(ROW).alias("row"), F.col(entity).alias("_entity"), F.col(ts).alias("_ts"), F.col(target).alias("_actual"))
    out = found.join(facts, "row")
    return out.select("work", *[F.col(k).alias(m) for k, m in zip(keys, model) if m != entity], F.col("_entity").alias("entity"), F.col("_ts").alias("ts"), "predict", F.col("_actual").alias("actual"))


def seasonal_search(
    features: DataFrame, span: DataFrame, regimen: Regimen, entity: str, ts: str, target: str, step_seconds: int, out: str,
    season: int = 12, orders: list[tuple] | None = None,
) -> DataFrame:
    """The seasonal order search in every eligible window: per entity the best candidate's forecast of the next interval.

    ``features`` lie on a grid of ``step_seconds``. Rows are written by day. An entity's values are first put together per slot (the
    stretch no window boundary cuts); windows then gather slots, not rows, and ``TOGETHER`` windows run in one job. Finished windows are
    listed as in ``learned``. Runs jobs.
    """
    spark = features.sparkSession
    known = store.write_by_day(features.dropna(subset=[target]).select(entity, ts, target), ts, f"{out}/features")
    plan = schedule.eligible_windows(known, span, regimen, ts, target).filter("predict_rows > 0")
    todo = store.pending(plan, f"{out}/done", ["window_id"]).orderBy("window_id").collect()
    steps = -(-regimen.predict_us // (step_seconds * 1_000_000))
    start = schedule.range_start_us(span)
    for first in range(0, len(todo), TOGETHER):
        some = todo[first : first + TOGETHER]
        mine = _between(known, ts, some[0]["train_start"], some[-1]["predict_stop"])
        slots = mine.groupBy(F.col(entity).alias("entity"), schedule.slot_of(ts, start, regimen).alias("_slot"))
        slots = slots.agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(target).cast("double").alias("y")))).alias("s"))
        parts = schedule.spread_over_windows(slots.select("entity", "_slot", F.transform("s", lambda v: v["y"]).alias("y")), regimen)
        wanted = F.broadcast(spark.createDataFrame([(w["window_id"], w["predict_start"]) for w in some], "window_id bigint, begins timestamp_ntz"))
        series = parts.join(wanted, "window_id").groupBy("entity", "window_id", "begins").agg(F.array_sort(F.collect_list(F.struct("_slot", "y"))).alias("s"))
        series = series.select("entity", "window_id", "begins", F.flatten(F.transform("s", lambda v: v["y"])).alias("values"))
        # A fixed number of tasks: series are few and the fits heavy, adaptive execution would put them together by their bytes.
        series = series.repartition(4 * spark.sparkContext.defaultParallelism, "entity", "window_id")
        best = seasonal.best_fits(series, ["entity", "window_id", "begins"], steps, season, orders)
        # Windows start at the raw first sample: the first forecast is for the first grid time that is not before the interval.
        size = step_seconds * 1_000_000
        begin = timecols.floor_div(timecols.to_micros("begins") + (size - 1), size) * size
        rows = best.select("entity", "window_id", begin.alias("_us"), F.posexplode("forecast").alias("i", "predict"))
        rows = rows.select("entity", "window_id", timecols.from_micros(F.col("_us") + F.col("i") * size).alias("ts"), "predict")
        actual = mine.select(F.col(entity).alias("entity"), F.col(ts).alias("ts"), F.col(target).alias("actual"))
        path = f"{out}/predictions/part-{uuid.uuid4().hex}"
        rows.join(actual, ["entity", "ts"]).select(PREDICTION_COLUMNS).write.parquet(path)
        spark.createDataFrame([(w["window_id"], path) for w in some], "window_id bigint, path string").coalesce(1).write.mode("append").parquet(f"{out}/done")
    return store.finished(spark, f"{out}/done", _empty_schema(features, entity, ts, target))


def _run_all(spark: SparkSession, run, todo: list, parallelism: int, ledger: str, schema: str) -> None:
    """Run the fits side by side; only this thread writes the ledger, one entry per finished fit."""
    if not todo:
        return
    with ThreadPool(min(parallelism, len(todo))) as pool:
        for entry in pool.imap_unordered(inheritable_thread_target(spark)(run), todo):
            spark.createDataFrame([entry], schema).coalesce(1).write.mode("append").parquet(ledger)


def _between(df: DataFrame, ts: str, start, stop) -> DataFrame:
    if store.DAY in df.columns:
        df = df.filter(F.col(store.DAY).between(F.lit(start.date()), F.lit(stop.date())))
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(stop).cast("timestamp_ntz")))


def _empty_schema(features: DataFrame, entity: str, ts: str, target: str):
    return _shape(
        features.select(entity, ts, target).withColumns({"window_id": F.lit(0).cast("bigint"), "predict": F.lit(0.0)}),
        entity, ts, target,
    ).schema


def learned_per_entity(
    features: DataFrame, regimen: Regimen, entity: str, ts: str, target: str, names: list[str], kind: ModelKind, out: str,
    top: int = 40, cutoff=None, parallelism: int = 4,
) -> DataFrame:
    """One model per entity, for the ``top`` entities by row count (the report size). Runs jobs.

    With ``cutoff`` each model trains before that moment and predicts the rest, for entities whose whole and
    train targets both hold two repeated values. Otherwise the single-series schedule applies to each entity.

    The trees of all (entity, window) pairs grow in one job, however many there are. Only pairs with more than
    ``trees.LOCAL`` training rows, and models that are not trees, are fitted one after the other.
    """
    spark = features.sparkSession
    chosen = scores.top_entities(features, entity, top).select(entity)
    rows = _numbered(features.join(F.broadcast(chosen), entity, "left_semi"), ts, out)
    if cutoff is not None:
        before, _ = clean.cutoff_split(rows, ts, cutoff)
        usable = scores.valid_targets_strict(rows, entity, target).filter("valid").join(
            scores.valid_targets_strict(before, entity, target).filter("valid"), entity, "left_semi"
        )
        sizes = before.groupBy(entity).agg(F.count("*").alias("train_rows"))
        plan = usable.join(sizes, entity).select(entity, F.lit(0).cast("bigint").alias("window_id"), "train_rows")
    else:
        plan = schedule.entity_windows(rows, regimen, entity, ts, target).filter("trained")
    todo = materialize(store.pending(plan, f"{out}/done", [entity, "window_id"]), "plan")
    done_schema = f"`{entity}` {features.schema[entity].dataType.simpleString()}, window_id bigint, path string"
    grouped = F.lit(kind.growth() is not None) & (F.col("train_rows") <= trees.LOCAL)
    small = todo.filter(grouped)
    pairs = small.count()
    if pairs:
        pred = _grown(_pair_rows(rows, small, entity, ts, cutoff), rows, [entity, "window_id"], entity, ts, target, [("", names, kind)], pairs)
        path = f"{out}/predictions/part-{uuid.uuid4().hex}"
        pred.select(PREDICTION_COLUMNS).write.parquet(path)
        small.select(entity, "window_id", F.lit(path).alias("path")).write.mode("append").parquet(f"{out}/done")

    def run(job) -> tuple:
        own = rows.filter(F.col(entity).eqNullSafe(F.lit(job[entity])))
        if cutoff is not None:
            train, test = clean.cutoff_split(own, ts, cutoff)
        else:
            train = _between(own, ts, job["train_start"], job["train_stop"])
            test = _between(own, ts, job["predict_start"], job["predict_stop"])
        model = forecast.fit(train, names, target, kind)
        result = model.transform(test).withColumn("window_id", F.lit(job["window_id"]).cast("bigint"))
        path = f"{out}/predictions/part-{uuid.uuid4().hex}"
        _shape(result, entity, ts, target).write.mode("overwrite").parquet(path)
        return job[entity], job["window_id"], path

    large = todo.filter(~grouped).orderBy(entity, "window_id").collect()
    _run_all(spark, run, large, parallelism, f"{out}/done", done_schema)
    return store.finished(spark, f"{out}/done", _empty_schema(features, entity, ts, target))


def _pair_rows(rows: DataFrame, pairs: DataFrame, entity: str, ts: str, cutoff) -> DataFrame:
    """Rows of every (entity, window) pair with ``window_id`` and ``test``."""
    bounds = ["window_id"] if cutoff is not None else ["window_id", "train_start", "train_stop", "predict_stop"]
    named = pairs.select(F.col(entity).alias("_e"), *bounds)
    both = rows.join(named, rows[entity].eqNullSafe(F.col("_e"))).drop("_e")
    if cutoff is not None:
        return both.withColumn("test", F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))
    inside = both.filter((F.col(ts) >= F.col("train_start")) & (F.col(ts) < F.col("predict_stop")))
    return inside.withColumn("test", F.col(ts) >= F.col("train_stop")).drop("train_start", "train_stop", "predict_stop")


def sweep(
    features: DataFrame, span: DataFrame, regimen: Regimen, entity: str, ts: str, target: str,
    variations: list[tuple[str, list[str], ModelKind]], out: str, ledger: str, parallelism: int = 4,
) -> DataFrame:
    """Backtest every (name, features, model) and append ``(variation, overall_error)`` to the ledger.

    ``features`` holds the union of all feature columns, incomplete rows included; each variation drops only the
    rows its own features leave incomplete. Variations already in the ledger are not run again. Runs jobs.

    The features are written once. Variations of trees run together: a task takes a window's rows once and grows trees of several
    variations on them. Other models, and windows too large for a task, run one variation after the other.
    """
    spark = features.sparkSession
    known = store.ledger(spark, ledger)
    done = {r["variation"] for r in known.select("variation").distinct().collect()} if known is not None else set()
    todo = [v for v in variations if v[0] not in done]
    wanted = list(dict.fromkeys([entity, ts, target, *[n for _, names, _ in variations for n in names]]))
    rows = _numbered(features.select(wanted), ts, f"{out}/shared")
    plans = {}
    for _, names, _ in todo:
        if tuple(names) not in plans:
            plan = schedule.eligible_windows(rows.dropna(subset=names), span, regimen, ts, target).filter("predict_rows > 0")
            plans[tuple(names)] = plan.select("window_id", "train_rows").collect()
    small = [v for v in todo if v[2].growth() is not None and all(w["train_rows"] <= trees.LOCAL for w in plans[tuple(v[1])])]
    windows = sorted({w["window_id"] for _, names, _ in small for w in plans[tuple(names)]})
    path = f"{out}/predictions-{uuid.uuid4().hex}"  # a call that was cut off leaves nothing that counts
    for first in range(0, len(windows), TOGETHER):
        some = windows[first : first + TOGETHER]
        pred = _grown(_window_rows(rows, span, regimen, ts, some), rows, ["window_id"], entity, ts, target, small, len(some))
        # A variation keeps only windows that are eligible by its own rows.
        own = [(i, w["window_id"]) for i, (_, names, _) in enumerate(small) for w in plans[tuple(names)]]
        allowed = F.broadcast(spark.createDataFrame(own, "work int, window_id bigint"))
        pred.join(allowed, ["work", "window_id"], "left_semi").write.mode("append").parquet(path)
    if small:
        pred = store.read_or_none(spark, path)
        if pred is not None:
            of = pred.groupBy("work", "entity").agg(errors.aae().alias("error"), F.count("*").alias("n"))
            known_error = F.col("error").isNotNull()
            mean = F.try_divide(F.sum(F.when(known_error, F.col("n") * F.col("error"))), F.sum(F.when(known_error, F.col("n"))))
            found = {r["work"]: r["overall_error"] for r in of.groupBy("work").agg(mean.alias("overall_error")).collect()}
            lines = [(name, found.get(i)) for i, (name, _, _) in enumerate(small)]
            store.append_ledger(spark.createDataFrame(lines, store.LEDGER), ledger)
    for nr, (name, names, kind) in enumerate(v for v in todo if v not in small):
        whole = features.dropna(subset=names).select(*dict.fromkeys([entity, ts, target, *names]))
        pred = learned(whole, span, regimen, entity, ts, target, names, kind, f"{out}/variation-{nr}", parallelism)
        overall = scores.overall_error(scores.entity_errors(pred))
        store.append_ledger(overall.select(F.lit(name).alias("variation"), "overall_error"), ledger)
    return store.ledger(spark, ledger)


def batch(
    raw: DataFrame, ts: str, runs: list[tuple[str, str]], regimen: Regimen, step="1h", history: str = "hist_1D"
) -> DataFrame:
    """Seasonal-naive backtest per (target, entity column) run: errors per entity, run keys as columns; lazy.

    All runs go through one grid: each row is unpivoted to one per run, with the run's value and the run and entity as its key, and is
    reduced to bins before anything is shuffled. The raw table is read once for any number of runs.
    """
    numbered = [F.struct(F.lit(i).alias("run"), F.col(e).cast("string").alias("entity"), F.col(t).cast("double").alias("value")) for i, (t, e) in enumerate(runs)]
    rows = raw.select(ts, F.explode(F.array(*numbered)).alias("r")).filter(F.col("r.entity").isNotNull())
    rows = rows.select(ts, F.concat(F.col("r.run").cast("string"), F.lit(":"), F.col("r.entity")).alias("_key"), F.col("r.value").alias("value"))
    features = transform(rows, "_key", ts, "value", [history], step).withColumn("run", F.substring_index("_key", ":", 1).cast("int"))
    span = schedule.time_range(raw, ts)
    allowed = schedule.eligible_windows(features, span, regimen, ts, "value", ("run",)).select("run", "window_id")
    # One row per run and step of the regimen.
    placed = schedule.assign_predict(features, span, regimen, ts).join(F.broadcast(allowed), ["run", "window_id"], "left_semi")
    pred = models.seasonal_naive(placed, history).select(F.struct("run", "_key").alias("entity"), "predict", F.col("value").alias("actual"))
    target, column = (F.element_at(F.array(*[F.lit(r[i]) for r in runs]), F.col("entity.run") + 1) for i in (0, 1))
    name = F.expr("substring(entity._key, locate(':', entity._key) + 1)")
    return scores.entity_errors(pred).select(target.alias("target"), column.alias("entity_column"), name.alias("entity"), "error", "n")


def daily_naive_errors(raw: DataFrame, entity: str, ts: str, target: str, step="1h") -> DataFrame:
    """How well yesterday predicts today, per entity."""
    features = transform(raw, entity, ts, target, ["hist_1D"], step)
    return scores.entity_errors(models.seasonal_naive(features), entity, "predict", target)


def scored_with_actual(scored: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Join predictions back to the values that arrived for the same keys."""
    return scored.join(actual, keys)

