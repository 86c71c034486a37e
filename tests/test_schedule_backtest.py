import pytest
from pyspark.sql import functions as F

from gaugeline.operators import models, schedule
from gaugeline.operators.schedule import Regimen
from gaugeline.plans import backtest, forecast
from gaugeline.session import scratch_dir
from gaugeline.sources import store


def _hours(spark, days, entities=("a", "b")):
    names = ", ".join(f"'{e}'" for e in entities)
    return spark.range(days * 24).selectExpr(
        f"explode(array({names})) entity", "timestampadd(HOUR, id, TIMESTAMP_NTZ'2024-01-01') ts", "id"
    ).selectExpr("entity", "ts", "cast(id % 24 + if(entity = 'a', 0, 100) as double) value", "cast(id % 24 as int) hour",
                 "cast(id % 24 + if(entity = 'a', 0, 100) as double) hist_1D")


def test_short_range_gives_no_window(spark):
    df = _hours(spark, 3)
    assert schedule.windows(schedule.time_range(df, "ts"), Regimen("7D", "1D")).count() == 0


def test_windows_do_not_leak(spark):
    df, regimen = _hours(spark, 12), Regimen("5D", "2D", min_train=1)
    span = schedule.time_range(df, "ts")
    plan = schedule.windows(span, regimen)
    trained = schedule.assign_train(df, span, regimen, "ts").join(plan, "window_id")
    assert trained.filter("ts < train_start OR ts >= train_stop").count() == 0
    assert trained.groupBy("window_id").count().filter("count <> 240").count() == 0
    predicted = schedule.assign_predict(df, span, regimen, "ts").join(plan, "window_id")
    assert predicted.filter("ts < predict_start OR ts >= predict_stop").count() == 0
    assert predicted.count() == predicted.select("entity", "ts").distinct().count()


def test_ineligible_window_is_passed_over(spark):
    """The target is constant at first, so early windows cannot train; the schedule goes on."""
    df = _hours(spark, 8).withColumn("value", F.when(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz"), 1.0).otherwise(F.col("value")))
    regimen = Regimen("2D", "1D", min_train=10)
    span = schedule.time_range(df, "ts")
    stats = schedule.window_statistics(df, span, regimen, "entity", "ts", "value").orderBy("window_id").collect()
    assert [r.eligible for r in stats] == [False, False, True, True, True, True]
    assert {r.window_id for r in backtest.naive(df, span, regimen, "entity", "ts", "value").collect()} == {2, 3, 4, 5}


def test_entity_schedule_stops_at_first_gap(spark):
    df = _hours(spark, 10).filter("entity = 'b' OR ts < TIMESTAMP_NTZ'2024-01-04' OR ts >= TIMESTAMP_NTZ'2024-01-06'")
    plan = schedule.entity_windows(df, Regimen("2D", "1D", min_train=48), "entity", "ts", "value")
    assert {r.entity: r["count"] for r in plan.groupBy("entity").count().collect()} == {"a": 1, "b": 8}


def test_closed_schedule_shares_boundary_rows(spark):
    df, regimen = _hours(spark, 4, ["a"]), Regimen("2D", "1D", min_train=48)
    plan = schedule.entity_windows(df, regimen, "entity", "ts", "value", closed=True).orderBy("window_id").collect()
    assert [(r.train_rows, r.predict_rows) for r in plan] == [(49, 25), (49, 24)]
    pred = backtest.naive_per_entity(df, regimen, "entity", "ts", "value", closed=True)
    assert pred.count() == 49 and pred.select("ts").distinct().count() == 48


def test_constant_train_target_is_skipped_not_fatal(spark):
    df = _hours(spark, 6, ["a"]).withColumn("value", F.when(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"), 1.0).otherwise(F.col("value")))
    plan = schedule.entity_windows(df, Regimen("2D", "1D", min_train=1), "entity", "ts", "value").orderBy("window_id").collect()
    assert [r.trained for r in plan] == [False, True, True, True]


def test_group_mean_is_exact_on_a_daily_pattern(spark):
    df, regimen = _hours(spark, 6), Regimen("2D", "1D", min_train=1)
    span = schedule.time_range(df, "ts")
    pred = backtest.group_mean(df, span, regimen, "entity", "ts", "value", keys=["hour"], per_entity=True)
    assert pred.count() == 4 * 48 - 0 and pred.filter("abs(predict - actual) > 1e-9").count() == 0


def test_unknown_model_and_parameter():
    with pytest.raises(ValueError):
        models.model_kind("XGB")
    with pytest.raises(ValueError):
        models.model_kind("RF", {"et__n_estimators": 3})
    assert models.model_kind("RF", {"rf__n_estimators": "18"}).estimator().getNumTrees() == 18


@pytest.mark.parametrize("name,step", [("RF", "rf"), ("RF_SC", "rf"), ("ET", "et"), ("ET_SC", "et")])
def test_models_learn_save_and_load(spark, name, step):
    df = _hours(spark, 6)
    kind = models.model_kind(name, {f"{step}__n_estimators": 3, f"{step}__max_depth": 6})
    model = forecast.fit(df, ["entity", "hour"], "value", kind)
    path = scratch_dir(spark, "model")
    model.save(path, spark)
    again = forecast.Forecaster.load(path, spark)
    new = df.unionByName(df.limit(1).withColumn("entity", F.lit("unseen")))
    rows = again.transform(again.conform(new).withColumn("value", F.lit(0.0))).collect()
    assert len(rows) == new.count() and all(0 <= r.predict <= 123 for r in rows)
    scored = model.transform(df)
    assert scored.agg(F.avg(F.abs(F.col("predict") - F.col("value")))).first()[0] < 6
    assert scored.exceptAll(again.transform(df)).count() == 0


def test_interrupted_backtest_goes_on(spark):
    df, regimen = _hours(spark, 6), Regimen("2D", "1D", min_train=1)
    span = schedule.time_range(df, "ts")
    kind = models.model_kind("RF", {"rf__n_estimators": 2, "rf__max_depth": 4})
    out = scratch_dir(spark, "resume")
    args = (df, span, regimen, "entity", "ts", "value", ["hour"], kind, out)
    first = backtest.learned(*args)
    assert {r.window_id for r in first.select("window_id").distinct().collect()} == {0, 1, 2, 3}
    before = store.read_or_none(spark, f"{out}/done").count()
    assert backtest.learned(*args).count() == first.count() and store.read_or_none(spark, f"{out}/done").count() == before


def test_statistics_and_sums_by_window_equal_plain_counting(spark):
    """Long training intervals, entities with breaks, a null entity, windows nobody trains on."""
    import random

    rng = random.Random(4)
    hours = {"a": range(0, 400), "b": [*range(5, 60), *range(200, 330)], "c": [77], None: range(120, 190), "d": rng.sample(range(400), 60)}
    rows = [(e, h, float(rng.randint(0, 9))) for e, hs in hours.items() for h in hs if not 340 <= h < 370]
    df = spark.createDataFrame(rows, "entity string, h int, value double").select("entity", F.expr("timestampadd(HOUR, h, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"), "h", F.expr("h % 5 as k"), "value")
    span = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:30:00' AS range_start, TIMESTAMP_NTZ'2024-01-17 15:00:00' AS range_end")
    for train, predict in (("30h", "7h"), ("10h", "10h"), ("5h", "20h"), ("100h", "1h")):
        regimen, t, p = Regimen(train, predict, min_train=1), int(train[:-1]), int(predict[:-1])
        got = {r.window_id: r for r in schedule.window_statistics(df, span, regimen, "entity", "ts", "value").collect()}
        slots = df.withColumn("_slot", schedule.slot_of("ts", schedule.range_start_us(span), regimen)).groupBy("entity", "k", "_slot").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
        sums = {(r.window_id, r.entity, r.k): (r.s, r.n) for r in schedule.sums_by_window(slots, regimen, ["entity", "k"], ["s"], "n").collect()}
        want = {}
        assert len(got) == (399 - 0.5 - t) // p + 1
        for w, r in got.items():
            own = [(e, h, v) for e, h, v in rows if 0.5 + w * p <= h < 0.5 + w * p + t]
            assert (r.train_rows, r.entities) == (len(own), len({e for e, _, _ in own}))
            for e, h, v in own:
                s, n = want.get((w, e, h % 5), (0, 0))
                want[w, e, h % 5] = s + v, n + 1
        assert {k: v for k, v in sums.items() if k[0] in got} == want



def test_batch_reads_the_raw_table_once(spark, sf_dir):
    """As many scans for three runs as for one, each run with windows of its own."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("rare", F.when(F.col("event_id") < 400, F.col("value")))
    raw = raw.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    runs = [("value", "event_type"), ("rare", "event_type"), ("value", "user_id")]
    regimen = Regimen("7D", "1D", min_train=300)
    scans = []
    for some in (runs[:1], runs):
        got = backtest.batch(raw, "ts", some, regimen)
        scans.append(got._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        rows = {(r.target, r.entity_column, r.entity): (r.error, r.n) for r in got.collect()}
    assert scans[0] == scans[1]
    apart = {}
    for run in runs:
        apart |= {(r.target, r.entity_column, r.entity): (r.error, r.n) for r in backtest.batch(raw, "ts", [run], regimen).collect()}
    assert rows == apart
