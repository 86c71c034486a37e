import math

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import errors
from gaugeline.operators import scores, views


def _aae(spark, pairs, fn=errors.aae):
    df = spark.createDataFrame(pairs, "predict double, actual double")
    return df.agg(fn().alias("e")).first().e


def test_error_skips_zero_by_zero_and_nulls(spark):
    assert _aae(spark, [(0.0, 0.0), (1.0, 2.0)]) == 0.5
    assert _aae(spark, [(None, 2.0), (3.0, None), (1.0, 2.0)]) == 0.5
    assert _aae(spark, [(0.0, 0.0), (1.0, 2.0)], errors.aae_zero) == 0.25


def test_error_with_zero_maximum_is_infinite(spark):
    assert math.isinf(_aae(spark, [(-1.0, 0.0)]))


def _day(spark, values, start=0):
    rows = [("e", f"2024-01-01 {start + h:02}:00:00", v) for h, v in enumerate(values)]
    df = spark.createDataFrame(rows, "entity string, t string, v double")
    return df.selectExpr("entity", "cast(t as timestamp_ntz) ts", "v predict", "v actual")


def test_daily_statistics(spark):
    row = views.daily(_day(spark, [1.0, 2.0, 3.0])).first()
    assert row.percentile.predict == pytest.approx(2.9)
    assert row.std.predict == pytest.approx(0.8165, abs=1e-4)
    assert row.variance.actual == pytest.approx(0.6667, abs=1e-4)


@pytest.mark.parametrize(
    "values,period,mode,hour,score",
    [
        ([3.0, 5.0, 5.0], 1, "argmax", 1, 5.0),
        ([3.0, 5.0, 5.0], 1, "reference", 1, 5.0),
        ([0.0, 0.0, 0.0], 1, "argmax", 0, 0.0),
        ([0.0, 0.0, 0.0], 1, "reference", 2, 0.0),
        ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 4, "argmax", 5, 6.0),
        ([9.0, 1.0, 1.0, 1.0, 4.0], 4, "argmax", 4, 4.0),
        ([-2.0, -1.0], 1, "argmax", 1, -1.0),
    ],
)
def test_busy_hour(spark, values, period, mode, hour, score):
    row = views.daily(_day(spark, values), busy=period, mode=mode).first()
    assert (row.busy_hour.predict, row.busy_avg.actual) == (hour, score)


def test_busy_hour_may_start_in_an_empty_hour(spark):
    rows = _day(spark, [1.0]).unionByName(_day(spark, [9.0, 9.0, 9.0, 0.0], start=6))
    row = views.daily(rows).first()
    assert (row.busy_hour.actual, row.busy_avg.actual) == (3.0, 9.0)


def test_leading_unknown_score_stays_in_reference_mode(spark):
    rows = _day(spark, [None, 3.0])
    assert views.daily(rows, busy=1, mode="reference").first().busy_avg.predict is None
    assert views.daily(rows, busy=1).first().busy_avg.predict == 3.0


def test_empty_days_are_present(spark):
    rows = _day(spark, [1.0, 2.0])
    later = rows.withColumn("ts", F.expr("ts + INTERVAL 3 DAY"))
    days = views.daily(rows.unionByName(later)).orderBy("ts").collect()
    assert len(days) == 4
    assert days[1].percentile is None and days[1].busy_avg.predict is None
    # The first day starts at its first hour, the last one ends at its last hour.
    assert days[0].busy_hour.predict == 1.0 and days[3].busy_hour.predict == 1.0


def test_views_can_be_switched_off(spark):
    built = views.build(_day(spark, [1.0, 2.0]), views=["std", "busy_avg"])
    assert {r.view for r in built.select("view").collect()} == {"std", "busy_avg_4H"}
    with pytest.raises(ValueError):
        views.build(built, views=["median"])


def test_overall_error_weights_rows_and_flags(spark):
    scored = spark.createDataFrame([("a", 0.5, 1), ("b", 0.995, 3), ("c", None, 9)], "entity string, error double, n bigint")
    row = scores.overall_error(scored).first()
    assert row.overall_error == pytest.approx((0.5 + 3 * 0.995) / 4) and (row.entities, row.suspicious) == (2, 1)


def test_target_checks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 1.0), ("c", 1.0), ("c", 2.0), ("c", 2.0), ("d", None)],
                               "e string, y double")
    assert {r.e: r.valid for r in scores.valid_targets(df, "e", "y").collect()} == {"a": False, "b": True, "c": True, "d": False}
    assert {r.e: r.valid for r in scores.valid_targets_strict(df, "e", "y").collect()} == {"a": False, "b": False, "c": True, "d": False}
