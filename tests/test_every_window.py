"""Learned queries cover every eligible window of the table, whatever its dates."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaugeline.operators import schedule
from gaugeline.operators.schedule import Regimen
from gaugeline.queries.common import ENTITY, TARGET, TS, feature_table, span
from gaugeline.queries.learning import LONG, NAMES

FORTNIGHT = Regimen("14D", "1D", min_train=300)


@pytest.fixture(scope="module")
def later(spark, sf_dir, tmp_path_factory):
    """The table 100 days later."""
    path = str(tmp_path_factory.mktemp("later"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("ts", (F.col("ts").cast("timestamp_ntz") + F.expr("interval 100 days")).cast(events.schema["ts"].dataType)).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name, regimen, names", [("m17_seasonal_search", FORTNIGHT, []), ("m4_random_forest", LONG, NAMES)])
def test_every_eligible_window(spark, later, name, regimen, names):
    rows = feature_table(spark, later, names, **({} if names else {"drop": False})).dropna(subset=[TARGET])
    plan = schedule.eligible_windows(rows, span(spark, later), regimen, TS, TARGET).filter("predict_rows > 0")
    want = {r["window_id"] for r in plan.collect()}
    got = entry.queries()[name](spark, later)
    assert len(want) > 1 and {r["window_id"] for r in got.select("window_id").distinct().collect()} == want
    wide = schedule.assign_predict(rows.select(ENTITY, TS, TARGET), span(spark, later), regimen, TS)
    assert got.count() == wide.count()
