"""A user's function per bin: groups over batch borders, odd keys, empty bins and tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import perbin, views


def test_groups_over_batch_borders_and_odd_keys(spark):
    rng = np.random.default_rng(1)
    keys = [None, math.nan, 1.0, -0.5, 7.0]
    rows = [(keys[i % 5], int(i), None if i % 11 == 0 else float(v)) for i, v in enumerate(rng.normal(size=4000))]
    df = spark.createDataFrame(rows, "k double, t int, v double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = perbin.per_group(df, ["k"], "t", ["v"], {"first": lambda v: v[0], "n": len, "mean": np.nanmean, "none": lambda v: None}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 5
    for r in got:
        own = [v for k, _, v in rows if k is r.k or k == r.k or (k is not None and r.k is not None and math.isnan(k) and math.isnan(r.k))]
        assert r.n.v == len(own) == 800 and r.none.v is None
        assert r.first.v == own[0] and r["mean"].v == pytest.approx(np.mean([v for v in own if v is not None]))


def test_custom_view_beside_built_in_ones(spark):
    rows = [("a", f"2024-01-0{d} {h:02d}:00:00", float(h), float(d * h)) for d in (1, 4) for h in range(24)] + [("b", "2024-01-02 05:00:00", 1.0, None)]
    pred = spark.createDataFrame(rows, "entity string, t string, predict double, actual double").select("entity", F.col("t").cast("timestamp_ntz").alias("ts"), "predict", "actual")
    wide = {(r.entity, r.ts.day): r for r in views.daily(pred, views=["std", "busy_avg"], custom={"reach": lambda v: np.nanmax(v) - np.nanmin(v) if not np.isnan(v).all() else None}).collect()}
    assert wide["a", 4].reach.actual == 4 * 23 and wide["a", 1].reach.predict == 23 and wide["b", 2].reach == (0.0, None)
    assert wide["a", 2].reach is None and wide["a", 1].std.predict == pytest.approx(np.std(range(24)))  # days without rows are there
    only = views.build(pred, views=[], custom={"n": len}).collect()
    assert {r.view for r in only} == {"n"} and len(only) == 5
    with pytest.raises(ValueError):
        views.daily(pred, custom={"std": len})


def test_rebinned_gaps_and_no_rows(spark):
    shape = "entity string, t string, value double"
    rows = [("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 02:00:00", 5.0), ("a", "2024-01-02 13:00:00", 2.0), (None, "2024-01-01 02:00:00", 5.0)]
    make = lambda r: spark.createDataFrame(r, shape).select("entity", F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    got = perbin.rebin(make(rows), "entity", "ts", "12h", ["value"], {"last": lambda v: v[-1]}).orderBy("ts").collect()
    assert [(r.ts.day, r.ts.hour, r.last_value) for r in got] == [(1, 0, 5.0), (1, 12, None), (2, 0, None), (2, 12, 2.0)]
    assert perbin.rebin(make([]), "entity", "ts", "1D", ["value"], {"last": lambda v: v[-1]}).collect() == []
