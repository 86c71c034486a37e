import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import durations
from gaugeline.operators import features as feat
from gaugeline.operators import grid as g

SPARSE = [("a", "2024-03-01 00:07:00", 1.0), ("a", "2024-03-01 00:40:00", 2.0), ("a", "2024-03-01 02:10:00", 3.0),
          ("a", "2024-03-02 05:00:00", 4.0)]


def test_gap_free_quarter_hours(series):
    rows = g.regular(series(SPARSE), "entity", "ts", "15min", ["value"]).orderBy("ts").collect()
    assert len(rows) == 117
    assert str(rows[0].ts) == "2024-03-01 00:00:00" and str(rows[-1].ts) == "2024-03-02 05:00:00"
    assert [r.value for r in rows[:10]] == [1, 1, 2, 2, 2, 2, 2, 2, 3, 3]


def test_bins_count_from_first_midnight(series):
    rows = g.regular(series(SPARSE), "entity", "ts", "7h", ["value"]).orderBy("ts").collect()
    assert [str(r.ts)[8:16] for r in rows] == ["01 00:00", "01 07:00", "01 14:00", "01 21:00", "02 04:00"]
    assert [r.value for r in rows] == [2.0, 2.0, 2.0, 2.0, 4.0]


def test_leading_nulls_stay_and_fill_limit(series):
    rows = [("a", "2024-03-01 00:00:00", None), ("a", "2024-03-01 01:00:00", 5.0), ("a", "2024-03-01 04:00:00", None),
            ("a", "2024-03-01 05:00:00", 6.0)]
    filled = g.regular(series(rows), "entity", "ts", "1h", ["value"]).orderBy("ts").collect()
    assert [r.value for r in filled] == [None, 5, 5, 5, 5, 6]
    limited = g.regular(series(rows), "entity", "ts", "1h", ["value"], max_fill="1h").orderBy("ts").collect()
    assert [r.value for r in limited] == [None, 5, 5, None, None, 6]


def test_off_grid_shift_is_null(series):
    df = feat.transform(series(SPARSE), "entity", "ts", "value", ["hist_20min"], "15min", drop=False)
    assert df.filter("hist_20min IS NOT NULL").count() == 0


def test_history_needs_no_complete_window(series):
    """The mean over (t-x-y, t-x] exists as soon as t-x lies on the grid."""
    rows = [("a", f"2024-03-01 {h:02}:00:00", float(h)) for h in range(6)]
    df = feat.transform(series(rows), "entity", "ts", "value", ["hist_1h_3h"], "1h", drop=False).orderBy("ts")
    assert [r.hist_1h_3h for r in df.collect()] == [None, 0.0, 0.5, 1.0, 2.0, 3.0]


def test_nan_is_null(series):
    rows = g.regular(series([("a", "2024-03-01 00:00:00", 1.0), ("a", "2024-03-01 01:00:00", float("nan"))]),
                     "entity", "ts", "1h", ["value"]).orderBy("ts").collect()
    assert [r.value for r in rows] == [1.0, 1.0]


@pytest.fixture(scope="module")
def messy(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.withColumn("value", F.when(F.col("event_id") % 7 > 0, F.col("value")))


def _pandas(raw, step, names, fill=True):
    out = []
    for entity, rows in raw.groupby("event_type"):
        s = rows.sort_values("ts").set_index("ts")[["value"]].resample(step).mean()
        s = s.ffill() if fill else s
        for f in durations.features(names):
            past = s["value"].shift(freq=pd.Timedelta(seconds=f.shift))
            s[f.name] = past if f.window is None else past.rolling(pd.Timedelta(seconds=f.window)).mean()
        out.append(s.assign(event_type=entity).reset_index())
    return pd.concat(out).sort_values(["event_type", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("part_rows", [5, 29, 65_536])
@pytest.mark.parametrize(
    "step,names", [("1h", ["hist_1D", "hist_1h_3h", "hist_2h_90min"]), ("7h", ["hist_7h", "hist_14h_21h"]), ("45min", ["hist_90min_2h"])]
)
def test_split_series_equal_whole_series(messy, step, names, part_rows):
    """However a series is cut into parts, the result is that of one sequential pass."""
    want = _pandas(messy.toPandas(), step, names)
    got = g.regular(messy, "event_type", "ts", step, ["value"], history=durations.features(names), target="value", part_rows=part_rows)
    got = got.toPandas().sort_values(["event_type", "ts"]).reset_index(drop=True)
    assert len(got) == len(want) and (got.ts.to_numpy() == want.ts.to_numpy().astype(got.ts.dtype)).all()
    for c in ["value", *names]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


@pytest.mark.parametrize("part_rows", [5, 65_536])
def test_unfilled(messy, part_rows):
    want = _pandas(messy.toPandas(), "1h", [], fill=False)
    got = g.regular(messy, "event_type", "ts", "1h", ["value"], fill=False, part_rows=part_rows).toPandas()
    got = got.sort_values(["event_type", "ts"]).reset_index(drop=True)
    np.testing.assert_allclose(got.value.astype(float), want.value.astype(float))


def test_no_task_holds_a_whole_series(spark):
    """One entity owns nearly all rows; its grid still comes from many partitions of bounded size."""
    hot = spark.range(20_000).selectExpr("'hot' entity", "timestampadd(MINUTE, id, TIMESTAMP_NTZ'2024-01-01') ts", "cast(id as double) value")
    cold = spark.range(50).selectExpr("concat('c', id) entity", "TIMESTAMP_NTZ'2024-01-01' ts", "1D value")
    df = g.regular(hot.unionByName(cold), "entity", "ts", "1min", ["value"], history=[durations.feature("hist_5min")],
                   target="value", part_rows=500)
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("entity") == "hot").alias("n")).collect()
    assert sum(r.n for r in sizes) == 20_000 and max(r.n for r in sizes) < 20_000 * 0.6
    assert df.filter("entity = 'hot' AND hist_5min = value - 5").count() == 20_000 - 5


def test_first_string_by_time(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2024-01-01 00:30:00', 2L, 'late'), ('a', TIMESTAMP_NTZ'2024-01-01 00:10:00', 3L, NULL),
        ('a', TIMESTAMP_NTZ'2024-01-01 00:20:00', 5L, 'second'), ('a', TIMESTAMP_NTZ'2024-01-01 00:20:00', 4L, 'first'),
        ('a', TIMESTAMP_NTZ'2024-01-01 02:00:00', 6L, NULL) AS t(entity, ts, seq, s)""")
    got = g.regular(rows, "entity", "ts", "1h", strings=["s"], order=["seq"]).orderBy("ts").collect()
    assert [r.s for r in got] == ["first", "first", "first"]


@pytest.mark.parametrize("text,want", [("15min", 900), ("1D8H", 115_200), ("1D15m", 87_300), ("H", 3600), ("30s", 30), (60, 60)])
def test_durations(text, want):
    assert durations.seconds(text) == want


@pytest.mark.parametrize("text", ["1M", "W", "", "5", "1D?", "0h"])
def test_no_fixed_duration(text):
    with pytest.raises(ValueError):
        durations.seconds(text)


def test_feature_names():
    assert durations.feature("hist-1D8H").name == "hist_1D8H"
    assert durations.feature("net_usage").kind == "raw"
    with pytest.raises(ValueError):
        durations.feature("hist_1D_2H_3H")


def test_irregular_history(series):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:59:59", 2.0), ("a", "2024-01-01 01:00:00", 4.0), ("a", "2024-01-01 02:00:00", 8.0)]
    out = feat.history_exact(series(rows), "entity", "ts", "value", "hist_1h").orderBy("ts")
    assert [r.hist_1h for r in out.collect()] == [None, None, 1.0, 4.0]
    out = feat.history_exact(series(rows), "entity", "ts", "value", "hist_1h_1h").orderBy("ts")
    assert [r.hist_1h_1h for r in out.collect()] == [None, None, 1.0, 3.0]
