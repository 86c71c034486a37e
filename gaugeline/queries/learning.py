"""Queries that fit models. Values depend on the learner, so only trees without chance have a SQL twin: their leaves are means."""

from __future__ import annotations

from gaugeline.operators import models, schedule
from gaugeline.operators.schedule import Regimen
from gaugeline.plans import backtest, forecast
from gaugeline.queries.common import ENTITY, PER_ENTITY, TARGET, TS, WEEK, feature_table, span
from gaugeline.queries.registry import GRID, query, rounded
from gaugeline.queries.schedules import means_sql, single_sql
from gaugeline.session import materialize, scratch_dir

LONG = Regimen("21D", "3D", min_train=300)
FORTNIGHT = Regimen("14D", "1D", min_train=300)
NAMES = ["event_type", "day", "weekday", "hour", "hist_1D", "hist_1D1H", "hist_1D_4H"]
TREES = {"RF": {"rf__n_estimators": 20}, "ET": {"et__n_estimators": 20}}


def _features(spark, d, names=NAMES, **kw):
    return materialize(feature_table(spark, d, names, **kw), "features")


def _every_window(spark, d, name: str):
    """Fit on the training interval of each eligible window, predict the next one."""
    kind = models.model_kind(name, TREES[name[:2]])
    return backtest.learned(feature_table(spark, d, NAMES), span(spark, d), LONG, ENTITY, TS, TARGET, NAMES, kind, scratch_dir(spark, "windows"))


@query("m4_random_forest")
def _(spark, d):
    return _every_window(spark, d, "RF")


@query("m5_random_forest_scaled")
def _(spark, d):
    return _every_window(spark, d, "RF_SC")


@query("m6_extra_trees")
def _(spark, d):
    return _every_window(spark, d, "ET")


@query("m7_extra_trees_scaled")
def _(spark, d):
    return _every_window(spark, d, "ET_SC")


def _whole_tree(splits: str) -> models.ModelKind:
    """One tree of full depth on all rows: features that only tell groups apart make each leaf a group's mean."""
    return models.ModelKind(f"tree_{splits}", "rf", lambda: models.Forest(1, splits, drawn=False))


@query("m4_whole_tree", means_sql("event_type, hour"))
def _(spark, d):
    args = feature_table(spark, d), span(spark, d), WEEK, ENTITY, TS, TARGET, [ENTITY, "hour"], _whole_tree("best")
    return rounded(backtest.learned(*args, scratch_dir(spark, "windows")))


@query("m6_whole_extra_tree", means_sql("event_type, hour"))
def _(spark, d):
    args = feature_table(spark, d), span(spark, d), WEEK, ENTITY, TS, TARGET, [ENTITY, "hour"], _whole_tree("random")
    return rounded(backtest.learned(*args, scratch_dir(spark, "windows")))


@query(
    "m11_whole_tree_per_entity",
    f"""WITH {single_sql(False)}, means AS (
      SELECT r.window_id, event_type, hour, avg(f.value) AS predict FROM reached r JOIN features f USING (event_type)
      WHERE varied AND f.ts >= r.train_start AND f.ts < r.predict_start GROUP BY ALL)
    SELECT r.window_id, event_type AS entity, f.ts, round(m.predict, 6) AS predict, round(f.value, 6) AS actual
    FROM reached r JOIN features f USING (event_type) JOIN means m USING (window_id, event_type, hour)
    WHERE varied AND f.ts >= r.predict_start AND f.ts < r.predict_stop""",
)
def _(spark, d):
    args = feature_table(spark, d), PER_ENTITY, ENTITY, TS, TARGET, ["hour"], _whole_tree("best")
    return rounded(backtest.learned_per_entity(*args, scratch_dir(spark, "per-entity")))


@query("m10_m13_backtest_forest")
def _(spark, d):
    kind = models.model_kind("RF", TREES["RF"])
    return backtest.learned(feature_table(spark, d, NAMES), span(spark, d), LONG, ENTITY, TS, TARGET, NAMES, kind, scratch_dir(spark, "backtest"))


@query("m11_forest_per_entity")
def _(spark, d):
    kind = models.model_kind("RF", TREES["RF"])
    names = ["weekday", "hour", "hist_1D"]
    return backtest.learned_per_entity(
        feature_table(spark, d, names), Regimen("21D", "3D", min_train=300), ENTITY, TS, TARGET, names, kind, scratch_dir(spark, "per-entity")
    )


@query("m11_forest_per_entity_cutoff")
def _(spark, d):
    kind = models.model_kind("RF", TREES["RF"])
    names = ["month", "day", "weekday", "hour", "minute"]
    return backtest.learned_per_entity(
        feature_table(spark, d, names), PER_ENTITY, ENTITY, TS, TARGET, names, kind, scratch_dir(spark, "cutoff"), cutoff="2024-01-20 00:00:00"
    )


@query("m14_variation_sweep")
def _(spark, d):
    # The variations of the reference on its grid of 15 minutes.
    plain = ["day", "weekday", "hour", "minute", "hist_1D8H", "hist_1D4H", "hist_1D2H", "hist_1D1H", "hist_1D", "hist_1D15m", "hist_1D30m", "hist_1D45m"]
    short = ["day", "weekday", "hour", "minute", "hist_1H", "hist_4H", "hist_1D", "hist_15m"]
    own = [*plain, ENTITY]
    rf, et = lambda name, n: models.model_kind(name, {"rf__n_estimators": n}), lambda name, n: models.model_kind(name, {"et__n_estimators": n})
    variations = [
        ("RF_20 std_features", plain, rf("RF", 20)),
        ("SC_RF_20 std_features", plain, rf("RF_SC", 20)),
        ("ET_20 std_features", plain, et("ET", 20)),
        ("RF_10 std_features", plain, rf("RF", 10)),
        ("RF_20 vm_features", own, rf("RF", 20)),
        ("RF_20 sh_features", short, rf("RF", 20)),
        ("SC_ET_10 vm_features", own, et("ET_SC", 10)),
        ("RF_100 std_features", plain, rf("RF", 100)),
        ("SC_RF_20 vm_features", own, rf("RF_SC", 20)),
        ("SC_ET_5 vm_features", own, et("ET_SC", 5)),
    ]
    rows = _features(spark, d, list(dict.fromkeys([*own, *short])), step="15min", drop=False)
    return backtest.sweep(rows, span(spark, d), LONG, ENTITY, TS, TARGET, variations, scratch_dir(spark, "sweep"), scratch_dir(spark, "ledger"))


@query("m15_saved_model")
def _(spark, d):
    rows = _features(spark, d)
    train = schedule.first_interval(rows, TS, LONG.train, span=span(spark, d))
    path = scratch_dir(spark, "model")
    forecast.fit(train, NAMES, TARGET, models.model_kind("RF", TREES["RF"])).save(path, spark)
    return forecast.Forecaster.load(path, spark).transform(rows).select(ENTITY, TS, "predict", TARGET)


@query("m17_seasonal_search")
def _(spark, d):
    grid = feature_table(spark, d, [], drop=False)
    return backtest.seasonal_search(grid, span(spark, d), FORTNIGHT, ENTITY, TS, TARGET, 3600, scratch_dir(spark, "seasonal"))


@query(
    "m17_first_order",
    f"""WITH {GRID}, span AS (SELECT min(ts) AS s, max(ts) AS e FROM events),
    windows AS (SELECT i AS window_id, s + to_days(CAST(i AS INTEGER)) AS train_start, s + to_days(CAST(i AS INTEGER) + 14) AS train_stop,
      s + to_days(CAST(i AS INTEGER) + 15) AS predict_stop FROM span, range(0, 1000) r(i) WHERE s + to_days(CAST(i AS INTEGER) + 14) <= e),
    trained AS (SELECT window_id, event_type, g.ts, value, lag(value) OVER w AS before, row_number() OVER w AS nr, count(*) OVER (PARTITION BY window_id, event_type) AS n
      FROM windows JOIN grid g ON g.ts >= train_start AND g.ts < train_stop WHERE value IS NOT NULL WINDOW w AS (PARTITION BY window_id, event_type ORDER BY g.ts)),
    enough AS (SELECT window_id FROM trained GROUP BY 1 HAVING count(*) >= 300 AND count(DISTINCT value) >= 2),
    fits AS (SELECT window_id, event_type, regr_slope(value, before) FILTER (WHERE nr > 40) AS a, regr_intercept(value, before) FILTER (WHERE nr > 40) AS b, arg_max(value, ts) AS last
      FROM trained JOIN enough USING (window_id) GROUP BY ALL HAVING any_value(n) >= 48),
    ahead AS (SELECT window_id, event_type, ts, value, row_number() OVER (PARTITION BY window_id, event_type ORDER BY ts) AS h
      FROM windows JOIN grid g ON g.ts >= train_stop AND g.ts < predict_stop)
    SELECT window_id, event_type AS entity, ts, round(b * (1 - a ** h) / (1 - a) + a ** h * last, 6) AS predict, round(value, 6) AS actual FROM ahead JOIN fits USING (window_id, event_type)""",
)
def _(spark, d):
    grid = feature_table(spark, d, [], drop=False)
    return rounded(backtest.seasonal_search(grid, span(spark, d), FORTNIGHT, ENTITY, TS, TARGET, 3600, scratch_dir(spark, "first-order"), orders=[(1, 0, 0, 0, 0, 0)]))
