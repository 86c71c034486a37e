"""Schedule queries and deterministic backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import schedule
from gaugeline.operators.schedule import Regimen
from gaugeline.plans import backtest
from gaugeline.queries.common import ENTITY, PER_ENTITY, TARGET, TS, WEEK, feature_table, naive_predictions, span
from gaugeline.queries.registry import FEATURES, GRID, NAIVE, WINDOWS, events, query, ratio_sql, rounded


@query("c13_windows", f"WITH {WINDOWS} SELECT * FROM windows")
def _(spark, d):
    return schedule.windows(span(spark, d), WEEK)


@query("c13_windows_range_too_short", f"WITH {WINDOWS} SELECT * FROM windows WHERE false")
def _(spark, d):
    return schedule.windows(span(spark, d), Regimen("31D", "1D"))


# Single-series schedule: windows count from the entity's first feature row.
def single_sql(closed: bool) -> str:
    upper = "<=" if closed else "<"
    return f"""{FEATURES},
starts AS (SELECT event_type, min(ts) AS s FROM features GROUP BY 1),
ids AS (SELECT event_type, s, i AS window_id, s + to_days(CAST(i AS INTEGER)) AS train_start, s + to_days(CAST(i AS INTEGER) + 7) AS train_stop,
  s + to_days(CAST(i AS INTEGER) + 7) AS predict_start, s + to_days(CAST(i AS INTEGER) + 8) AS predict_stop FROM starts, range(0, 100) r(i)),
counted AS (SELECT w.*, count(*) FILTER (WHERE f.ts >= train_start AND f.ts {upper} train_stop) AS train_rows,
  count(*) FILTER (WHERE f.ts >= predict_start AND f.ts {upper} predict_stop) AS predict_rows,
  count(DISTINCT CASE WHEN f.ts >= train_start AND f.ts {upper} train_stop THEN f.value END) >= 2 AS varied
  FROM ids w JOIN features f USING (event_type) GROUP BY ALL),
bad AS (SELECT event_type, min(window_id) AS b FROM counted WHERE train_rows < 160 OR predict_rows < 1 GROUP BY 1),
reached AS (SELECT c.* FROM counted c JOIN bad USING (event_type) WHERE window_id < b)"""


_SHOWN = "event_type, window_id, train_start, train_stop, predict_start, predict_stop, train_rows, predict_rows"


@query("c14_entity_windows", f"WITH {single_sql(False)} SELECT {_SHOWN}, varied AS trained FROM reached")
def _(spark, d):
    return schedule.entity_windows(feature_table(spark, d), PER_ENTITY, ENTITY, TS, TARGET)


@query("c15_entity_windows_closed", f"WITH {single_sql(True)} SELECT {_SHOWN}, true AS trained FROM reached")
def _(spark, d):
    return schedule.entity_windows(feature_table(spark, d), PER_ENTITY, ENTITY, TS, TARGET, closed=True)


@query(
    "c15_closed_predictions",
    f"""WITH {single_sql(True)} SELECT r.window_id, event_type AS entity, f.ts, round(f.hist_1D, 6) AS predict, round(f.value, 6) AS actual
    FROM reached r JOIN features f USING (event_type) WHERE f.ts BETWEEN r.predict_start AND r.predict_stop""",
)
def _(spark, d):
    return rounded(backtest.naive_per_entity(feature_table(spark, d), PER_ENTITY, ENTITY, TS, TARGET, closed=True))


@query("c16_predict_window", f"""WITH {FEATURES}, {WINDOWS} SELECT event_type, ts, window_id
    FROM features f JOIN windows w ON f.ts >= predict_start AND f.ts < predict_stop""")  # fmt: skip
def _(spark, d):
    return schedule.assign_predict(feature_table(spark, d), span(spark, d), WEEK, TS).select(ENTITY, TS, "window_id")


@query("c16_train_windows", f"""WITH {FEATURES}, {WINDOWS} SELECT event_type, ts, window_id
    FROM features f JOIN windows w ON f.ts >= train_start AND f.ts < train_stop""")  # fmt: skip
def _(spark, d):
    return schedule.assign_train(feature_table(spark, d), span(spark, d), WEEK, TS).select(ENTITY, TS, "window_id")


@query(
    "c17_window_statistics",
    f"""WITH {FEATURES}, {WINDOWS},
    t AS (SELECT window_id, count(*) AS train_rows, count(DISTINCT event_type) AS entities, count(DISTINCT value) >= 2 AS valid_target,
      min(ts) AS first_row, max(ts) AS last_row FROM windows JOIN features f ON f.ts >= train_start AND f.ts < train_stop GROUP BY 1),
    p AS (SELECT window_id, count(*) AS predict_rows FROM windows JOIN features f ON f.ts >= predict_start AND f.ts < predict_stop GROUP BY 1)
    SELECT w.*, coalesce(train_rows, 0) AS train_rows, coalesce(entities, 0) AS entities, coalesce(valid_target, false) AS valid_target,
      first_row, last_row, coalesce(predict_rows, 0) AS predict_rows,
      coalesce(train_rows, 0) >= 750 AND coalesce(valid_target, false) AS eligible
    FROM windows w LEFT JOIN t USING (window_id) LEFT JOIN p USING (window_id)""",
)
def _(spark, d):
    regimen = Regimen("7D", "1D", min_train=750)
    return schedule.window_statistics(feature_table(spark, d), span(spark, d), regimen, ENTITY, TS, TARGET)


@query("c18_first_interval", f"""WITH {FEATURES} SELECT event_type, ts, round(value, 6) AS value FROM features
    QUALIFY ts < min(ts) OVER (PARTITION BY event_type) + INTERVAL 7 DAY""")  # fmt: skip
def _(spark, d):
    return rounded(schedule.first_interval(feature_table(spark, d), TS, "7D", entity=ENTITY).select(ENTITY, TS, TARGET))


@query("c18_first_interval_shared", f"""WITH {FEATURES}, {WINDOWS} SELECT event_type, f.ts, round(value, 6) AS value FROM features f, span
    WHERE f.ts >= s AND f.ts < s + INTERVAL 7 DAY""")  # fmt: skip
def _(spark, d):
    first = schedule.first_interval(feature_table(spark, d), TS, "7D", span=span(spark, d))
    return rounded(first.select(ENTITY, TS, TARGET))


@query("m13_backtest_naive", f"WITH {NAIVE} SELECT window_id, entity, ts, round(predict, 6) AS predict, round(actual, 6) AS actual FROM pred")
def _(spark, d):
    return rounded(naive_predictions(spark, d))


@query(
    "m13_backtest_naive_single",
    f"""WITH {single_sql(False)} SELECT r.window_id, event_type AS entity, f.ts, round(f.hist_1D, 6) AS predict, round(f.value, 6) AS actual
    FROM reached r JOIN features f USING (event_type) WHERE varied AND f.ts >= r.predict_start AND f.ts < r.predict_stop""",
)
def _(spark, d):
    return rounded(backtest.naive_per_entity(feature_table(spark, d), PER_ENTITY, ENTITY, TS, TARGET))


def means_sql(keys: str) -> str:
    return f"""WITH {NAIVE}, means AS (
      SELECT w.window_id, {keys}, avg(f.value) AS predict FROM windows w JOIN eligible USING (window_id)
        JOIN features f ON f.ts >= w.train_start AND f.ts < w.train_stop GROUP BY ALL)
    SELECT window_id, event_type AS entity, f.ts, round(m.predict, 6) AS predict, round(f.value, 6) AS actual
    FROM windows w JOIN features f ON f.ts >= w.predict_start AND f.ts < w.predict_stop JOIN means m USING (window_id, {keys})"""


@query("m16_group_mean", means_sql("weekday, hour"))
def _(spark, d):
    return rounded(backtest.group_mean(feature_table(spark, d), span(spark, d), WEEK, ENTITY, TS, TARGET))


@query("m16_group_mean_per_entity", means_sql("event_type, hour"))
def _(spark, d):
    rows = feature_table(spark, d)
    return rounded(backtest.group_mean(rows, span(spark, d), WEEK, ENTITY, TS, TARGET, keys=["hour"], per_entity=True))


def _batch_run(target: str, entity: str, value: str) -> str:
    return f"""SELECT '{target}' AS target, '{entity}' AS entity_column, entity, round(avg({ratio_sql()}), 6) AS error, count(*) AS n FROM (
      WITH bins AS (SELECT CAST({entity} AS VARCHAR) AS entity, date_trunc('hour', ts) AS ts, avg({value}) AS value FROM events GROUP BY ALL),
      spine AS (SELECT entity, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bins GROUP BY entity),
      grid AS (SELECT entity, ts, last_value(b.value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM spine LEFT JOIN bins b USING (entity, ts)),
      features AS (SELECT * FROM (SELECT entity, ts, lag(value, 24) OVER (PARTITION BY entity ORDER BY ts) AS predict, value AS actual FROM grid)
        WHERE predict IS NOT NULL)
      SELECT f.* FROM features f JOIN windows w ON f.ts >= w.predict_start AND f.ts < w.predict_stop) GROUP BY entity"""


@query(
    "m20_run_batch",
    f"WITH {WINDOWS} " + " UNION ALL ".join(
        f"({_batch_run(t, e, v)})" for t, e, v in (
            ("value", "event_type", "value"), ("k", "event_type", "CAST(json_extract(props, '$.k') AS DOUBLE)"), ("value", "user_id", "value"),
        )
    ),
)
def _(spark, d):
    raw = events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    runs = [("value", "event_type"), ("k", "event_type"), ("value", "user_id")]
    return rounded(backtest.batch(raw, TS, runs, WEEK))


@query("c2_grid_hourly_count", f"WITH {GRID} SELECT event_type, count(*) AS n FROM grid GROUP BY 1")
def _(spark, d):
    return feature_table(spark, d, [], drop=False).groupBy(ENTITY).agg(F.count("*").alias("n"))
