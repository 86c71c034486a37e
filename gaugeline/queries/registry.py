"""Registration of queries and the table helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, as the SQL side does."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


# --- SQL pieces -------------------------------------------------------------------------------------------

# Hourly grid of events.value per event type, forward-filled.
GRID = """
bins AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL),
spine AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bins GROUP BY event_type),
grid AS (
  SELECT event_type, ts, last_value(b.value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
  FROM spine LEFT JOIN bins b USING (event_type, ts))"""

# Feature rows weekday, hour, hist_1D; complete rows only.
FEATURES = (
    GRID
    + """,
lagged AS (
  SELECT event_type, ts, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
    lag(value, 24) OVER (PARTITION BY event_type ORDER BY ts) AS hist_1D, value FROM grid),
features AS (SELECT * FROM lagged WHERE hist_1D IS NOT NULL)"""
)

# Train 7 days, predict 1 day, from the first raw sample on.
WINDOWS = """
span AS (SELECT min(ts) AS s, max(ts) AS e FROM events),
windows AS (
  SELECT i AS window_id, s + to_days(CAST(i AS INTEGER)) AS train_start, s + to_days(CAST(i AS INTEGER) + 7) AS train_stop,
    s + to_days(CAST(i AS INTEGER) + 7) AS predict_start, s + to_days(CAST(i AS INTEGER) + 8) AS predict_stop
  FROM span, range(0, 1000) r(i) WHERE s + to_days(CAST(i AS INTEGER) + 7) <= e)"""

NAIVE = (
    FEATURES
    + ","
    + WINDOWS
    + """,
eligible AS (
  SELECT w.window_id FROM windows w JOIN features f ON f.ts >= w.train_start AND f.ts < w.train_stop
  GROUP BY w.window_id HAVING count(*) >= 300 AND count(DISTINCT f.value) >= 2),
pred AS (
  SELECT w.window_id, f.event_type AS entity, f.ts, f.hist_1D AS predict, f.value AS actual
  FROM windows w JOIN eligible USING (window_id) JOIN features f ON f.ts >= w.predict_start AND f.ts < w.predict_stop)"""
)


def ratio_sql(p: str = "predict", a: str = "actual") -> str:
    return f"abs({p} - {a}) / nullif(CASE WHEN {p} IS NOT NULL AND {a} IS NOT NULL THEN greatest({p}, {a}) END, 0)"
