"""Grid and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import clean, schedule
from gaugeline.operators import features as feat
from gaugeline.operators import grid as g
from gaugeline.queries.common import ENTITY, TARGET, TS, feature_table
from gaugeline.queries.registry import FEATURES, GRID, events, query, rounded


@query(
    "c1_resample_mean",
    f"WITH {GRID} SELECT event_type, ts, round(b.value, 6) AS value FROM spine LEFT JOIN bins b USING (event_type, ts)",
)
def _(spark, d):
    return rounded(g.resample_mean(events(spark, d), ENTITY, TS, "1h", [TARGET]))


@query(
    "c1_resample_mean_7h",
    """WITH o AS (SELECT event_type, CAST(min(CAST(ts AS DATE)) AS TIMESTAMP) AS o FROM events GROUP BY 1),
    bins AS (SELECT event_type, o, CAST(floor((epoch_us(ts) - epoch_us(o)) / (7 * 3600 * 1000000.0)) AS BIGINT) AS b, avg(value) AS value
      FROM events JOIN o USING (event_type) GROUP BY ALL),
    spine AS (SELECT event_type, o, unnest(generate_series(min(b), max(b))) AS b FROM bins GROUP BY event_type, o)
    SELECT event_type, o + to_hours(CAST(7 * b AS INTEGER)) AS ts, round(x.value, 6) AS value
    FROM spine LEFT JOIN bins x USING (event_type, o, b)""",
)
def _(spark, d):
    return rounded(g.resample_mean(events(spark, d), ENTITY, TS, "7h", [TARGET]))


@query("c2_calendar_spine", f"WITH {GRID} SELECT event_type, ts FROM spine")
def _(spark, d):
    return g.regular(events(spark, d), ENTITY, TS, "1h", fill=False)


@query("c2_empty_bins", f"""WITH {GRID} SELECT event_type, count(*) AS rows, count(*) - count(b.value) AS empty
    FROM spine LEFT JOIN bins b USING (event_type, ts) GROUP BY event_type""")  # fmt: skip
def _(spark, d):
    grid = g.resample_mean(events(spark, d), ENTITY, TS, "1h", [TARGET])
    return grid.groupBy(ENTITY).agg(F.count("*").alias("rows"), F.count_if(F.col(TARGET).isNull()).alias("empty"))


@query("c3_forward_fill", f"WITH {GRID} SELECT event_type, ts, round(value, 6) AS value FROM grid")
def _(spark, d):
    return rounded(g.regular(events(spark, d), ENTITY, TS, "1h", [TARGET]))


@query(
    "c3_forward_fill_limited",
    f"""WITH {GRID}, marked AS (
      SELECT event_type, ts, g.value, max(CASE WHEN b.value IS NOT NULL THEN ts END) OVER (PARTITION BY event_type ORDER BY ts) AS seen
      FROM grid g LEFT JOIN bins b USING (event_type, ts))
    SELECT event_type, ts, round(CASE WHEN ts - seen <= INTERVAL 1 HOUR THEN value END, 6) AS value FROM marked""",
)
def _(spark, d):
    return rounded(g.regular(events(spark, d), ENTITY, TS, "1h", [TARGET], max_fill="1h"))


_WIDE = """
bins AS (SELECT user_id, date_trunc('hour', ts) AS ts, avg(value) AS value,
    arg_min(event_type, (ts, event_id)) AS event_type, arg_min(props, (ts, event_id)) AS props FROM events GROUP BY user_id, date_trunc('hour', ts)),
spine AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bins GROUP BY user_id),
filled AS (SELECT user_id, ts, last_value(b.value IGNORE NULLS) OVER w AS value, last_value(b.event_type IGNORE NULLS) OVER w AS event_type,
    last_value(b.props IGNORE NULLS) OVER w AS props
  FROM spine LEFT JOIN bins b USING (user_id, ts)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("c4_resample_strings", f"WITH {_WIDE} SELECT user_id, ts, event_type, props FROM filled")
def _(spark, d):
    return g.regular(events(spark, d), "user_id", TS, "1h", strings=["event_type", "props"], order=["event_id"])


@query("c5_dual_resample", f"WITH {_WIDE} SELECT user_id, ts, round(value, 6) AS value, event_type, props FROM filled")
def _(spark, d):
    return rounded(g.regular(events(spark, d), "user_id", TS, "1h", [TARGET], ["event_type", "props"], order=["event_id"]))


@query(
    "c6_calendar",
    """SELECT event_id, ts, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
    CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute FROM events""",
)
def _(spark, d):
    return feat.add_calendar(events(spark, d).select("event_id", TS), TS)


@query(
    "c7_history_point",
    f"""WITH {GRID} SELECT event_type, ts, round(lag(value, 24) OVER w, 6) AS hist_1D, round(lag(value, 32) OVER w, 6) AS hist_1D8H,
    CAST(NULL AS DOUBLE) AS hist_1D15m, round(value, 6) AS value FROM grid WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def _(spark, d):
    return rounded(feature_table(spark, d, ["hist_1D", "hist_1D8H", "hist_1D15m"], drop=False))


@query(
    "c7_history_point_raw",
    """WITH e AS (SELECT event_type, date_trunc('minute', ts) AS ts, min(value) AS value FROM events GROUP BY ALL)
    SELECT a.event_type, a.ts, a.value, b.value AS hist_3H FROM e a LEFT JOIN e b
      ON a.event_type = b.event_type AND b.ts = a.ts - INTERVAL 3 HOUR""",
)
def _(spark, d):
    return feat.history_exact(_minutes(spark, d), ENTITY, TS, TARGET, "hist_3H")


def _minutes(spark, d):
    minute = F.date_trunc("minute", TS).cast("timestamp_ntz")
    return events(spark, d).groupBy(ENTITY, minute.alias(TS)).agg(F.min(TARGET).alias(TARGET))


@query(
    "c8_history_mean_raw",
    """WITH e AS (SELECT event_type, date_trunc('minute', ts) AS ts, min(value) AS value FROM events GROUP BY ALL),
    m AS (SELECT event_type, ts, avg(value) OVER (PARTITION BY event_type ORDER BY ts
      RANGE BETWEEN INTERVAL 359 MINUTE PRECEDING AND CURRENT ROW) AS m FROM e)
    SELECT a.event_type, a.ts, a.value, round(m.m, 6) AS hist_3H_6H FROM e a LEFT JOIN m
      ON a.event_type = m.event_type AND m.ts = a.ts - INTERVAL 3 HOUR""",
)
def _(spark, d):
    return rounded(feat.history_exact(_minutes(spark, d), ENTITY, TS, TARGET, "hist_3H_6H"))


@query(
    "c8_history_mean",
    f"""WITH {GRID} SELECT event_type, ts,
    round(avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 26 PRECEDING AND 24 PRECEDING), 6) AS hist_1D_3H,
    round(avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING), 6) AS hist_2H_90min,
    round(value, 6) AS value FROM grid""",
)
def _(spark, d):
    return rounded(feature_table(spark, d, ["hist_1D_3H", "hist_2H_90min"], drop=False))


@query(
    "c9_feature_names",
    f"""WITH {GRID} SELECT event_type, ts, CAST(minute(ts) AS INTEGER) AS minute, round(lag(value, 24) OVER w, 6) AS hist_1D,
    round(avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 34 PRECEDING AND 32 PRECEDING), 6) AS hist_1D8H_3H,
    round(value, 6) AS value FROM grid WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def _(spark, d):
    return rounded(feature_table(spark, d, ["minute", "event_type", "hist-1D", "hist_1D8H_3H"], drop=False))


@query(
    "c10_transform",
    f"""WITH {FEATURES} SELECT event_type, ts, weekday, hour, round(hist_1D, 6) AS hist_1D, round(value, 6) AS value FROM features""",
)
def _(spark, d):
    return rounded(feature_table(spark, d))


@query(
    "c10_transform_users",
    f"""WITH {_WIDE}, l AS (SELECT user_id, ts, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
      CAST(minute(ts) AS INTEGER) AS minute, event_type, lag(value, 24) OVER w AS hist_1D, lag(value, 25) OVER w AS hist_1D1H, value
      FROM filled WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, ts, month, day, minute, event_type, round(hist_1D, 6) AS hist_1D, round(hist_1D1H, 6) AS hist_1D1H, round(value, 6) AS value
    FROM l WHERE hist_1D1H IS NOT NULL""",
)
def _(spark, d):
    names = ["month", "day", "minute", "event_type", "hist_1D", "hist-1D1H"]
    return rounded(feat.transform(events(spark, d), "user_id", TS, TARGET, names, "1h", order=["event_id"]))


@query("c11_time_order", "SELECT event_type, ts, event_id FROM events")
def _(spark, d):
    return events(spark, d).select(ENTITY, TS, "event_id").orderBy(ENTITY, TS)


@query("c12_time_range", "SELECT min(ts) AS range_start, max(ts) AS range_end FROM events")
def _(spark, d):
    return schedule.time_range(events(spark, d), TS)


@query(
    "c19_first_of_duplicates",
    """WITH k AS (SELECT event_type, date_trunc('hour', ts) AS ts, event_id, value FROM events)
    SELECT event_type, ts, event_id, value FROM k QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1""",
)
def _(spark, d):
    return clean.first_wins(_hours(spark, d), [ENTITY, TS], ["event_id"])


def _hours(spark, d):
    hour = F.date_trunc("hour", TS).cast("timestamp_ntz")
    return events(spark, d).select(ENTITY, hour.alias(TS), "event_id", TARGET)


@query(
    "c19_duplicate_counts",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT date_trunc('hour', ts)) AS kept,
    count(*) - count(DISTINCT date_trunc('hour', ts)) AS dropped FROM events GROUP BY 1""",
)
def _(spark, d):
    return clean.duplicate_counts(_hours(spark, d), [ENTITY, TS], ENTITY)
