"""Error and view queries over seasonal-naive predictions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gaugeline.functions import errors
from gaugeline.operators import perbin, scores, views
from gaugeline.plans import backtest
from gaugeline.queries.common import ENTITY, TARGET, TS, feature_table, naive_predictions
from gaugeline.queries.registry import GRID, NAIVE, events, query, ratio_sql, rounded, table
from gaugeline.sources import store

_R = ratio_sql()


@query(
    "daily_naive_errors",
    f"""WITH {GRID}, p AS (SELECT event_type, lag(value, 24) OVER (PARTITION BY event_type ORDER BY ts) AS predict, value AS actual FROM grid)
    SELECT event_type, round(avg({_R}), 6) AS error, count(*) AS n FROM p WHERE predict IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    return rounded(backtest.daily_naive_errors(events(spark, d), ENTITY, TS, TARGET))


@query("d1_average_absolute_error", f"WITH {NAIVE} SELECT round(avg({_R}), 6) AS aae FROM pred")
def _(spark, d):
    return rounded(naive_predictions(spark, d).agg(errors.aae().alias("aae")))


@query(
    "d2_error_zero_denominator",
    """SELECT l_returnflag, round(avg(CASE WHEN l_discount IS NULL OR l_tax IS NULL THEN NULL
      WHEN greatest(l_discount, l_tax) = 0 THEN 0 ELSE abs(l_tax - l_discount) / nullif(greatest(l_discount, l_tax), 0) END), 6) AS aae
    FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem")
    return rounded(lines.groupBy("l_returnflag").agg(errors.aae_zero("l_tax", "l_discount").alias("aae")))


@query("d3_entity_errors", f"WITH {NAIVE} SELECT entity, round(avg({_R}), 6) AS error, count(*) AS n FROM pred GROUP BY 1")
def _(spark, d):
    return rounded(scores.entity_errors(naive_predictions(spark, d)))


@query(
    "d4_overall_error",
    f"""WITH {NAIVE}, e AS (SELECT entity, avg({_R}) AS error, count(*) AS n FROM pred GROUP BY 1)
    SELECT round(sum(n * error) / sum(CASE WHEN error IS NOT NULL THEN n END), 6) AS overall_error, count(error) AS entities,
    count(*) FILTER (WHERE error >= 0.99) AS suspicious FROM e""",
)
def _(spark, d):
    return rounded(scores.overall_error(scores.entity_errors(naive_predictions(spark, d))))


_DAYS = f"""{NAIVE}, days AS (
  SELECT entity, date_trunc('day', ts) AS ts, quantile_cont(predict, 0.95) AS pp, quantile_cont(actual, 0.95) AS pa,
    stddev_pop(predict) AS sp, stddev_pop(actual) AS sa, var_pop(predict) AS vp, var_pop(actual) AS va FROM pred GROUP BY ALL)"""


def _daily(spark, d, view):
    wide = views.daily(naive_predictions(spark, d), views=[view])
    return rounded(wide.select("entity", "ts", F.col(view)["predict"].alias("predict"), F.col(view)["actual"].alias("actual")))


@query("d5_daily_percentile", f"WITH {_DAYS} SELECT entity, CAST(ts AS TIMESTAMP) AS ts, round(pp, 6) AS predict, round(pa, 6) AS actual FROM days")
def _(spark, d):
    return _daily(spark, d, "percentile")


@query("d6_daily_deviation", f"WITH {_DAYS} SELECT entity, CAST(ts AS TIMESTAMP) AS ts, round(sp, 6) AS predict, round(sa, 6) AS actual FROM days")
def _(spark, d):
    return _daily(spark, d, "std")


@query("d7_daily_variance", f"WITH {_DAYS} SELECT entity, CAST(ts AS TIMESTAMP) AS ts, round(vp, 6) AS predict, round(va, 6) AS actual FROM days")
def _(spark, d):
    return _daily(spark, d, "variance")


# Two sparse series per event type: predict = value, actual = the number inside props.
_SPARSE = """
raw AS (SELECT user_id AS entity, ts, value AS predict, CAST(json_extract(props, '$.k') AS DOUBLE) AS actual FROM events),
hb AS (SELECT entity, date_trunc('hour', ts) AS ts, avg(predict) AS predict, avg(actual) AS actual FROM raw GROUP BY ALL),
hs AS (SELECT entity, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hb GROUP BY entity),
hourly AS (SELECT entity, ts, hb.predict, hb.actual FROM hs LEFT JOIN hb USING (entity, ts))"""

_FORWARD = (
    _SPARSE
    + """,
fwd AS (SELECT entity, ts, CAST(ts AS DATE) AS day, hour(ts) AS h, predict, actual, avg(predict) OVER w AS fp, avg(actual) OVER w AS fa FROM hourly
  WINDOW w AS (PARTITION BY entity, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
busy AS (SELECT entity, CAST(day AS TIMESTAMP) AS ts, CAST(arg_max(h, fp * 1000000 - h / 1000000.0) AS DOUBLE) AS hp, max(fp) AS mp,
  CAST(arg_max(h, fa * 1000000 - h / 1000000.0) AS DOUBLE) AS ha, max(fa) AS ma FROM fwd GROUP BY ALL)"""
)


def _sparse(spark, d):
    number = F.get_json_object("props", "$.k").cast("double")
    return events(spark, d).select(F.col("user_id").alias("entity"), TS, F.col(TARGET).alias("predict"), number.alias("actual"))


@query("d8_hourly_mean", f"WITH {_SPARSE} SELECT entity, ts, round(predict, 6) AS predict, round(actual, 6) AS actual FROM hourly")
def _(spark, d):
    return rounded(views.hourly_means(_sparse(spark, d)))


@query("d9_forward_average", f"WITH {_FORWARD} SELECT entity, ts, round(fp, 6) AS ahead FROM fwd")
def _(spark, d):
    hourly = views.hourly_means(_sparse(spark, d), series=["predict"])
    return rounded(views.forward_average(hourly, "predict", "ahead").select("entity", "ts", "ahead"))


@query("d10_busy_hour", f"WITH {_FORWARD} SELECT entity, ts, hp AS predict FROM busy")
def _(spark, d):
    wide = views.daily(_sparse(spark, d), views=["busy_hour"])
    return wide.select("entity", "ts", F.col("busy_hour")["predict"].alias("predict"))


@query("d11_busy_average", f"WITH {_FORWARD} SELECT entity, ts, round(mp, 6) AS predict, round(ma, 6) AS actual FROM busy")
def _(spark, d):
    wide = views.daily(_sparse(spark, d), views=["busy_avg"])
    return rounded(wide.select("entity", "ts", F.col("busy_avg")["predict"].alias("predict"), F.col("busy_avg")["actual"].alias("actual")))


@query("d10_busy_hour_running", f"""WITH {NAIVE}, fwd AS (SELECT entity, CAST(ts AS DATE) AS day, hour(ts) AS h, avg(actual) OVER (PARTITION BY entity,
      CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS fa FROM pred)
    SELECT entity, CAST(day AS TIMESTAMP) AS ts, CAST(arg_max(h, (fa, -h)) AS DOUBLE) AS actual FROM fwd GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    wide = views.daily(naive_predictions(spark, d), views=["busy_hour"], mode="reference")
    return wide.select("entity", "ts", F.col("busy_hour")["actual"].alias("actual"))


# Series that begin many a day with hours of zero or without a value, where the running comparison is not the highest score.
_GAPS = "CASE WHEN day(ts) % 3 = 1 AND hour(ts) < 8 THEN 0.0 WHEN day(ts) % 3 = 2 AND hour(ts) < 5 THEN NULL ELSE {} END"


def _running(series: str) -> str:
    return f"list_reduce(list({{'s': {series}, 'h': h}} ORDER BY h), lambda a, x: CASE WHEN a.s = 0 OR x.s > a.s THEN x ELSE a END)"


@query("d10_busy_hour_running_gaps", f"""WITH {NAIVE}, gaps AS (SELECT entity, ts, {_GAPS.format("predict")} AS p, {_GAPS.format("actual")} AS a FROM pred),
    fwd AS (SELECT entity, CAST(ts AS DATE) AS day, hour(ts) AS h, avg(p) OVER w AS fp, avg(a) OVER w AS fa FROM gaps
      WINDOW w AS (PARTITION BY entity, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
    best AS (SELECT entity, day, {_running("fp")} AS p, {_running("fa")} AS a FROM fwd GROUP BY ALL)
    SELECT entity, CAST(day AS TIMESTAMP) AS ts, CAST(p.h AS DOUBLE) AS predict, CAST(a.h AS DOUBLE) AS actual, round(p.s, 6) AS predict_mean, round(a.s, 6) AS actual_mean
    FROM best""")  # fmt: skip
def _(spark, d):
    pred = naive_predictions(spark, d).withColumns({c: F.expr(_GAPS.format(c)) for c in ("predict", "actual")})
    hour, mean = F.col("busy_hour"), F.col("busy_avg")
    wide = views.daily(pred, views=["busy_hour", "busy_avg"], mode="reference")
    return rounded(wide.select("entity", "ts", hour["predict"].alias("predict"), hour["actual"].alias("actual"), mean["predict"].alias("predict_mean"), mean["actual"].alias("actual_mean")))


@query("d12_original_view", f"WITH {NAIVE} SELECT entity, 'original' AS view, ts, round(predict, 6) AS predict, round(actual, 6) AS actual FROM pred")
def _(spark, d):
    return rounded(views.build(naive_predictions(spark, d), views=["original"]))


def trimmed_mean(values):
    """Mean without the lowest and the highest tenth of the known values."""
    known = np.sort(values[~np.isnan(values)])
    cut = len(known) // 10
    kept = known[cut : len(known) - cut].tolist()
    return math.fsum(kept) / len(kept) if kept else None


def _trimmed(column: str) -> str:
    return f"""SELECT entity, day, favg({column}) AS {column} FROM (
      SELECT entity, day, {column}, row_number() OVER w AS nr, count(*) OVER (PARTITION BY entity, day) AS n
      FROM (SELECT entity, CAST(ts AS DATE) AS day, {column} FROM pred WHERE {column} IS NOT NULL) WINDOW w AS (PARTITION BY entity, day ORDER BY {column}))
      WHERE nr > n // 10 AND nr <= n - n // 10 GROUP BY ALL"""


@query("x2_trimmed_mean_view", f"""WITH {NAIVE}, p AS ({_trimmed("predict")}), a AS ({_trimmed("actual")})
    SELECT entity, view, CAST(day AS TIMESTAMP) AS ts, round(predict, 9) AS predict, round(actual, 9) AS actual FROM (
      SELECT entity, 'trimmed' AS view, day, predict, actual FROM p JOIN a USING (entity, day)
      UNION ALL SELECT entity, 'std', CAST(ts AS DATE), stddev_pop(predict), stddev_pop(actual) FROM pred GROUP BY entity, CAST(ts AS DATE))""")  # fmt: skip
def _(spark, d):
    return rounded(views.build(naive_predictions(spark, d), views=["std"], custom={"trimmed": trimmed_mean}), 9)


def _middle_distance(values):
    known = values[~np.isnan(values)]
    return np.median(np.abs(known - np.median(known))) if len(known) else None


@query("x2_rebinned_grid", f"""WITH {GRID} SELECT event_type, make_timestamp(CAST(epoch(ts) AS BIGINT) // 21600 * 21600000000) AS ts,
    round(mad(value), 6) AS mad_value, round(arg_max(value, ts) - arg_min(value, ts), 6) AS rise_value FROM grid WHERE value IS NOT NULL GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    hourly = feature_table(spark, d, [], drop=False)
    return rounded(perbin.rebin(hourly, ENTITY, TS, "6h", [TARGET], {"mad": _middle_distance, "rise": lambda v: v[-1] - v[0]}))


_BUNDLE = f"""{_DAYS},
fwd AS (SELECT entity, date_trunc('day', ts) AS ts, hour(ts) AS h, avg(predict) OVER w AS fp, avg(actual) OVER w AS fa FROM pred
  WINDOW w AS (PARTITION BY entity, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
busy AS (SELECT entity, ts, CAST(arg_max(h, (fp, -h)) AS DOUBLE) AS hp, max(fp) AS mp, CAST(arg_max(h, (fa, -h)) AS DOUBLE) AS ha,
  max(fa) AS ma FROM fwd GROUP BY ALL),
bundle AS (
  SELECT entity, 'original' AS view, ts, predict, actual FROM pred
  UNION ALL SELECT entity, 'percentile_95', CAST(ts AS TIMESTAMP), pp, pa FROM days
  UNION ALL SELECT entity, 'std', CAST(ts AS TIMESTAMP), sp, sa FROM days
  UNION ALL SELECT entity, 'variance', CAST(ts AS TIMESTAMP), vp, va FROM days
  UNION ALL SELECT entity, 'busy_hour_4H', CAST(ts AS TIMESTAMP), hp, ha FROM busy
  UNION ALL SELECT entity, 'busy_avg_4H', CAST(ts AS TIMESTAMP), mp, ma FROM busy),
scored AS (
  SELECT entity, view, count(*) AS rows,
    CASE WHEN view LIKE 'percentile%' OR view LIKE 'busy_avg%' THEN round(avg({_R}), 6) END AS error FROM bundle GROUP BY entity, view)"""


@query("d13_view_bundle", f"WITH {_BUNDLE} SELECT entity, view, ts, round(predict, 6) AS predict, round(actual, 6) AS actual FROM bundle")
def _(spark, d):
    return rounded(views.build(naive_predictions(spark, d)))


@query("d13_view_errors", f"WITH {_BUNDLE} SELECT entity, view, error FROM scored WHERE error IS NOT NULL")
def _(spark, d):
    return rounded(views.view_errors(views.build(naive_predictions(spark, d))))


@query(
    "d14_entity_report",
    f"""WITH {_BUNDLE} SELECT entity, string_agg(view || ':' || rows, ' ' ORDER BY view) AS views, round(sum(error), 5) AS errors FROM scored GROUP BY 1""",
)
def _(spark, d):
    report = views.report(views.build(naive_predictions(spark, d)))
    entries = F.transform("views", lambda v: F.concat_ws(":", v["view"], v["rows"].cast("string")))
    known = F.filter(F.transform("views", lambda v: F.round(v["error"], 6)), lambda e: e.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, e: acc + e)
    return report.select("entity", F.array_join(entries, " ").alias("views"), F.round(total, 5).alias("errors"))


_CONFIG = {"features": ["weekday", "hour", "hist_1D"], "target": TARGET, "interval": "1h", "train_days": 7, "predict_days": 1}


@query("d15_views_from_records", f"WITH {_BUNDLE} SELECT entity, view, ts, round(predict, 6) AS predict, round(actual, 6) AS actual FROM bundle")
def _(spark, d):
    stored = store.flatten(store.records(naive_predictions(spark, d), _CONFIG))
    return rounded(views.build(stored.select("entity", "ts", "predict", "actual")))


@query("d16_top_entities", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def _(spark, d):
    return scores.top_entities(events(spark, d), "user_id", 40)


@query(
    "d16_top_entities_without",
    "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
def _(spark, d):
    return scores.top_entities(events(spark, d), ENTITY, 3, exclude=("error",))


@query("d17_joined_names", "SELECT user_id, string_agg(DISTINCT event_type, '' ORDER BY event_type) AS names FROM events GROUP BY 1")
def _(spark, d):
    return scores.joined_names(events(spark, d), "user_id", ENTITY)


@query("d17_entity_names", "SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS name FROM events WHERE user_id IS NOT NULL")
def _(spark, d):
    return scores.entity_names(events(spark, d).withColumn("name", F.col("user_id").cast("string")), ENTITY, "name")


@query(
    "d18_run_statistics",
    "SELECT count(*) AS rows, count(DISTINCT user_id) AS entities, min(ts) AS first_ts, max(ts) AS last_ts FROM events",
)
def _(spark, d):
    return scores.run_statistics(events(spark, d), "user_id", TS)


@query(
    "d18_statistics_by_type",
    "SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS entities, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1",
)
def _(spark, d):
    return scores.run_statistics(events(spark, d), "user_id", TS, by=ENTITY)


@query("j6_scored_with_actual", f"WITH {NAIVE} SELECT entity, ts, round(predict, 6) AS predict, round(actual, 6) AS actual FROM pred")
def _(spark, d):
    pred = naive_predictions(spark, d)
    actual = pred.select("entity", "ts", "actual")
    return rounded(backtest.scored_with_actual(pred.select("entity", "ts", "predict"), actual, ["entity", "ts"]))

