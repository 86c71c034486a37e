"""Reader, writer and store queries: the given tables go out to a shared folder and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import schedule, scores
from gaugeline.operators import features as feat
from gaugeline.plans import backtest
from gaugeline.queries.common import ENTITY, TARGET, TS, WEEK, feature_table, naive_predictions, span
from gaugeline.queries.registry import FEATURES, NAIVE, WINDOWS, events, query, ratio_sql, rounded, table
from gaugeline.session import scratch_dir
from gaugeline.sources import files, store

_ALL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


@query("a1_csv_scan", _ALL)
def _(spark, d):
    ev = events(spark, d)
    path = scratch_dir(spark, "csv")
    files.write_csv(ev, path)
    return files.read_csv(spark, path, schema=ev.schema)


@query("a2_append_files", """SELECT event_id, user_id, event_type, round(value * 1000, 2) AS value,
    CASE WHEN ts < TIMESTAMP '2024-01-16' THEN props END AS props FROM events""")  # fmt: skip
def _(spark, d):
    ev = events(spark, d).withColumn(TARGET, F.format_number(F.col(TARGET) * 1000, 2))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    folder = scratch_dir(spark, "parts")  # one folder, three layouts
    first = ev.filter(F.col(TS) < cut).select("event_id", "user_id", "event_type", TARGET, "props")
    files.write_csv(first.toDF("event_id", " user_id ", "event   _type", " value", "props"), folder)
    second = ev.filter(F.col(TS) >= cut).select(TARGET, F.concat(F.lit("  "), "event_type").alias("event_type"), "user_id", "event_id")
    files.write_csv(second.filter("event_id % 2 = 0").toDF("value  ", "event_type", "user _id", "event_id"), folder, "append")
    files.write_csv(second.filter("event_id % 2 = 1").select("user_id", "event_id", TARGET, "event_type"), folder, "append")
    both = files.read_usage(spark, [folder], metrics=[TARGET])
    return both.select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "event_type", TARGET, "props")


@query("a3_gzip_csv", _ALL)
def _(spark, d):
    ev = events(spark, d)
    path = scratch_dir(spark, "zipped") + ".csv.gz"
    files.write_csv(ev, path)
    return files.read_csv(spark, path, schema=ev.schema)


@query("a4_pipe_delimited", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    customers = table(spark, d, "customer")
    path = scratch_dir(spark, "piped")
    customers.write.option("header", True).option("sep", "|").csv(path)
    return files.read_csv(spark, path, sep="|", schema=customers.schema)


@query(
    "a5_labelled_lines",
    r"""SELECT lang AS label, regexp_replace(text, '[\t\r\n]+', ' ', 'g') AS message FROM documents WHERE lang <> 'de'""",
)
def _(spark, d):
    line = F.concat_ws("\t", "lang", F.regexp_replace("text", r"[\t\r\n]+", " "))
    lines = table(spark, d, "documents").select(F.when(F.col("lang") == "de", F.concat(line, F.lit("\tthird"))).otherwise(line))
    path = scratch_dir(spark, "labelled")
    lines.write.text(path)
    return files.read_labelled(spark, path)


@query(
    "a6_features_export",
    f"WITH {FEATURES} SELECT event_type, ts, weekday, hour, round(hist_1D, 6) AS hist_1D, round(value, 6) AS value FROM features",
)
def _(spark, d):
    rows = feature_table(spark, d)
    path = scratch_dir(spark, "features") + ".gz"
    files.write_csv(rows, path)
    return rounded(files.read_csv(spark, path, schema=rows.schema))


@query("a7_break_out", "SELECT user_id, ts, value FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 100)")
def _(spark, d):
    ev = events(spark, d).select("user_id", TS, TARGET)
    path = scratch_dir(spark, "broken-out")
    store.break_out(ev, "user_id", TS, path, first_n=100)
    return store.read_broken_out(spark, path, ev.schema)


@query("a7_break_out_buckets", "SELECT user_id, ts, value FROM events")
def _(spark, d):
    ev = events(spark, d).select("user_id", TS, TARGET)
    path = scratch_dir(spark, "bucketed")
    store.break_out(ev, "user_id", TS, path, fmt="parquet", buckets=16)
    return store.read_broken_out(spark, path, ev.schema, fmt="parquet")


# Two overlapping deliveries with several rows per (event_type, hour); the second one carries other values.
def _deliveries(spark, d):
    hour = F.date_trunc("hour", TS).cast("timestamp_ntz")
    ev = events(spark, d).select(ENTITY, hour.alias("hour"), "event_id", TARGET, TS)
    first = ev.filter(F.col(TS) < F.lit("2024-01-18").cast("timestamp_ntz"))
    second = ev.filter(F.col(TS) >= F.lit("2024-01-12").cast("timestamp_ntz")).withColumn(TARGET, F.col(TARGET) + 1000)
    return [x.select(ENTITY, F.col("hour").alias(TS), "event_id", TARGET) for x in (first, second)]


_MERGED = """WITH both_parts AS (
  SELECT event_type, date_trunc('hour', ts) AS ts, event_id, value, 0 AS part FROM events WHERE ts < TIMESTAMP '2024-01-18'
  UNION ALL SELECT event_type, date_trunc('hour', ts), event_id, value + 1000, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-12')
SELECT event_type, ts, event_id, value FROM both_parts QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY part, event_id) = 1"""


@query("a8_entity_store_merge", _MERGED)
def _(spark, d):
    path = scratch_dir(spark, "store")
    for part in _deliveries(spark, d):
        store.merge(part, path, ENTITY, TS, ["event_id"])
    return store.read_store(spark, path).select(ENTITY, TS, "event_id", TARGET)


@query("a8_merged_view", _MERGED)
def _(spark, d):
    first, second = _deliveries(spark, d)
    return store.merged_view(first, second, ENTITY, TS, ["event_id"])


@query(
    "a8_merge_skip_existing",
    """WITH f AS (SELECT user_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-02')
    SELECT * FROM f UNION ALL SELECT user_id, ts, value FROM events WHERE user_id NOT IN (SELECT user_id FROM f)""",
)
def _(spark, d):
    ev = events(spark, d).select("user_id", TS, TARGET)
    path = scratch_dir(spark, "store")
    store.merge(ev.filter(F.col(TS) < F.lit("2024-01-02").cast("timestamp_ntz")), path, "user_id", TS, [TARGET])
    store.merge(ev, path, "user_id", TS, [TARGET], skip_existing=True)
    return store.read_store(spark, path).select("user_id", TS, TARGET)


CONFIG = {"features": ["weekday", "hour", "hist_1D"], "target": TARGET, "interval": "1h", "train_days": 7, "predict_days": 1}

_STORED = f"""WITH {NAIVE} SELECT entity, 'value' AS target, '1h' AS interval, 7 AS train_days, 1 AS predict_days, 'weekday,hour,hist_1D' AS features,
  ts, round(predict + CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 1000 ELSE 0 END, 6) AS predict, round(actual, 6) AS actual FROM pred"""


def _flat(df):
    return rounded(df.withColumn("features", F.array_join("features", ",")))


@query("a9_prediction_records", _STORED)
def _(spark, d):
    pred = naive_predictions(spark, d)
    path = scratch_dir(spark, "predictions")
    store.write_predictions(pred.filter(F.col(TS) < F.lit("2024-01-20").cast("timestamp_ntz")), path, CONFIG)
    again = pred.filter(F.col(TS) >= F.lit("2024-01-15").cast("timestamp_ntz")).withColumn("predict", F.col("predict") + 1000)
    store.write_predictions(again, path, CONFIG)
    return _flat(store.read_predictions(spark, path))


@query("a10_read_records", _STORED.replace("THEN 1000", "THEN 0"))
def _(spark, d):
    path = scratch_dir(spark, "records")
    store.records(naive_predictions(spark, d), CONFIG).write.partitionBy("period").json(path)
    return _flat(store.read_predictions(spark, path))


@query("a11_pending_work", f"WITH {WINDOWS} SELECT window_id, train_start FROM windows WHERE predict_start >= TIMESTAMP '2024-01-15'")
def _(spark, d):
    plan = schedule.windows(span(spark, d), WEEK).select("window_id", "train_start", "predict_start")
    path = scratch_dir(spark, "done")
    plan.filter(F.col("predict_start") < F.lit("2024-01-15").cast("timestamp_ntz")).select("window_id").write.parquet(path)
    return store.pending(plan, path, ["window_id"]).select("window_id", "train_start")


def _ledger_sql(name: str, lag: int) -> str:
    sql = NAIVE.replace("lag(value, 24)", f"lag(value, {lag})")
    return f"""SELECT '{name}' AS variation, round(sum(n * error) / sum(n), 6) AS overall_error FROM (
      WITH {sql} SELECT entity, avg({ratio_sql()}) AS error, count(*) AS n FROM pred GROUP BY 1)"""


@query("a12_result_ledger", f"{_ledger_sql('hist_1D', 24)} UNION ALL {_ledger_sql('hist_2D', 48)}")
def _(spark, d):
    path = scratch_dir(spark, "ledger")
    for name in ("hist_1D", "hist_2D"):
        rows = feat.transform(events(spark, d), ENTITY, TS, TARGET, [name], "1h")
        pred = backtest.naive(rows, span(spark, d), WEEK, ENTITY, TS, TARGET, name)
        overall = scores.overall_error(scores.entity_errors(pred)).select(F.lit(name).alias("variation"), "overall_error")
        store.append_ledger(overall, path)
    return rounded(store.ledger(spark, path))


def _per_type(spark, d):
    base = scratch_dir(spark, "runs")
    types = [r[0] for r in events(spark, d).select(ENTITY).distinct().orderBy(ENTITY).collect()]  # one file each
    paths = [f"{base}/{t}" for t in types]
    for t, path in zip(types, paths):
        files.write_csv(events(spark, d).filter(F.col(ENTITY) == t).select("event_id", TARGET), path)
    return paths


@query("a13_runs_per_file", "SELECT event_type AS run, count(*) AS n FROM events WHERE event_type < 'signup' GROUP BY 1")
def _(spark, d):
    chosen = files.runs(_per_type(spark, d), max_files=3)
    rows = files.append_files(spark, [p for run in chosen for p in run], with_source=True)
    run = F.element_at(F.split(files.SOURCE, "/"), -2)
    return rows.groupBy(run.alias("run")).agg(F.count("*").alias("n"))


@query("a13_runs_joined", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def _(spark, d):
    (run,) = files.runs(_per_type(spark, d), joined=True, shuffle_seed=7)
    rows = files.append_files(spark, run, infer=True)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(TARGET), 4).alias("total"))


@query("a14_head", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 10")
def _(spark, d):
    return files.head(events(spark, d).select("event_id", TS, TARGET), 10, [TS, "event_id"])


@query("a14_tail", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(spark, d):
    return files.tail(events(spark, d).select("event_id", TS, TARGET), 10, [TS, "event_id"])


@query("a14_shape", "SELECT count(*) AS rows, 11 AS cols FROM lineitem")
def _(spark, d):
    return files.shape(table(spark, d, "lineitem"))


@query("a14_column_names", """SELECT CAST(column_index - 1 AS BIGINT) AS position, column_name AS name FROM duckdb_columns()
    WHERE table_name = 'customer' AND NOT internal""")  # fmt: skip
def _(spark, d):
    return files.column_names(table(spark, d, "customer"))


@query("a15_concat_same_layout", "SELECT event_id, ts, value FROM events")
def _(spark, d):
    ev = events(spark, d).select("event_id", TS, TARGET)
    parts = []
    for keep in (F.col(TARGET) < 50, F.col(TARGET) >= 50):
        path = scratch_dir(spark, "same")
        files.write_csv(ev.filter(keep), path)
        parts.append(files.read_csv(spark, path, schema=ev.schema))
    return files.concat_same_layout(parts)
