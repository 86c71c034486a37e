"""Streaming queries: files written from the given tables are drained to completion, the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import models, schedule
from gaugeline.plans import forecast
from gaugeline.queries.common import ENTITY, TARGET, TS, feature_table, naive_predictions, span
from gaugeline.queries.files import CONFIG, _flat
from gaugeline.queries.registry import NAIVE, events, query, ratio_sql, rounded
from gaugeline.session import materialize, scratch_dir
from gaugeline.sources import store
from gaugeline.streaming import flows

_NAMES = [ENTITY, "weekday", "hour", "hist_1D"]


@query("t1_stream_scoring")
def _(spark, d):
    rows = materialize(feature_table(spark, d, _NAMES), "features")
    train = schedule.first_interval(rows, TS, "21D", span=span(spark, d))
    model = forecast.fit(train, _NAMES, TARGET, models.model_kind("RF", {"rf__n_estimators": 20}))
    inbox, out, checkpoint = (scratch_dir(spark, x) for x in ("inbox", "scored", "checkpoint"))
    sent = rows.select(ENTITY, TS, "weekday", "hour", F.col("hist_1D").alias("hist-1D"))
    sent.write.parquet(inbox)
    stream = flows.arriving(spark, inbox, sent.schema, files_per_batch=2)
    flows.score(stream, model, [ENTITY, TS], out, checkpoint).awaitTermination()
    return spark.read.parquet(out).join(rows.select(ENTITY, TS, TARGET), [ENTITY, TS])


@query(
    "t2_stream_ingest",
    """SELECT event_type, date_trunc('hour', ts) AS ts, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) = 1""",
)
def _(spark, d):
    hour = F.date_trunc("hour", TS).cast("timestamp_ntz")
    ev = events(spark, d).select(ENTITY, hour.alias(TS), "event_id", TARGET)
    inbox, path = scratch_dir(spark, "inbox"), scratch_dir(spark, "store")
    # One delivery after the other, the second one repeating a part of the first.
    early = F.col(TS) < F.lit("2024-01-18").cast("timestamp_ntz")
    late = F.col(TS) >= F.lit("2024-01-12").cast("timestamp_ntz")
    checkpoint = scratch_dir(spark, "checkpoint")
    for part in (ev.filter(early), ev.filter(late)):
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = flows.arriving(spark, inbox, ev.schema, files_per_batch=1)
        flows.ingest(stream, path, ENTITY, TS, ["event_id"], checkpoint).awaitTermination()
    return store.read_store(spark, path).select(ENTITY, TS, "event_id", TARGET)


@query("t2_stream_first_within", "SELECT event_id, ts, event_type FROM events")
def _(spark, d):
    ev = events(spark, d).select("event_id", TS, ENTITY)
    inbox, out, checkpoint = (scratch_dir(spark, x) for x in ("inbox", "unique", "checkpoint"))
    ev.unionByName(ev).repartition(4, "event_id").write.parquet(inbox)
    stream = flows.arriving(spark, inbox, ev.schema)
    unique = flows.first_within(stream, "event_id", TS, "40 days")
    writer = unique.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


_CUT, _BACK = "2024-01-20", "2024-01-12"  # the second delivery begins _BACK; the first ends before _CUT


@query(
    "t2_first_or_late",
    f"""WITH d AS (SELECT event_type, date_trunc('hour', ts) AS ts, event_id, value FROM events),
    one AS (SELECT *, false AS late FROM d WHERE ts < TIMESTAMP '{_CUT}' QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1),
    mark AS (SELECT max(ts) - INTERVAL 5 DAY AS m FROM d WHERE ts < TIMESTAMP '{_CUT}'),
    two AS (SELECT d.*, m FROM d, mark WHERE ts >= TIMESTAMP '{_BACK}'),
    fresh AS (SELECT event_type, ts, event_id, value, false AS late FROM two WHERE ts >= m AND (event_type, ts) NOT IN (SELECT (event_type, ts) FROM one)
      QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1)
    SELECT * FROM one UNION ALL SELECT * FROM fresh UNION ALL SELECT event_type, ts, event_id, value, true FROM two WHERE ts < m""",
)
def _(spark, d):
    hour = F.date_trunc("hour", TS).cast("timestamp_ntz")
    ev = events(spark, d).select(ENTITY, hour.alias(TS), "event_id", TARGET)
    inbox, out, late, checkpoint = (scratch_dir(spark, x) for x in ("inbox", "first", "late", "checkpoint"))
    for part in (ev.filter(F.col(TS) < F.lit(_CUT).cast("timestamp_ntz")), ev.filter(F.col(TS) >= F.lit(_BACK).cast("timestamp_ntz"))):
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = flows.arriving(spark, inbox, ev.schema, files_per_batch=1)
        flows.first_or_late(stream, ENTITY, TS, ["event_id"], "5D", out, late, checkpoint).awaitTermination()
    both = [spark.read.schema(ev.schema).parquet(path).select(*ev.columns, F.lit(path == late).alias("late")) for path in (out, late)]
    return both[0].unionByName(both[1])


@query("j6_stream_errors", f"WITH {NAIVE} SELECT entity, round(avg({ratio_sql()}), 6) AS error, count(*) AS n FROM pred GROUP BY 1")
def _(spark, d):
    # Scores arrive a part at a time, their actual values one part later.
    pred = materialize(naive_predictions(spark, d).select("entity", TS, "predict", "actual"), "pred")
    sent, seen, out, checkpoint = (scratch_dir(spark, x) for x in ("sent", "seen", "errors", "checkpoint"))
    cuts = ["2024-01-01", "2024-01-15", "2024-01-22", "2025-01-01"]
    parts = [pred.filter((F.col(TS) >= F.lit(a).cast("timestamp_ntz")) & (F.col(TS) < F.lit(b).cast("timestamp_ntz"))) for a, b in zip(cuts, cuts[1:])]
    scored, actual = pred.select("entity", TS, "predict"), pred.select("entity", TS, "actual")
    for new, old in zip([*parts, parts[0].limit(0)], [parts[0].limit(0), *parts]):
        new.select(scored.columns).coalesce(1).write.mode("append").parquet(sent)
        old.select(actual.columns).coalesce(1).write.mode("append").parquet(seen)
        met = flows.meet(flows.arriving(spark, sent, scored.schema), flows.arriving(spark, seen, actual.schema), ["entity", TS], TS, "20 days")
        flows.add_errors(met, out, checkpoint).awaitTermination()
    return rounded(flows.errors_so_far(spark, out))


@query("t3_stream_predictions", f"""WITH {NAIVE} SELECT entity, 'value' AS target, '1h' AS interval, 7 AS train_days, 1 AS predict_days,
    'weekday,hour,hist_1D' AS features, ts, round(predict, 6) AS predict, round(actual, 6) AS actual FROM pred""")  # fmt: skip
def _(spark, d):
    pred = naive_predictions(spark, d).select("entity", TS, "predict", "actual")
    inbox, path, checkpoint = (scratch_dir(spark, x) for x in ("inbox", "predictions", "checkpoint"))
    early, late = F.lit("2024-01-20").cast("timestamp_ntz"), F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (pred.filter(F.col(TS) < early), pred.filter(F.col(TS) >= late)):
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = flows.arriving(spark, inbox, pred.schema, files_per_batch=1)
        flows.keep_predictions(stream, path, CONFIG, checkpoint).awaitTermination()
    return _flat(store.read_predictions(spark, path))
