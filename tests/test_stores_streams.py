from pyspark.sql import functions as F

from gaugeline.session import scratch_dir
from gaugeline.sources import store
from gaugeline.streaming import flows

CONFIG = {"features": ["hour"], "target": "cpu_usage", "interval": "15min", "train_days": 31, "predict_days": 1}


def _stored(spark, path):
    return [(r.entity, str(r.ts), r.value) for r in store.read_store(spark, path).orderBy("entity", "ts").collect()]


def test_merge_keeps_the_first(spark, series):
    path = scratch_dir(spark, "store")
    store.merge(series([("a", "2024-01-01 00:00:00", 2.0), ("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-02-01 00:00:00", 5.0)]),
                path, "entity", "ts", ["value"])
    again = series([("a", "2024-01-01 00:00:00", 0.5), ("a", "2024-03-01 00:00:00", 7.0), ("b", "2024-01-01 00:00:00", 8.0)])
    want = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-02-01 00:00:00", 5.0), ("a", "2024-03-01 00:00:00", 7.0), ("b", "2024-01-01 00:00:00", 8.0)]
    for _ in range(2):  # repeating a delivery adds nothing
        store.merge(again, path, "entity", "ts", ["value"])
        assert _stored(spark, path) == want


def test_merge_can_leave_known_entities_alone(spark, series):
    path = scratch_dir(spark, "store")
    store.merge(series([("a", "2024-01-01 00:00:00", 1.0)]), path, "entity", "ts", ["value"])
    store.merge(series([("a", "2024-01-02 00:00:00", 2.0), ("b", "2024-01-02 00:00:00", 3.0)]), path, "entity", "ts", ["value"], skip_existing=True)
    assert _stored(spark, path) == [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-02 00:00:00", 3.0)]


def _pred(series, rows):
    return series(rows).withColumnRenamed("value", "predict").withColumn("actual", F.lit(1.0))


def test_prediction_records(spark, series):
    path = scratch_dir(spark, "predictions")
    store.write_predictions(_pred(series, [("v1", "2024-01-01 00:00:00", 1.5), ("v1", "2024-03-01 00:00:00", None)]), path, CONFIG)
    store.write_predictions(_pred(series, [("v1", "2024-01-01 00:00:00", 9.0), ("v1", "2024-01-01 00:15:00", 2.5)]), path, CONFIG)
    rows = store.read_predictions(spark, path).orderBy("ts").collect()
    assert [(str(r.ts), r.predict, r.actual) for r in rows] == [
        ("2024-01-01 00:00:00", 1.5, 1.0), ("2024-01-01 00:15:00", 2.5, 1.0), ("2024-03-01 00:00:00", None, 1.0),
    ]
    first = spark.read.json(path).filter("data LIKE '%1704067200000%'").first()
    assert first.entity == "v1" and first.data == '{"1704067200000":{"VM_ID":"v1","predict":1.5,"cpu_usage":1.0}}'


def test_break_out_is_sorted_and_splits_dense_entities(spark):
    df = spark.range(4000).selectExpr("if(id % 10 = 0, 'small', 'big') entity", "timestampadd(SECOND, id * 17 % 4000, TIMESTAMP_NTZ'2024-01-01') ts")
    path = scratch_dir(spark, "out")
    store.break_out(df, "entity", "ts", path, fmt="parquet")
    back = spark.read.parquet(path)
    assert back.count() == 4000
    assert back.filter("entity = 'big'").select(F.input_file_name()).distinct().count() > 1
    for file in back.select(F.input_file_name().alias("f")).distinct().collect():
        times = [r.ts for r in spark.read.parquet(file.f).collect()]
        assert times == sorted(times)


def test_pending(spark):
    path = scratch_dir(spark, "ledger")
    work = spark.range(5).withColumnRenamed("id", "window_id")
    assert store.pending(work, path, ["window_id"]).count() == 5
    work.filter("window_id < 2").write.parquet(path)
    assert store.pending(work, path, ["window_id"]).count() == 3


def test_stream_replay_adds_nothing(spark, series):
    """The same files arrive again under a fresh checkpoint, as after a lost one."""
    inbox, path = scratch_dir(spark, "inbox"), scratch_dir(spark, "store")
    df = series([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:00", 3.0), ("b", "2024-01-01 00:00:00", 2.0)])
    df.write.parquet(inbox)
    for _ in range(2):
        stream = flows.arriving(spark, inbox, df.schema)
        flows.ingest(stream, path, "entity", "ts", ["value"], scratch_dir(spark, "checkpoint")).awaitTermination()
    assert _stored(spark, path) == [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:00:00", 2.0)]


def _parts(series):
    first = series([("a", "2024-01-02 00:00:00", 2.0), ("b", "2024-01-02 00:00:00", 3.0), (None, "2024-01-02 00:00:00", 4.0)])
    second = series([("b", "2024-01-02 01:00:00", 5.0), ("c", "2024-02-02 00:00:00", 6.0), (None, "2024-01-02 01:00:00", 7.0)])
    return first, second


WHOLE = [(None, "2024-01-02 00:00:00", 4.0), (None, "2024-01-02 01:00:00", 7.0), ("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-02 00:00:00", 3.0),
         ("b", "2024-01-02 01:00:00", 5.0), ("c", "2024-02-02 00:00:00", 6.0)]


def test_a_delivery_in_two_calls_is_whole(spark, series):
    path = scratch_dir(spark, "store")
    store.merge(series([("a", "2024-01-01 00:00:00", 1.0)]), path, "entity", "ts", ["value"], delivery="one")
    for part in _parts(series):
        store.merge(part, path, "entity", "ts", ["value"], skip_existing=True, delivery="two")
    assert _stored(spark, path) == WHOLE
    store.merge(series([("b", "2024-05-01 00:00:00", 9.0), ("d", "2024-05-01 00:00:00", 9.0)]), path, "entity", "ts", ["value"], skip_existing=True, delivery="three")
    assert _stored(spark, path) == [*WHOLE, ("d", "2024-05-01 00:00:00", 9.0)]


def test_a_half_written_delivery_is_completed(spark, series, monkeypatch):
    """The rows of one month are there, then the writer died: no ledger line stands yet."""
    path = scratch_dir(spark, "store")
    both = _parts(series)[0].unionByName(_parts(series)[1])
    store.merge(series([("a", "2024-01-01 00:00:00", 1.0)]), path, "entity", "ts", ["value"])
    half = both.filter("entity = 'b' and value = 3.0").withColumn("period", F.lit("2024-01"))
    half.write.mode("append").partitionBy("period").parquet(path)
    store.merge(both, path, "entity", "ts", ["value"], skip_existing=True)
    assert _stored(spark, path) == WHOLE


def test_two_deliveries_in_one_call(spark, series):
    path = scratch_dir(spark, "store")
    df = series([("x", "2024-01-01 00:00:00", 1.0), ("x", "2024-01-01 01:00:00", 2.0), ("y", "2024-01-01 01:00:00", 3.0)]).withColumn("file", F.expr("if(value = 1.0, 'f1', 'f2')"))
    store.merge(df, path, "entity", "ts", ["value"], skip_existing=True, delivery=F.col("file"))
    assert _stored(spark, path) == [("x", "2024-01-01 00:00:00", 1.0), ("y", "2024-01-01 01:00:00", 3.0)]


def test_stream_that_skips_existing_takes_all_its_batches(spark, series):
    inbox, path = scratch_dir(spark, "inbox"), scratch_dir(spark, "store")
    store.merge(series([("a", "2024-01-01 00:00:00", 1.0)]), path, "entity", "ts", ["value"])
    for part in _parts(series):
        part.coalesce(1).write.mode("append").parquet(inbox)
    stream = flows.arriving(spark, inbox, _parts(series)[0].schema, files_per_batch=1)
    flows.ingest(stream, path, "entity", "ts", ["value"], scratch_dir(spark, "checkpoint"), skip_existing=True).awaitTermination()
    assert _stored(spark, path) == WHOLE


def test_late_rows_go_to_their_own_table(spark, series):
    """Three batches under one checkpoint; copies near and far, a null entity, a row without a time, and a batch that runs again."""
    inbox, out, late, checkpoint = (scratch_dir(spark, x) for x in ("inbox", "out", "late", "checkpoint"))
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    batches = [
        [("a", day(1), 2.0), ("a", day(1), 1.0), ("a", day(10), 3.0), (None, day(10), 4.0), ("b", None, 5.0)],
        [("a", day(10), 6.0), ("a", day(9), 7.0), (None, day(10), 8.0), ("a", day(1), 9.0), ("c", day(2), 10.0)],
        [("a", day(9), 11.0), ("a", day(20), 12.0)],
    ]
    for i, rows in enumerate(batches):
        series(rows).coalesce(1).write.mode("append").parquet(inbox)
        stream = flows.arriving(spark, inbox, series(rows).schema, files_per_batch=1)
        flows.first_or_late(stream, "entity", "ts", ["value"], "3D", out, late, checkpoint).awaitTermination()
    values = lambda path: sorted(r.value for r in spark.read.parquet(path).collect())
    assert values(out) == [1.0, 3.0, 4.0, 7.0, 12.0] and values(late) == [5.0, 9.0, 10.0]
    # The batch after the last finds 17 January as its mark.
    series([("a", day(16), 13.0), ("a", day(20), 14.0), ("a", day(17), 15.0)]).coalesce(1).write.mode("append").parquet(inbox)
    stream = flows.arriving(spark, inbox, series(batches[0]).schema, files_per_batch=1)
    flows.first_or_late(stream, "entity", "ts", ["value"], "3D", out, late, checkpoint).awaitTermination()
    assert values(out) == [1.0, 3.0, 4.0, 7.0, 12.0, 15.0] and values(late) == [5.0, 9.0, 10.0, 13.0]


def test_scores_meet_later_actual_values(spark, series):
    """Actual values come a batch after their scores, some never; the running error is that of all pairs so far."""
    from gaugeline.operators import scores

    sent, seen, out, checkpoint = (scratch_dir(spark, x) for x in ("sent", "seen", "errors", "checkpoint"))
    hours = [f"2024-01-01 {h:02d}:00:00" for h in range(6)]
    scored = series([(e, t, float(i + 1)) for e in "ab" for i, t in enumerate(hours)]).withColumnRenamed("value", "predict")
    actual = series([(e, t, float(2 * i)) for e in "ab" for i, t in enumerate(hours[: 5 if e == "b" else 6])]).withColumnRenamed("value", "actual")
    early = F.col("ts") < F.lit(hours[3]).cast("timestamp_ntz")
    for new, old in ((scored.filter(early), actual.limit(0)), (scored.filter(~early), actual.filter(early)), (scored.limit(0), actual.filter(~early))):
        new.coalesce(1).write.mode("append").parquet(sent)
        old.coalesce(1).write.mode("append").parquet(seen)
        met = flows.meet(flows.arriving(spark, sent, scored.schema), flows.arriving(spark, seen, actual.schema), ["entity", "ts"], "ts", "1 day")
        flows.add_errors(met, out, checkpoint).awaitTermination()
    want = {r.entity: (r.error, r.n) for r in scores.entity_errors(scored.join(actual, ["entity", "ts"])).collect()}
    got = {r.entity: (r.error, r.n) for r in flows.errors_so_far(spark, out).collect()}
    assert got.keys() == want.keys() and all(abs(got[e][0] - want[e][0]) < 1e-12 and got[e][1] == want[e][1] for e in want)
