"""Streams over arriving files. Each returns a started query; ``once=True`` drains what is there and stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeline.functions import durations, errors, timecols
from gaugeline.operators import clean
from gaugeline.plans.forecast import Forecaster
from gaugeline.session import materialize
from gaugeline.sources import store


def arriving(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None, **options):
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score(rows: DataFrame, model: Forecaster, keys: list[str], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Score arriving feature rows with a saved model; ``keys`` come along so that actuals can be joined later."""
    inputs = model.contract.names
    named = clean.squeeze_names(rows)
    typed = named.select(*keys, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in model.contract.fields if f.name not in keys])
    scored = model.transform(typed.select(*dict.fromkeys([*keys, *inputs]))).select(*keys, "predict")
    return _start(scored.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint, once)


def ingest(rows: DataFrame, path: str, entity: str, ts: str, order: list[str], checkpoint: str, skip_existing: bool = False,
           once: bool = True, delivery: str | Column | None = None) -> StreamingQuery:
    """Merge arriving samples into the entity store, first row per (entity, ts) wins, exactly.

    A batch that is replayed after a failure finds its rows stored and adds nothing. All batches of a stream are one delivery unless
    ``delivery`` names others, for instance by a column of the file's folder.
    """
    named = checkpoint if delivery is None else delivery

    def add(batch: DataFrame, _id: int) -> None:
        store.merge(batch, path, entity, ts, order, skip_existing, named)

    return _start(rows.writeStream.foreachBatch(add), checkpoint, once)


def first_within(rows: DataFrame, entity: str, ts: str, delay: str) -> DataFrame:
    """Duplicate removal with bounded state: rows later than ``delay`` are dropped, unlike in ``ingest``."""
    stamped = rows.withColumn("_event", F.col(ts).cast("timestamp"))
    return stamped.withWatermark("_event", delay).dropDuplicatesWithinWatermark([entity, ts]).drop("_event")


def first_or_late(rows: DataFrame, entity: str, ts: str, order: list[str], delay: str, out: str, late: str, checkpoint: str,
                  once: bool = True) -> StreamingQuery:
    """Keep in ``out`` the first row per (entity, ts), by ``order`` within a batch, and in ``late`` every row that came too late to tell.

    A row is late when its time is before the watermark: the latest time seen in earlier batches less ``delay``. What it might repeat
    need not be remembered, so a batch is compared only with stored batches that reach beyond the watermark, which a ledger of one line
    per batch names. Late rows, and rows without a time, are neither taken nor lost. A repeated batch replaces its own folders.
    """
    back = durations.micros(delay)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here = materialize(batch.withColumn("_us", timecols.to_micros(ts)), "batch")
        known = store.read_or_none(spark, f"{out}.ledger", schema="latest long, reach long, batch long")
        lines = [] if known is None else known.filter(F.col("batch") < number).collect()  # one line per batch
        latest = max([r["latest"] for r in lines if r["latest"] is not None], default=None)
        mark = None if latest is None else latest - back
        in_time = F.col("_us").isNotNull() & (F.lit(True) if mark is None else F.col("_us") >= mark)
        here.filter(~in_time).drop("_us").write.mode("overwrite").parquet(f"{late}/batch={number}")
        fresh = clean.first_wins(here.filter(in_time), [entity, ts], order)
        near = [f"{out}/batch={r['batch']}" for r in lines if r["reach"] is not None and (mark is None or r["reach"] >= mark)]
        if near:
            stored = spark.read.schema(rows.schema).parquet(*near).select(F.col(entity).alias("_e"), F.col(ts).alias("_t"))
            stored = stored if mark is None else stored.filter(timecols.to_micros("_t") >= mark)
            fresh = fresh.join(stored, fresh[entity].eqNullSafe(F.col("_e")) & (fresh[ts] == F.col("_t")), "left_anti")
        fresh.drop("_us").write.mode("overwrite").parquet(f"{out}/batch={number}")
        written = spark.read.schema(rows.schema).parquet(f"{out}/batch={number}").agg(F.max(timecols.to_micros(ts))).first()[0]
        seen = here.agg(F.max("_us")).first()[0]
        line = spark.createDataFrame([(seen, written)], "latest long, reach long")
        line.coalesce(1).write.mode("overwrite").parquet(f"{out}.ledger/batch={number}")

    return _start(rows.writeStream.foreachBatch(add), checkpoint, once)


def meet(scored: DataFrame, actual: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Scores and the values that later arrive for the same keys, both streams; either side waits for the other until ``delay`` has passed."""
    left = scored.withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", delay)
    right = actual.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in actual.columns if c not in keys])
    right = right.withColumn("_met", F.col(f"_{ts}").cast("timestamp")).withWatermark("_met", delay)
    same = F.col("_event") == F.col("_met")
    for k in keys:
        if k != ts:
            same = same & (F.col(k) == F.col(f"_{k}"))
    return left.join(right, same).select(*scored.columns, *[c for c in actual.columns if c not in keys])


def add_errors(met: DataFrame, out: str, checkpoint: str, entity: str = "entity", once: bool = True) -> StreamingQuery:
    """Keep the running error per entity: one small table per batch, which a repeated batch replaces. ``errors_so_far`` reads them."""

    def add(batch: DataFrame, number: int) -> None:
        ratio = errors.ratio()
        sums = batch.groupBy(entity).agg(F.sum(ratio).alias("ratios"), F.count(ratio).alias("known"), F.count("*").alias("n"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(met.writeStream.foreachBatch(add), checkpoint, once)


def errors_so_far(spark: SparkSession, out: str, entity: str = "entity") -> DataFrame:
    """``(entity, error, n)`` over all batches so far: what ``scores.entity_errors`` gives for their rows."""
    sums = spark.read.parquet(out).groupBy(entity).agg(F.sum("ratios").alias("ratios"), F.sum("known").alias("known"), F.sum("n").alias("n"))
    return sums.select(entity, F.try_divide("ratios", F.col("known")).alias("error"), "n")


def keep_predictions(pred: DataFrame, path: str, config: dict, checkpoint: str, entity: str = "entity", ts: str = "ts",
                     once: bool = True) -> StreamingQuery:
    """Merge arriving prediction frames into the JSON store; stored timestamps win."""

    def add(batch: DataFrame, _id: int) -> None:
        store.write_predictions(batch, path, config, entity, ts)

    return _start(pred.writeStream.foreachBatch(add), checkpoint, once)
