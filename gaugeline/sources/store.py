"""Append-only stores with first-wins merging, prediction records, ledgers of finished work.

"Existing rows win" means that a merge never changes what is stored. It is an append of the new rows whose key
is not there yet, touching only the periods the new rows fall into. A merge that died half-way is repaired by
running it again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions import timecols
from gaugeline.operators import clean
from gaugeline.session import materialize

PERIOD = "period"
DELIVERY = "_delivery"


def read_or_none(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been written yet. With a schema, no file is read to find one."""
    reader = spark.read.format(fmt)
    try:
        return (reader if schema is None else reader.schema(schema)).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# --- finished work ----------------------------------------------------------------------------------------


def pending(work: DataFrame, ledger_path: str, keys: list[str]) -> DataFrame:
    """Work items whose keys are not in the ledger yet."""
    done = read_or_none(work.sparkSession, ledger_path)
    return work if done is None else work.join(done.select(*keys).distinct(), keys, "left_anti").select(work.columns)


def finished(spark: SparkSession, ledger_path: str, schema: T.StructType) -> DataFrame:
    """All rows of the outputs the ledger names; outputs cut off half-way are not among them."""
    done = read_or_none(spark, ledger_path)
    paths = [r["path"] for r in done.select("path").distinct().collect()] if done is not None else []
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(paths))


DAY = "_day"


def write_by_day(df: DataFrame, ts: str, out: str) -> DataFrame:
    """``df`` written once below ``out``, one folder per day, read back with the day as column ``_day``."""
    return _write_once(df.withColumn(DAY, F.to_date(ts)), DAY, ts, out)


def _write_once(df: DataFrame, by: str, ts: str, out: str) -> DataFrame:
    """A later call with the same ``out`` reads what the first one finished. Rows are split by ranges of the folder
    column and time, so a heavy folder holds several files."""
    spark = df.sparkSession
    done = read_or_none(spark, f"{out}/written")
    if done is None:
        path = f"{out}/rows-{uuid.uuid4().hex}"
        slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(slots, by, ts).write.partitionBy(by).parquet(path)
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("append").parquet(f"{out}/written")
        done = read_or_none(spark, f"{out}/written")
    return spark.read.schema(df.schema).parquet(done.agg(F.min("path")).first()[0])


LEDGER = "variation string, overall_error double"


def append_ledger(result: DataFrame, path: str) -> None:
    result.coalesce(1).write.mode("append").option("header", True).csv(path)


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# --- one output per entity --------------------------------------------------------------------------------


def break_out(df: DataFrame, entity: str, ts: str, path: str, first_n: int | None = None, fmt: str = "csv", buckets: int | None = None):
    """One folder per entity (or per hash bucket of entities, for very many), rows in time order.

    Rows are split by ranges of (entity, time): a dense entity becomes several consecutive files.
    """
    rows = clean.cap_entities(df, entity, first_n)
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = entity
    if buckets is not None:
        by = "bucket"
        rows = rows.withColumn(by, F.pmod(F.xxhash64(entity), F.lit(buckets)))
    rows = rows.repartitionByRange(slots, by, entity, ts).sortWithinPartitions(by, entity, ts)
    writer = rows.withColumn(f"_{by}", F.col(by)).write.partitionBy(f"_{by}")
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    writer.format(fmt).save(path)


def read_broken_out(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path).select(*schema.names)


# --- entity store -----------------------------------------------------------------------------------------


def merge(
    new: DataFrame, path: str, entity: str, ts: str, order: list[str], skip_existing: bool = False, delivery: str | Column | None = None,
) -> None:
    """Add new rows to the store at ``path``; the first row per (entity, ts) wins, stored rows before new ones
    and new ones by ``order``.

    With ``skip_existing`` an entity belongs to the delivery that first brought it: rows of any other delivery are left out. ``delivery``
    names the rows' delivery, a column where a call brings several; without a name a call is a delivery of its own. Finished (entity,
    delivery) pairs stand in a ledger that is written after the rows, so a delivery may come in several calls, and one that died half-way
    is completed by the next call.
    """
    spark = new.sparkSession
    named = F.lit(uuid.uuid4().hex if delivery is None else delivery) if not isinstance(delivery, Column) else delivery
    rows = new.filter(F.col(ts).isNotNull()).withColumn(DELIVERY, named.cast("string"))
    owners = read_or_none(spark, f"{path}.entities")
    if skip_existing:
        rows = materialize(rows, "merge")
        here = rows.groupBy(F.col(entity).alias("_e")).agg(F.min(DELIVERY).alias("_here"))
        if owners is not None:
            # Two deliveries can have brought an entity in calls without skip_existing; the first by name owns it.
            known = owners.groupBy(F.col("entity").alias("_k")).agg(F.min("delivery").alias("_known"))
            here = here.join(known, F.col("_e").eqNullSafe(F.col("_k")), "left").select("_e", F.coalesce("_known", "_here").alias("_here"))
        rows = rows.join(here, rows[entity].eqNullSafe(F.col("_e")) & (F.col(DELIVERY) == F.col("_here")), "left_semi")
    rows = clean.first_wins(rows, [entity, ts], order).withColumn(PERIOD, F.date_format(ts, "yyyy-MM"))
    rows = materialize(rows, "merge")  # so that months and ledger do not compute the delivery once more
    pairs = rows.select(F.col(entity).alias("entity"), F.col(DELIVERY).alias("delivery")).distinct()
    stored = read_or_none(spark, path)
    add = rows.drop(DELIVERY)
    if stored is not None:
        touched = [r[0] for r in rows.select(PERIOD).distinct().collect()]  # months, a short list
        keys = stored.filter(F.col(PERIOD).cast("string").isin(touched)).select(F.col(entity).alias("_e"), F.col(ts).alias("_t"))
        # A null entity is an entity like others, here as in the de-duplication above.
        add = add.join(keys, add[entity].eqNullSafe(F.col("_e")) & (add[ts] == F.col("_t")), "left_anti")
    # Hash by (entity, day) keeps files few and a dense entity spread.
    add.repartition(PERIOD, entity, F.to_date(ts)).write.mode("append").partitionBy(PERIOD).parquet(path)
    if owners is not None:
        both = owners.select(F.col("entity").alias("_k"), F.col("delivery").alias("_d"))
        pairs = pairs.join(both, pairs["entity"].eqNullSafe(F.col("_k")) & (pairs["delivery"] == F.col("_d")), "left_anti")
    if not pairs.isEmpty():
        pairs.write.mode("append").parquet(f"{path}.entities")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PERIOD)


def merged_view(stored: DataFrame, new: DataFrame, entity: str, ts: str, order: list[str]) -> DataFrame:
    """What the store would hold after a merge, as one lazy table."""
    both = stored.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    return clean.first_wins(both, [entity, ts], ["_rank", *order]).drop("_rank")


# --- prediction records -----------------------------------------------------------------------------------


def records(pred: DataFrame, config: dict, entity: str = "entity", ts: str = "ts") -> DataFrame:
    """One JSON-ready record per entity and month (``period``).

    ``data`` is a JSON object text from epoch milliseconds to ``{entity column, predict, target}``. An entity's
    records together are its whole series; a single one stays small however long the series gets.
    """
    target, entity_name = config["target"], config.get("entity_column", "VM_ID")
    row = F.struct(
        F.col(entity).cast("string").alias(entity_name), F.col("predict").alias("predict"), F.col("actual").alias(target)
    )
    ms = F.call_function("div", timecols.to_micros(ts), F.lit(1000).cast("bigint"))
    rows = pred.select(
        F.col(entity).cast("string").alias("entity"),
        F.date_format(ts, "yyyy-MM").alias(PERIOD),
        F.struct(ms.alias("ms"), row.alias("row")).alias("item"),
    )
    rows = clean.first_wins(rows.withColumn("_ms", F.col("item.ms")), ["entity", PERIOD, "_ms"], ["item"])  # a moment once
    packed = rows.groupBy("entity", PERIOD).agg(F.array_sort(F.collect_list("item")).alias("items"))
    entries = F.transform("items", lambda i: F.struct(i["ms"].cast("string").alias("key"), i["row"].alias("value")))
    data = F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})
    return packed.select(
        "entity",
        F.array(*[F.lit(f) for f in config["features"]]).cast("array<string>").alias("features"),
        F.lit(target).alias("target"),
        F.lit(config["interval"]).alias("interval"),
        F.lit(config["train_days"]).cast("int").alias("train_days"),
        F.lit(config["predict_days"]).cast("int").alias("predict_days"),
        data.alias("data"),
        PERIOD,
    )


RECORD = (
    "entity string, features array<string>, target string, interval string, train_days int, predict_days int, "
    "data string, period string"
)


def write_predictions(pred: DataFrame, path: str, config: dict, entity: str = "entity", ts: str = "ts") -> None:
    """Merge a prediction frame into the JSON store; stored timestamps win over new ones."""
    spark = pred.sparkSession
    rows = pred.select(F.col(entity).cast("string").alias("entity"), F.col(ts).alias("ts"), "predict", "actual")
    # Records keep milliseconds, so that is what "the same moment" means; of two new rows the earlier one wins.
    rows = rows.withColumn("_us", timecols.to_micros("ts"))
    rows = rows.withColumn("ts", timecols.from_micros(timecols.floor_div(F.col("_us"), 1000) * 1000))
    rows = clean.first_wins(rows, ["entity", "ts"], ["_us", "predict", "actual"]).drop("_us")
    if read_or_none(spark, path, "json", RECORD) is not None:
        rows = materialize(rows, "predictions")
        touched = [r[0] for r in rows.select(F.date_format("ts", "yyyy-MM")).distinct().collect()]  # months, a short list
        stored = flatten(spark.read.schema(RECORD).json(path).filter(F.col(PERIOD).isin(touched)))
        stored = stored.select(F.col("entity").alias("_e"), F.col("ts").alias("_t"))
        rows = rows.join(stored, rows["entity"].eqNullSafe(F.col("_e")) & (rows["ts"] == F.col("_t")), "left_anti")
    records(rows, config).write.mode("append").partitionBy(PERIOD).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows ``(entity, features, target, interval, train_days, predict_days, ts, predict, actual)``."""
    return flatten(spark.read.schema(RECORD).json(path))


def flatten(stored: DataFrame) -> DataFrame:
    items = F.explode(F.from_json("data", "map<string,map<string,string>>"))
    rows = stored.select(*[c for c in stored.columns if c not in ("data", PERIOD)], items.alias("ms", "row"))
    value = F.col("row")
    return rows.select(
        "entity", "features", "target", "interval", "train_days", "predict_days",
        timecols.from_micros(F.col("ms").cast("bigint") * 1000).alias("ts"),
        value["predict"].cast("double").alias("predict"),
        F.element_at(value, F.col("target")).cast("double").alias("actual"),
    )
