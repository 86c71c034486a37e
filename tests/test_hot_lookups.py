"""Lookups of rows in which one key, known or not, holds almost all rows, with adaptive execution off."""

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import encode
from gaugeline.operators.lookup import attach
from gaugeline.session import scratch_dir
from gaugeline.streaming import flows

N = 40_000


@pytest.fixture
def plain_execution(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(spark, hot):
    """90 % of the rows have the key ``hot``, a few are null, the others have many keys."""
    key = F.when(F.col("id") % 10 > 0, F.lit(hot)).when(F.col("id") % 400 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 3000))
    return spark.range(N).select("id", key.alias("key"))


def codes(spark):
    """Fitted on other rows, in which no key is frequent."""
    return spark.range(3000).select(F.concat(F.lit("k"), "id").alias("value"), F.col("id").alias("code"), F.lit(7).cast("long").alias("n"))


def even(df):
    sizes = [r["count"] for r in df.groupBy(F.col("part")).count().collect()]
    return len(sizes) == 8 and max(sizes) <= 2 * N / 8


@pytest.mark.parametrize("hot", ["unseen", "k7"])
def test_batch(spark, plain_execution, hot):
    found = encode.apply_codes(rows(spark, hot), "key", codes(spark), "code", ["id"]).withColumn("part", F.spark_partition_id())
    got = found.cache()
    assert even(got) and got.count() == N
    want = F.when(F.col("key").isNull() | (F.col("key") == "unseen"), -1).otherwise(F.substring("key", 2, 9).cast("long"))
    assert got.where(F.col("code") != want).count() == 0
    got.unpersist()


@pytest.mark.parametrize("hot", ["unseen", "k7"])
def test_stream(spark, plain_execution, hot):
    inbox, out, checkpoint = (scratch_dir(spark, x) for x in ("inbox", "coded", "checkpoint"))
    rows(spark, hot).write.parquet(inbox)
    stream = flows.arriving(spark, inbox, rows(spark, hot).schema)
    coded = encode.apply_codes(stream, "key", codes(spark), "code", ["id"]).withColumn("part", F.spark_partition_id())
    coded.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert even(got) and got.count() == N
    want = F.when(F.col("key").isNull() | (F.col("key") == "unseen"), -1).otherwise(F.substring("key", 2, 9).cast("long"))
    assert got.where(F.col("code") != want).count() == 0


def test_no_rows_and_no_table(spark):
    empty = rows(spark, "x").limit(0)
    assert attach(empty, codes(spark).withColumnRenamed("value", "key"), "key", "n", ["id"], other_rows=True).collect() == []
    none = codes(spark).limit(0).withColumnRenamed("value", "key")
    for other in (True, False):
        got = attach(rows(spark, "x").limit(50), none, "key", "n", ["id"], other_rows=other).collect()
        assert len(got) == 50 and all(r.code is None for r in got)
