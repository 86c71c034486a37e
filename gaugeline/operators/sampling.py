"""Repeatable samples, splits and shuffles: order and chance come from md5 of key and seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.ordering import below, digest
from gaugeline.operators.clean import stripped

_PREFIX = 4  # hex digits, so at most 65,536 groups of keys


def sample_entities(df: DataFrame, entity: str, percent: float, seed: int = 42) -> DataFrame:
    """All rows of ``int(n * percent / 100)`` randomly drawn entities, the key spelled as it came.

    Entities are compared after trimming. The drawn ones are those with the smallest digests, so membership is
    a comparison of each row's digest with one cut value: the rows are neither joined nor shuffled. The cut is
    found from counts per digest prefix, then within the one prefix it falls into.
    """
    key = stripped(F.col(entity).cast("string"))
    df = df.filter(F.col(entity).isNotNull())
    digests = df.select(digest(key, seed).alias("_d")).distinct()
    digests = digests.withColumn("_p", F.substring("_d", 1, _PREFIX))
    counts = digests.groupBy("_p").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_p")  # at most 16 ** _PREFIX rows
    counts = counts.select(
        "_p", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_upto"),
        F.floor(F.sum("_n").over(Window.partitionBy(F.lit(0))) * F.lit(float(percent)) / 100).alias("_keep"),
    )
    edge = counts.filter("_before < _keep AND _upto >= _keep").select("_p", (F.col("_keep") - F.col("_before")).alias("_k"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_d"))
    cut = digests.join(F.broadcast(edge), "_p").withColumn("_r", rank).filter("_r = _k").agg(F.max("_d"))
    return df.filter(digest(key, seed) <= cut.scalar())


def random_split(df: DataFrame, key: str, fraction: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    inside = below(key, seed, fraction)
    return df.filter(inside), df.filter(~inside)


def subsample_keeping(df: DataFrame, flag, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Random fraction of the rows, plus every row for which ``flag`` holds."""
    return df.filter(flag | below(key, seed, fraction))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(digest(key, seed), key)
