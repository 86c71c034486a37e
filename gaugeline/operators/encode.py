"""Category codes and scaling as tables and expressions that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators.lookup import attach
from gaugeline.session import materialize

UNSEEN = -1


def string_columns(df: DataFrame, among=None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (among is None or f.name in among)]


def fit_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code, n)``: position of each distinct value in sorted order, and its row count.

    Values are range-partitioned and numbered inside each range; ranges are numbered by their sizes. The ranges
    are written out before they are counted (this runs a job), so that a recomputed task cannot draw them
    differently. No task sees more than one range.
    """
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = values.repartitionByRange(slots, "value").withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "codes")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))  # one row per range
    w = Window.partitionBy(F.lit(0)).orderBy("_range")
    offsets = sizes.select("_range", (F.sum("_size").over(w) - F.col("_size")).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("value")) - 1
    return ranged.join(F.broadcast(offsets), "_range").select("value", (F.col("_offset") + inside).alias("code"), "n")


def apply_codes(df: DataFrame, column: str, codes: DataFrame, alias: str, spread_on: list[str], fitted_on: bool = False) -> DataFrame:
    """Adds the code of ``column``; a value not in the table (or null) gets -1. ``fitted_on``: the codes were fitted on these very rows."""
    table = codes.select(F.col("value").alias(column), F.col("code").alias("_code"), "n")
    found = attach(df, table, column, "n", spread_on, other_rows=not fitted_on)
    return found.withColumn(alias, F.coalesce(F.col("_code"), F.lit(UNSEEN)).cast("bigint")).drop("_code")


def encode_strings(df: DataFrame, columns: list[str], fitted: dict[str, DataFrame], spread_on: list[str], fitted_on: bool = False) -> DataFrame:
    """Replace each string column by its code; other columns pass through."""
    for c in columns:
        coded = apply_codes(df, c, fitted[c], "_new", spread_on, fitted_on)
        df = coded.select([F.col("_new").alias(c) if x == c else F.col(x) for x in df.columns])
    return df


def fit_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column (1 where the column is constant)."""
    aggs = []
    for c in columns:
        spread = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}__mean"), F.when(spread > 0, spread).otherwise(1.0).alias(f"{c}__std")]
    return df.agg(*aggs)


def apply_scale(df: DataFrame, columns: list[str], scale: DataFrame) -> DataFrame:
    return df.withColumns({
        c: (F.col(c) - scale.select(f"{c}__mean").scalar()) / scale.select(f"{c}__std").scalar() for c in columns
    })
