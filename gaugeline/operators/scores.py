"""Errors per entity and overall, counts, and checks on targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import errors

SUSPICIOUS = 0.99


def entity_errors(pred: DataFrame, entity: str = "entity", predict: str = "predict", actual: str = "actual") -> DataFrame:
    return pred.groupBy(entity).agg(errors.aae(predict, actual).alias("error"), F.count("*").alias("n"))


def flag_suspicious(scored: DataFrame, limit: float = SUSPICIOUS) -> DataFrame:
    return scored.withColumn("suspicious", F.coalesce(F.col("error") >= limit, F.lit(False)))


def overall_error(scored: DataFrame) -> DataFrame:
    """One row: row-weighted mean of the known entity errors, and how many entities look suspicious."""
    known = F.col("error").isNotNull()
    return flag_suspicious(scored).agg(
        F.try_divide(F.sum(F.when(known, F.col("n") * F.col("error"))), F.sum(F.when(known, F.col("n")))).alias("overall_error"),
        F.count_if(known).alias("entities"),
        F.count_if("suspicious").alias("suspicious"),
    )


def top_entities(df: DataFrame, entity: str, n: int = 40, exclude: tuple = ()) -> DataFrame:
    """The ``n`` entities with the most rows, ties by name; ``n`` is the size of the report."""
    rows = df.filter(F.col(entity).isNotNull())
    if exclude:
        rows = rows.filter(~F.col(entity).isin(*exclude))
    return rows.groupBy(entity).agg(F.count("*").alias("n")).orderBy(F.desc("n"), entity).limit(n)


def entity_names(df: DataFrame, entity: str, name: str) -> DataFrame:
    """The distinct names of each entity, a row each; an entity may have any number of them."""
    return df.select(entity, name).filter(F.col(name).isNotNull()).distinct()


def joined_names(df: DataFrame, entity: str, name: str, alias: str = "names") -> DataFrame:
    """All distinct names of an entity in one string, in sorted order: a view of ``entity_names`` for entities with few names."""
    pairs = entity_names(df, entity, name)
    return pairs.groupBy(entity).agg(F.array_join(F.array_sort(F.collect_list(name)), "").alias(alias))


def has_two_values(target: str | Column) -> Column:
    """At least two distinct non-null values, without keeping any set of values."""
    return F.coalesce(F.min(target) < F.max(target), F.lit(False))


def valid_targets(df: DataFrame, entity: str, target: str) -> DataFrame:
    return df.groupBy(entity).agg(has_two_values(target).alias("valid"))


def valid_targets_strict(df: DataFrame, entity: str, target: str) -> DataFrame:
    """At least two values that each occur more than once."""
    per_value = df.groupBy(entity, target).agg(F.count(target).alias("n"))
    return per_value.groupBy(entity).agg((F.count_if(F.col("n") > 1) >= 2).alias("valid"))


def run_statistics(df: DataFrame, entity: str, ts: str, by: str | None = None) -> DataFrame:
    """Rows, entities and time bounds, overall or per ``by``."""
    # One row per (group, entity) first, so that counting entities needs no set of them.
    keys = ([by] if by else []) + [entity]
    small = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    grouped = small.groupBy(by) if by else small.groupBy()
    return grouped.agg(
        F.sum("n").alias("rows"), F.count(entity).alias("entities"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts")
    )
