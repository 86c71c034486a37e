"""Attach columns of a keyed table to a large one without letting a hot key sit in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with at least this share of all rows is "hot". At most 1 / HOT_SHARE keys can be hot, so the
# broadcast side has at most 10,000 rows whatever the size of the data.
HOT_SHARE = 1e-4
TRACKED = 1 << 17  # counters of the sketch that finds hot keys among rows the weights do not speak of
SPREAD = 4096
COPIES = 64  # of each row of the table in a stream, where no pass over the rows can name hot keys beforehand


def attach(left: DataFrame, table: DataFrame, on: str, weight: str, spread_on: list[str], other_rows: bool = False) -> DataFrame:
    """Left join ``table`` (unique in ``on``) onto ``left``; ``weight`` = rows per key, of ``left`` or, with ``other_rows``, of other rows.

    Hot keys are looked up in a broadcast of bounded size. All other keys go through an ordinary join; rows that already
    found their hot key, and rows with a null key, are spread over it by a salt which matches nothing. Key and salt are
    one struct: as two columns the optimizer would turn the constant salt of the table into a filter and shuffle by the key
    alone.

    Weights name the hot keys. Where they are of other rows, a sketch over the keys of ``left`` names them (one more pass over that
    column), whether the table holds them or not. A stream takes hot keys from the weights, and spreads the rows of all others over
    ``COPIES`` copies of the table's row.
    """
    values = [c for c in table.columns if c not in (on, weight)]
    pack = F.struct(*values)
    if other_rows and not left.isStreaming:
        keys = left.agg(F.expr(f"approx_top_k(`{on}`, {round(1 / HOT_SHARE)}, {TRACKED})").alias("top"), F.count("*").alias("_all"))
        heavy = keys.select("_all", F.explode("top").alias("t")).where(F.col("t.count") >= HOT_SHARE * F.col("_all")).select(F.col("t.item").alias(on))
        there = table.join(F.broadcast(heavy), on, "left_semi").select(on, pack.alias("_hot_found"))
        hot = heavy.join(F.broadcast(there), on, "left")
        cold = table
    else:
        total = table.agg(F.sum(weight)).scalar()
        ranked = table.withColumn("_hot", F.col(weight) >= F.lit(HOT_SHARE) * total)
        hot = ranked.filter("_hot").select(on, pack.alias("_hot_found"))
        cold = ranked.filter("NOT _hot")
    copies = COPIES if left.isStreaming else 1
    cold = cold.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies > 1 else cold.withColumn("_s", F.lit(0))
    cold = cold.select(F.struct(F.col(on).alias("k"), F.col("_s").alias("s")).alias("_key"), pack.alias("_cold_found"))
    spread = F.xxhash64(*spread_on)
    settled = F.col("_is_hot") | F.col(on).isNull()
    salt = F.when(settled, copies + F.pmod(spread, F.lit(SPREAD)).cast("int")).otherwise(F.pmod(spread, F.lit(copies)).cast("int"))
    return (
        left.join(F.broadcast(hot.withColumn("_is", F.lit(True))), on, "left")
        .withColumn("_is_hot", F.coalesce("_is", F.lit(False)))
        .withColumn("_key", F.struct(F.col(on).alias("k"), salt.alias("s")))
        .join(cold, "_key", "left")
        .withColumn("_found", F.coalesce("_hot_found", "_cold_found"))
        .select(*left.columns, *[F.col("_found")[c].alias(c) for c in values])
    )
