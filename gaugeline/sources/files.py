"""Delimited text in and out, and quick looks at tables."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators import clean

# Columns of the raw usage layout after cleaning.
METRICS = [
    "cpu_usage", "cpu_usagemhz", "mem_active", "mem_consumed", "mem_granted", "mem_usage",
    "net_received", "net_transmitted", "net_usage",
]

SOURCE = "source"


def read_csv(spark: SparkSession, paths, sep: str = ",", schema: T.StructType | str | None = None, infer: bool = False, line_breaks: bool = False):
    """Delimited files of one layout with a header row; ``.gz`` is read as such.

    Columns are text unless a schema is given or ``infer`` asks for a pass over the data. A quote inside a quoted value is
    doubled. ``line_breaks`` reads quoted values that hold line breaks; then, as with gzip, a file is one task whatever its
    size: repartition after reading a few large ones.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", line_breaks)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)
    return reader.csv(paths)


def _first_line(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def layouts(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The files below ``paths`` (files, folders, globs) by their first line; empty files are left out.

    One job, in which a task reads only the beginning of its file. The names of the files come to the driver, as any reader needs them there.
    """
    own = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(key, str(1 << 40))  # a file is not split, and no two share a task
    lines = own.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    first = lines.mapInArrow(_first_line, "file string, value string")
    found = first.groupBy("value").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    return {r["value"]: r["files"] for r in sorted(found, key=lambda r: r["files"])}


def _as_written(path: str) -> str:
    """The path as it is named, from its form as an address; what a reader would take for a glob is escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(path))


def append_files(
    spark: SparkSession, paths: list[str], sep: str = ",", infer: bool = False, with_source: bool = False, line_breaks: bool = False
) -> DataFrame:
    """All files below ``paths`` as one table, aligned by cleaned column name; columns a file lacks are null.

    Every file's own header counts, also where a folder or glob holds several layouts. Files with the same header line
    are read together, so the plan grows with the number of layouts and not with the number of files. ``with_source`` keeps
    the file's path as a column. Runs a job.
    """
    groups = [[_as_written(f) for f in group] for group in layouts(spark, paths).values()] or [paths]
    result = None
    for group in groups:
        table = read_csv(spark, group, sep, infer=infer, line_breaks=line_breaks)
        names = table.columns
        if with_source:
            table = table.select("*", F.col("_metadata.file_path").alias(SOURCE))
            table = clean.squeeze_names(table.select(*map(clean._q, names), SOURCE))
        else:
            table = clean.squeeze_names(table)
        result = table if result is None else result.unionByName(table, allowMissingColumns=True)
    return result


def read_usage(spark: SparkSession, paths: list[str], metrics=None, mode: str = "null_bad", with_source: bool = False):
    """Raw usage files, cleaned: names, trimmed text, numbers, NaN as null."""
    table = clean.trim_strings(append_files(spark, paths, with_source=with_source))
    return clean.nan_to_null(clean.to_numbers(table, METRICS if metrics is None else metrics, mode))


def concat_same_layout(tables: list[DataFrame]) -> DataFrame:
    """Stack tables whose column names and types are equal; anything else is an error."""
    first = [(f.name, f.dataType) for f in tables[0].schema.fields]
    for t in tables[1:]:
        if [(f.name, f.dataType) for f in t.schema.fields] != first:
            raise ValueError(f"layouts differ: {tables[0].schema.simpleString()} / {t.schema.simpleString()}")
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result


def read_labelled(spark: SparkSession, paths) -> DataFrame:
    """Tab-separated ``label, message`` lines without header; lines with another field count are skipped."""
    schema = "label string, message string, _bad string"
    reader = spark.read.schema(schema).option("sep", "\t").option("mode", "PERMISSIVE").option("quote", "")
    rows = reader.option("columnNameOfCorruptRecord", "_bad").csv(paths)
    return rows.filter("_bad IS NULL").drop("_bad")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header and rows; a path that ends in ``.gz`` is compressed. Timestamps keep their microseconds."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if path.rstrip("/").endswith(".gz"):
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def runs(paths: list[str], max_files: int | None = None, joined: bool = False, shuffle_seed: int | None = None) -> list[list[str]]:
    """Which files form one run: all together, or each on its own; at most ``max_files`` of them."""
    if shuffle_seed is not None:
        import hashlib

        paths = sorted(paths, key=lambda p: (hashlib.md5(f"{p}:{shuffle_seed}".encode()).hexdigest(), p))
    chosen = paths[:max_files]
    return [chosen] if joined else [[p] for p in chosen]


# --- quick looks ------------------------------------------------------------------------------------------


def head(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).cast("bigint").alias("cols"))


def column_names(df: DataFrame) -> DataFrame:
    names = [(i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(names, "position bigint, name string")
