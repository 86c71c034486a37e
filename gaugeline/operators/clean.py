"""Column names, strings, numbers, dates; row filters; duplicates."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions import timecols
from gaugeline.functions.durations import canonical

# Text that is a number once thousands commas are gone; other spellings a cast would take (12d, 0x1p3) are none.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))$"


# --- names and values -------------------------------------------------------------------------------------


def squeeze_names(df: DataFrame) -> DataFrame:
    """Remove every space inside column names; two names that become equal are an error."""
    names = [canonical(c.replace(" ", "")) for c in df.columns]
    clashes = sorted(n for n, k in Counter(names).items() if k > 1)
    if clashes:
        raise ValueError(f"column names collide after removing spaces: {clashes}")
    return df.toDF(*names)


def stripped(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip white space from all string columns, or from the listed ones; others pass untouched."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    chosen = strings if columns is None else strings & set(columns)
    return df.select([stripped(F.col(_q(c))).alias(c) if c in chosen else F.col(_q(c)) for c in df.columns])


def number(c: str | Column) -> Column:
    """Text with thousands commas as DOUBLE, null when it is not a number."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.replace(stripped(c.cast("string")), F.lit(","), F.lit(""))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def to_numbers(df: DataFrame, columns: list[str], mode: str = "null_bad") -> DataFrame:
    """Parse number columns.

    ``null_bad``: unreadable values become null. ``strict``: they raise. ``keep_column``: a column holding any
    unreadable value stays as it was (this mode counts the failures first, which is one pass over the data).
    """
    if mode not in ("null_bad", "strict", "keep_column"):
        raise ValueError(f"unknown mode {mode!r}")
    present = [c for c in columns if c in df.columns]
    if mode == "keep_column" and present:
        bad = df.agg(*[F.count_if(number(c).isNull() & F.col(c).isNotNull()).alias(c) for c in present]).first()
        present = [c for c in present if bad[c] == 0]
    parsed = {c: number(c) for c in present}
    if mode == "strict":
        # A cast that fails names the value.
        bad = {c: F.concat(F.lit("not a number: "), F.col(_q(c)).cast("string")).cast("double") for c in present}
        parsed = {c: F.when(number(c).isNotNull() | F.col(_q(c)).isNull(), number(c)).otherwise(bad[c]) for c in present}
    return df.withColumns(parsed)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def parse_time(df: DataFrame, text: str, ts: str = "ts", pattern: str | None = None, strict: bool = False) -> DataFrame:
    """Turn a text date column into a zone-free timestamp ``ts`` and drop the text column."""
    if isinstance(df.schema[text].dataType, T.StringType):
        c = stripped(text)
        args = (c, F.lit(pattern)) if pattern else (c,)
        if strict:
            parsed = F.to_timestamp_ntz(*args)
        elif pattern:
            parsed = F.try_to_timestamp(*args).cast("timestamp_ntz")
        else:
            parsed = c.try_cast("timestamp_ntz")
    else:
        parsed = F.col(text).cast("timestamp_ntz")
    kept = [c for c in df.columns if c not in (text, ts)]
    return df.select(parsed.alias(ts), *kept)


# --- row filters ------------------------------------------------------------------------------------------


def keep_entities(df: DataFrame, entity: str, wanted) -> DataFrame:
    """Rows of the wanted entities: a list or a one-column table.

    Listed keys are read as the column's type; keys that cannot be, and null, match nothing.
    """
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(F.col(wanted.columns[0]).alias(entity)), entity, "left_semi").select(df.columns)
    keys = dict.fromkeys(str(w) for w in wanted if w is not None)
    table = df.sparkSession.createDataFrame([(k,) for k in keys], "k string")
    table = table.select(F.col("k").try_cast(df.schema[entity].dataType).alias(entity)).distinct()
    return df.join(table, entity, "left_semi").select(df.columns)


def one_entity(df: DataFrame, entity: str, value) -> DataFrame:
    return df.filter(F.col(entity) == F.lit(value))


def time_slice(df: DataFrame, ts: str, start, stop, closed: bool = False) -> DataFrame:
    """``[start, stop - 1 second]``, or ``[start, stop]`` when ``closed``."""
    start, stop = _ntz(start), _ntz(stop)
    end = stop if closed else timecols.shift(stop, -1)
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= end))


def cutoff_split(df: DataFrame, ts: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff (train) and rows from it on (test)."""
    return df.filter(F.col(ts) < _ntz(cutoff)), df.filter(F.col(ts) >= _ntz(cutoff))


def report_filter(df: DataFrame, entity: str, value, ts: str, first_day: str, last_day: str, metrics) -> DataFrame:
    """One entity between two days (both included), reduced to the chosen metrics."""
    day = F.to_date(ts)
    return one_entity(df, entity, value).filter(day.between(F.lit(first_day), F.lit(last_day))).select(entity, ts, *metrics)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def first_entities(df: DataFrame, entity: str, n: int | None = None) -> DataFrame:
    """Distinct entities in order, at most the first ``n``."""
    found = df.select(entity).filter(F.col(entity).isNotNull()).distinct().orderBy(entity)
    return found if n is None else found.limit(n)


def cap_entities(df: DataFrame, entity: str, n: int | None) -> DataFrame:
    """Only the rows of the first ``n`` entities; the planner chooses how the list is joined."""
    if n is None:
        return df
    chosen = first_entities(df, entity, n)
    return df.join(chosen, entity, "left_semi").select(df.columns)


def conform(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Exactly the contract's columns, in its order, with its types."""
    df = squeeze_names(df)
    missing = [f.name for f in contract.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns required by the model: {missing}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.fields])


# --- duplicates -------------------------------------------------------------------------------------------


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; an aggregate, so copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in df.columns])


def duplicate_counts(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows, kept rows and dropped duplicate rows per ``by``."""
    per_key = df.groupBy(*dict.fromkeys([by, *keys])).agg(F.count("*").alias("n"))
    return per_key.groupBy(by).agg(
        F.sum("n").alias("rows"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("dropped")
    )


def _ntz(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
