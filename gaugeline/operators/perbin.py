"""A user's own aggregate per bin: any Python function of the bin's values in time order, beside the built-in ones.

Rows of a bin come to one task sorted, and bins follow one another in Arrow batches, so a task holds one batch and one bin, not all bins of
an entity. The input lies on a grid, which bounds a bin by its length over the grid's step.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions import durations, timecols

# Send the functions themselves to the workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BinFunction = Callable[[np.ndarray], float]


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before it; null and NaN are values like others."""
    differs = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        codes = pc.dictionary_encode(table[k].combine_chunks()).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        differs |= codes[1:] != codes[:-1]
    return np.concatenate(([True], differs)) if table.num_rows else differs


def _result(fn: BinFunction, values: np.ndarray) -> float | None:
    out = fn(values)
    return None if out is None or np.isnan(out) else float(out)


def per_group(df: DataFrame, keys: list[str], order: str, columns: list[str], functions: dict[str, BinFunction]) -> DataFrame:
    """``keys`` and, for each function, a struct of its results over ``columns``; one row per distinct key. One shuffle by the keys.

    A function gets the values as doubles in the order of ``order``, NaN where unknown, never an empty array; None and NaN become null.
    """
    rows = df.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in columns]).repartition(*keys).sortWithinPartitions(*keys, order)
    inner = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    shape = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(n, inner) for n in functions]])

    def results(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        values = [table[c].to_numpy().astype(float) for c in columns]
        heads = table.select(keys).take(pa.array(starts)).combine_chunks()
        made = [heads[k].combine_chunks() for k in keys]
        for fn in functions.values():
            made.append(pa.StructArray.from_arrays([pa.array([_result(fn, v[a:b]) for a, b in zip(starts, ends)], pa.float64()) for v in values], columns))
        return pa.RecordBatch.from_arrays([m.chunk(0) if isinstance(m, pa.ChunkedArray) else m for m in made], [*keys, *functions])

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch])
            table = here if left is None else pa.concat_tables([left, here])
            starts = np.flatnonzero(_changes(table, keys))
            if len(starts) > 1:  # the last group may go on in the next batch
                yield results(table, starts[:-1], starts[1:])
            left = table.slice(starts[-1])
        if left is not None:
            yield results(left, np.array([0]), np.array([left.num_rows]))

    return rows.mapInArrow(run, shape)


def rebin(gridded: DataFrame, entity: str, ts: str, step, columns: list[str], functions: dict[str, BinFunction]) -> DataFrame:
    """``(entity, ts, <function>_<column>...)``: a grid's rows put into bins of ``step`` from midnight, gap-free from an entity's first to its last bin.

    ``step`` divides a day or is a number of whole days, counted from the day 1970-01-01. Bins without rows are null. Null entities
    and times are left out, as they are by the grid.
    """
    size = durations.micros(step)
    bin_ = timecols.floor_div(timecols.to_micros(ts), size)
    rows = gridded.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull()).withColumn("_bin", bin_)
    found = per_group(rows, [entity, "_bin"], ts, columns, functions)
    following = F.lead("_bin").over(Window.partitionBy(entity).orderBy("_bin"))
    spread = found.withColumn("_to", F.coalesce(following - 1, F.col("_bin"))).withColumn("_at", F.explode(F.sequence("_bin", "_to")))
    own = F.col("_at") == F.col("_bin")
    made = [F.when(own, F.col(n)[c]).alias(f"{n}_{c}") for n in functions for c in columns]
    return spread.select(entity, timecols.from_micros(F.col("_at") * size).alias(ts), *made)
