"""A score of each text beside all columns of its row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeline.llm import bytesops as B


def with_score(df: DataFrame, text_col: str, name: str, score: Callable[[B.Block], np.ndarray]) -> DataFrame:
    """All columns of ``df`` and a double column ``name``; the caller picks a name that is not taken."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            parts = [score(block) for block in B.blocks(batch.column(at))]
            column = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
