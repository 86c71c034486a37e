"""Vector columns as arrays, classes of equal vectors, and k-means, for the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import materialize

SAMPLE = 20_000  # vectors used to place centroids, at most
PART = 512  # of them that are compared with all centroids at once
SINGLE, DOUBLE = "<f4", "<f8"  # kinds of components


def _packed(kind: str):
    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            data = np.asarray(column.values.to_numpy(zero_copy_only=False), kind)  # null components become NaN
            at = column.offsets.to_numpy()
            bad, some = (np.concatenate(([0], np.cumsum(x))) for x in (~np.isfinite(data), data != 0))
            good = ~column.is_null().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            data, size = data.tobytes(), np.dtype(kind).itemsize
            out = [data[low:high] if ok else None for low, high, ok in zip((at[:-1] * size).tolist(), (at[1:] * size).tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vector"])

    return run


def packed(df: DataFrame, id_col: str, vector_col: str, kind: str = DOUBLE) -> DataFrame:
    """``id, vector``: the components as little-endian numbers of a kind that holds them all; null for vectors that are null, empty, zero, or hold null or non-finite components."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>" if kind == DOUBLE else "array<float>").alias("vector"))
    return rows.mapInArrow(_packed(kind), f"id {rows.schema['id'].dataType.simpleString()}, vector binary")


def kind_of(df: DataFrame, vector_col: str) -> str:
    """The smaller of the two kinds that holds the column's components as they are."""
    return SINGLE if df.select(f"`{vector_col}`").schema[0].dataType.simpleString() == "array<float>" else DOUBLE


def matrix(column, kind: str = DOUBLE) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype("<f8", copy=False)


def sample(classes: DataFrame, limit: int = SAMPLE, kind: str = DOUBLE, n: int = 0) -> dict[int, np.ndarray]:
    """At most ``limit`` vectors, by number of components. ``n``: of so many; few others than the sample's are then sorted."""
    order = F.xxhash64("vector")
    if n > 4 * limit:  # far more than limit hashes are as low
        classes = classes.where(order <= F.lit(-(2**63) + 2 * limit * 2**64 // n))
    rows = classes.orderBy(order, "vector").limit(limit).select("vector").toArrow()["vector"].to_pylist()
    by: dict[int, list] = {}
    for v in rows:
        by.setdefault(len(v) // np.dtype(kind).itemsize, []).append(v)
    return {dim: matrix(v, kind) for dim, v in by.items()}


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / np.where(big > 0, big, 1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids at most, of unit vectors: assignment by cosine, centroids by the normalised mean."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(x[part : part + PART] @ centre.T).argmax(1) for part in range(0, len(x), PART)])
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        empty = np.bincount(home, minlength=k) == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centre = unit(total)
    return centre


def classes_of(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector: ``node, vector, first, copies``; ``node`` is a 64-bit hash of the vector. Written to the shared folder."""
    some = vectors.where("vector is not null")
    return materialize(some.groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("vector")), "classes")
