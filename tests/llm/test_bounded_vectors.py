"""What two vector operators hold at once, and how often a vector crosses."""

import tracemalloc

import numpy as np
import pandas as pd

from gaugeline.llm import embed_dedup
from gaugeline.llm import vectors as V


def _peak(fn) -> float:
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_the_driver_holds_parts_of_the_sample():
    """Before: all the sample's vectors with all centroids at once."""
    x = np.random.default_rng(1).normal(size=(8000, 64))
    assert _peak(lambda: embed_dedup.centroids(x, 1_000_000, 0.9)) < 80


def _sizes(least):
    def run(key, rows):
        n = np.array([len(rows)])
        return pd.DataFrame({"a": n, "b": n, "n": n})

    return run


def test_vectors_cross_few_times(spark, monkeypatch):
    """Vectors without structure are one cell; before, each crossed twice for every 1,024 vectors."""
    x = V.unit(np.random.default_rng(2).normal(size=(20000, 24)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    kept, real = [], embed_dedup.materialize
    monkeypatch.setattr(embed_dedup, "_compared", _sizes)
    monkeypatch.setattr(embed_dedup, "materialize", lambda d, label="cut": kept.append((label, real(d, label))) or kept[-1][1])
    embed_dedup.near_duplicates(df)
    groups = [r.a for label, made in kept if label == "links" for r in made.collect()]
    assert sum(groups) <= 20 * len(x) and max(groups) <= 2 * embed_dedup.BLOCK


def test_tiles_find_all_links(spark):
    x = V.unit(np.random.default_rng(3).normal(size=(3000, 24)))
    x[1500:1700] = V.unit(x[:200] + 0.01)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    for block in (None, 700):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, block=block).collect()}
        assert {k: n for k, (n, _) in got.items()} == dict(enumerate(near.sum(1).tolist())) and near.sum() >= 400
        assert all(got[i][1] == min(i, int(np.flatnonzero(near[i])[0])) for i in range(3000) if near[i].sum() == 1 and near[np.flatnonzero(near[i])[0]].sum() == 1)
