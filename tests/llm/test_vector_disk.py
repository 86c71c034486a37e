"""Near-duplicate vectors in rounds: the disk they take, and that no round, cell or tile loses a link."""

import os
import threading

import numpy as np
import pytest

from gaugeline import session
from gaugeline.llm import embed_dedup
from gaugeline.llm import vectors as V


def _wanted(x, least=0.9):
    """Links and smallest reachable index of every vector, by brute force."""
    u = V.unit(np.asarray(x, float))
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(near, root, len(x)).min(1, initial=len(x)))
        if (low == root).all():
            return {i: (int(n), int(r)) for i, (n, r) in enumerate(zip(near.sum(1), root))}
        root = low


def _got(df, **more):
    return {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, **more).collect()}


def _table(spark, x, kind="float"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")


def _size(*folders):
    total = 0
    for at, _, names in (x for folder in folders for x in os.walk(folder)):
        for name in names:
            try:
                total += os.path.getsize(os.path.join(at, name))
            except OSError:
                pass
    return total


def test_disk_does_not_grow_with_the_pairs(spark, monkeypatch, tmp_path):
    """4,000 vectors of 256 bytes, in 20 blocks; before, 40 copies of each, as doubles, lay in shuffle files at once."""
    monkeypatch.setattr(embed_dedup, "ROUND", 1, raising=False)
    x = V.unit(np.random.default_rng(4).normal(size=(4000, 64))).astype("f4")
    x[3900:] = x[:100] + 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    jvm = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders, most, done = [session.shared_root(spark).removeprefix("file:"), *jvm.localDirsString()], [0], threading.Event()
    before = _size(*folders)

    def watch():
        while not done.wait(0.05):
            most[0] = max(most[0], _size(*folders) - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = _got(df, block=200)
    finally:
        done.set()
        watcher.join()
    assert got == _wanted(x)
    assert 1e6 < most[0] < 12e6  # before: over 40e6


@pytest.mark.parametrize("moved", [1, 1 << 28])
def test_cells_and_rounds_find_all_links(spark, monkeypatch, moved):
    """Clusters wide enough that cells visit each other, and an outlying length."""
    monkeypatch.setattr(embed_dedup, "ROUND", moved)
    monkeypatch.setattr(embed_dedup, "CROSSING", 0)
    rng = np.random.default_rng(5)
    around = V.unit(rng.normal(size=(30, 16)))
    x = V.unit(around[rng.integers(0, 30, 2400)] + 0.11 * rng.normal(size=(2400, 16)))
    centre = embed_dedup.centroids(x, len(x), 0.9)
    _, there = embed_dedup.visits(x, centre, embed_dedup.gaps(centre), 0.9)
    assert len(centre) > 4 and there.sum() > 100
    short = [(10**6 + i, v) for i, v in enumerate(([1.0, 0.0], [1.0, 0.01], [0.0, 1.0]))]
    df = _table(spark, x, "double").union(spark.createDataFrame(short, "vec_id long, embedding array<double>"))
    want = _wanted(x)
    assert 1 < max(n for n, _ in want.values()) and len({r for _, r in want.values()}) > 30
    assert _got(df, block=150) == want | {10**6: (1, 10**6), 10**6 + 1: (1, 10**6), 10**6 + 2: (0, 10**6 + 2)}


def test_tiles_full_of_links(spark):
    """A large group of near copies, next to vectors without links, and a chain of which only neighbours are near."""
    rng = np.random.default_rng(6)
    x = V.unit(rng.normal(size=(2400, 40)))
    x[300:1500] = V.unit(x[0] + 0.02 * rng.normal(size=(1200, 40)))
    turn = np.arange(200)[:, None] * 0.3
    x[2000:2200] = np.cos(turn) * x[5] + np.sin(turn) * V.unit(x[6:7] - (x[6] @ x[5]) * x[5])
    for block in (None, 900):
        assert _got(_table(spark, x, "double"), block=block) == _wanted(x)


def test_single_and_double_precision_agree(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 12)).astype("f4")
    x[200:] = x[:100] * 3
    odd = [(1000, None), (1001, []), (1002, [0.0] * 12), (1003, [None] + [1.0] * 11), (1004, [float("nan")] + [1.0] * 11), (1005, [float("inf")] * 12), (None, x[0].tolist()), (7, x[0].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    got = []
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        assert V.kind_of(df, "embedding") == {"float": V.SINGLE, "double": V.DOUBLE}[kind]
        got.append(sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect() if r.vec_id is not None))
    assert got[0] == got[1] and len(got[0]) == 307 and [r for r in got[0] if r[1] == 0] == [(False, 0, 3, 0, True)]
    assert all(r[2:] == (0, r[1], True) for r in got[0] if r[1] >= 1000)


def test_stars_and_gaps():
    a, b = np.array([5, 4, 3, 9, 7]), np.array([4, 3, 2, 8, 7])
    assert embed_dedup.stars(a, b, 10).tolist() == [0, 1, 2, 2, 2, 2, 6, 7, 8, 8]
    centre = V.unit(np.random.default_rng(8).normal(size=(V.PART + 3, 5)))
    assert np.allclose(embed_dedup.gaps(centre), np.linalg.norm(centre[:, None] - centre[None], axis=2), atol=1e-7)


def test_scratch_is_released(spark):
    df = session.materialize(spark.range(5))
    assert df.count() == 5 and os.path.exists(session.scratch_of(df).removeprefix("file:"))
    session.release(df, spark.range(1))
    assert not os.path.exists(session.scratch_of(df).removeprefix("file:"))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with session.brief_shuffles(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_sample_of_many_is_the_same(spark):
    x = np.random.default_rng(9).normal(size=(900, 3))
    classes = V.classes_of(V.packed(_table(spark, x, "double"), "vec_id", "embedding"))
    few, same = V.sample(classes, 20), V.sample(classes, 20, n=900)
    assert few.keys() == same.keys() == {3} and (few[3] == same[3]).all() and len(few[3]) == 20
