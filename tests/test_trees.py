"""Tree ensembles against plain recursion, exact leaves, the part that Spark splits, and the job counts that were promised."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import models, trees
from gaugeline.operators.schedule import Regimen
from gaugeline.operators import schedule
from gaugeline.plans import backtest, forecast
from gaugeline.session import materialize, scratch_dir
from gaugeline.sources import store

EXACT = trees.Growth(trees=1, drawn=False)


def recursion(x, y, least=1, depth=99):
    """The best split of every node, tried one by one."""
    best = None
    if len(set(y)) > 1 and depth:
        for f in range(x.shape[1]):
            for v in sorted(set(x[:, f]))[:-1]:
                low = x[:, f] <= v
                if min(low.sum(), (~low).sum()) < least:
                    continue
                gain = y[low].sum() ** 2 / low.sum() + y[~low].sum() ** 2 / (~low).sum()
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, v, low
    if best is None:
        return y.mean()
    _, f, v, low = best
    return f, v, recursion(x[low], y[low], least, depth - 1), recursion(x[~low], y[~low], least, depth - 1)


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("least, depth", [(1, None), (4, None), (1, 3)])
def test_best_splits_equal_recursion(least, depth):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        x, y = rng.integers(0, 6, (70, 3)).astype(float), rng.integers(0, 50, 70).astype(float)
        grown = trees.grow(x, y, np.arange(70), range(1), trees.Growth(1, "best", False, depth, least))
        plain = recursion(x, y, least, depth or 99)
        assert np.allclose(grown.predict(x), [walk(plain, r) for r in x])


def test_trees_grown_together_equal_trees_grown_alone():
    rng = np.random.default_rng(2)
    x, y, row = rng.normal(size=(300, 4)).round(1), rng.normal(size=300), rng.integers(0, 1 << 50, 300)
    for growth in (trees.Growth(), trees.Growth(splits="random", drawn=False)):
        together = trees.grow(x, y, row, range(6), growth).predict(x)
        assert np.allclose(together, sum(trees.grow(x, y, row, range(t, t + 1), growth).predict(x) for t in range(6)))
        mixed = rng.permutation(300)
        assert np.allclose(trees.grow(x[mixed], y[mixed], row[mixed], range(6), growth).predict(x), together)


def test_random_cuts_lie_in_the_range_of_their_own_node():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 3)), rng.normal(size=400)
    grown = trees.grow(x, y, np.arange(400), range(1), trees.Growth(1, "random", False))
    cuts, todo = set(), [(0, np.arange(400))]
    while todo:
        node, rows = todo.pop()
        f = grown.feature[node]
        if f < 0:
            assert grown.value[node] == pytest.approx(y[rows].mean())
            continue
        low = x[rows, f] <= grown.cut[node]
        assert 0 < low.sum() < len(rows) and x[rows, f].min() <= grown.cut[node] < x[rows, f].max()
        cuts.add(grown.cut[node])
        todo += [(grown.left[node], rows[low]), (grown.right[node], rows[~low])]
    assert len(cuts) > 150  # a cut of its own for every node, not a few per tree
    other = trees.grow(x, y, np.arange(400), range(1, 2), trees.Growth(1, "random", False))
    assert other.cut[0] != grown.cut[0]


def test_draws_follow_poisson():
    w = np.concatenate([trees.drawn_weights(np.arange(20000), t, trees.Growth()) for t in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def table(spark, n=3000, width=3, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (n, width)).astype(float)
    y = np.sin(x[:, 0] / 5) + (x[:, 1] > 17) * x[:, 2] / 10
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row long, x array<double>, y double").repartition(5)
    return materialize(df, "rows"), x, y


def predictions(upper, pieces, x):
    found = {(p["tree"], p["node"]): trees.trees_of(p) for p in pieces.collect()}
    total = np.zeros(len(x))
    for tree in sorted({t for t, _ in found}):
        node = upper.route(tree, x)
        for n in np.unique(node):
            total[node == n] += found[tree, n].predict(x[node == n])
    return total


def test_upper_part_equals_one_task(spark):
    """40 values a feature: all of them are candidates above as well, so the tree is the same."""
    rows, x, y = table(spark)
    upper, pieces = trees.pieces(rows, EXACT, 3, local=200)
    assert len(upper.splits[0]) > 5 and pieces.count() == len(upper.splits[0]) + 1
    assert np.allclose(predictions(upper, pieces, x), trees.grow(x, y, np.arange(len(y)), range(1), EXACT).predict(x))


@pytest.mark.parametrize("growth", [trees.Growth(4), trees.Growth(4, "random", False)])
def test_upper_part_of_ensembles_learns(spark, growth):
    rows, x, y = table(spark)
    upper, pieces = trees.pieces(rows, growth, 3, local=300)
    assert all(upper.splits)
    mean = predictions(upper, pieces, x) / 4
    assert ((mean - y) ** 2).mean() < 0.05 * y.var()
    asked = rows.select("row", "x")
    scores = {r["row"]: r["predict"] for r in trees.joined_scores(asked, upper, materialize(pieces, "p"), 3, 4).collect()}
    assert np.allclose([scores[i] for i in range(len(y))], mean)


def jobs_of(spark, fn):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    try:
        fn()
    finally:
        spark.sparkContext.setJobGroup(uuid.uuid4().hex, "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_grow_with_depth_not_with_trees(spark):
    rows, _, _ = table(spark)
    few = jobs_of(spark, lambda: trees.upper_part(rows, trees.Growth(2, "random", False), 3, 1500))
    many = jobs_of(spark, lambda: trees.upper_part(rows, trees.Growth(20, "random", False), 3, 1500))
    assert many <= 3 * few  # a deeper path in one of the trees may cost some levels more


def hours(spark, entities, days=6, kind="string"):
    df = spark.range(days * 24).select(F.expr("timestampadd(HOUR, cast(id as int), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"))
    names = spark.createDataFrame([(e, float(i)) for i, e in enumerate(entities)], f"entity {kind}, level double")
    df = df.crossJoin(names).selectExpr("entity", "ts", "level", "hour(ts) as hour")
    return df.withColumn("value", F.col("level") * 100 + F.pmod(F.col("hour") * 7, F.lit(24)))


def test_many_entities_as_a_feature_keep_their_own_level(spark):
    """200 entities, each a constant of its own in random order: one deep tree tells all of them apart."""
    rng = np.random.default_rng(8)
    rows = [(f"e{i}", float(v), j) for i, v in enumerate(rng.permutation(200)) for j in range(5)]
    df = spark.createDataFrame(rows, "entity string, value double, noise int")
    kind = models.ModelKind("one", "rf", lambda: models.Forest(1, drawn=False))
    scored = forecast.fit(df, ["entity", "noise"], "value", kind).transform(df)
    assert scored.where("predict != value").count() == 0 and scored.count() == 1000


def test_window_models_use_only_their_own_entities(spark):
    """An entity that a window has not trained on is unseen there, whatever its place among all entities."""
    df = hours(spark, ["a", "b", "c"]).where("entity != 'b' or ts >= timestamp_ntz'2024-01-03 00:00:00'")
    kind = models.ModelKind("one", "rf", lambda: models.Forest(1, drawn=False))
    regimen = Regimen("2D", "1D", min_train=1)
    got = backtest.learned(df, schedule.time_range(df, "ts"), regimen, "entity", "ts", "value", ["entity", "hour"], kind, scratch_dir(spark, "own")).collect()
    assert len(got) == 4 * 72
    for r in got:
        if not (r.entity == "b" and r.window_id == 0):
            assert r.predict == r.actual
        else:  # as the lowest code, like the first entity
            assert r.predict == r.actual - 100


@pytest.mark.parametrize("kind, entities", [("boolean", [True, False]), ("double", [1.5, -2.0]), ("string", ["x", None])])
def test_per_entity_finds_entities_of_any_type(spark, kind, entities):
    df = hours(spark, entities, kind=kind)
    want = {e for e in entities if e is not None}
    for cutoff in (None, "2024-01-04 00:00:00"):
        got = backtest.learned_per_entity(
            df, Regimen("2D", "1D", min_train=1), "entity", "ts", "value", ["hour"], models.ModelKind("one", "rf", lambda: models.Forest(1, drawn=False)),
            scratch_dir(spark, "per-entity"), cutoff=cutoff,
        ).collect()
        assert {r.entity for r in got} == want
        assert len(got) == len(want) * (96 if cutoff is None else 72) and all(r.predict == r.actual for r in got)


def test_jobs_of_per_entity_models_do_not_grow_with_entities(spark):
    kind = models.model_kind("RF", {"rf__n_estimators": 2})
    run = lambda n: lambda: backtest.learned_per_entity(
        hours(spark, [f"e{i}" for i in range(n)]), Regimen("2D", "1D", min_train=1), "entity", "ts", "value", ["hour"], kind, scratch_dir(spark, "jobs")
    )
    assert abs(jobs_of(spark, run(2)) - jobs_of(spark, run(12))) <= 2


def test_large_windows_and_entities_are_fitted_one_by_one(spark, monkeypatch):
    df, regimen = hours(spark, ["a", "b"]), Regimen("2D", "1D", min_train=1)
    kind = models.ModelKind("one", "rf", lambda: models.Forest(1, drawn=False))
    span = schedule.time_range(df, "ts")
    ways = []
    for local in (1 << 18, 40):
        monkeypatch.setattr(trees, "LOCAL", local)
        out = scratch_dir(spark, "large")
        both = (
            backtest.learned(df, span, regimen, "entity", "ts", "value", ["entity", "hour"], kind, f"{out}/a"),
            backtest.learned_per_entity(df, regimen, "entity", "ts", "value", ["hour"], kind, f"{out}/b"),
        )
        ways.append([sorted(map(tuple, d.collect())) for d in both])
    assert ways[0] == ways[1] and len(ways[0][0]) == 192


def test_sweep_runs_each_variation_once(spark):
    df, regimen = hours(spark, ["a", "b"]), Regimen("2D", "1D", min_train=1)
    df = df.withColumn("gap", F.when(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz"), None).otherwise(F.col("hour")))
    one, et = models.ModelKind("one", "rf", lambda: models.Forest(1, drawn=False)), models.model_kind("ET_SC", {"et__n_estimators": 3})
    variations = [("one", ["entity", "hour"], one), ("gappy", ["gap"], one), ("et", ["entity", "hour"], et)]
    where, ledger = scratch_dir(spark, "sweep"), scratch_dir(spark, "ledger")
    run = lambda some: backtest.sweep(df, schedule.time_range(df, "ts"), regimen, "entity", "ts", "value", some, where, ledger)
    first = {r.variation: r.overall_error for r in run(variations[:2]).collect()}
    assert first["one"] == 0 and first["gappy"] > 0
    again = run(variations)
    assert sorted(r.variation for r in again.collect()) == ["et", "gappy", "one"]
    plain = backtest.learned(df.dropna(subset=["gap"]), schedule.time_range(df, "ts"), regimen, "entity", "ts", "value", ["gap"], one, scratch_dir(spark, "plain"))
    from gaugeline.operators import scores

    assert scores.overall_error(scores.entity_errors(plain)).first()["overall_error"] == pytest.approx(first["gappy"])
    assert store.ledger(spark, ledger).count() == 3
