"""What the learned queries ask of their operators: the reference's variations, all trees, depth and entities."""

import __spark_entry__ as entry
from gaugeline.plans import backtest
from gaugeline.queries.common import ENTITY, TARGET


def test_variations_of_the_reference(spark, sf_dir, monkeypatch):
    seen = {}
    monkeypatch.setattr(backtest, "sweep", lambda rows, span, regimen, entity, ts, target, variations, *rest: seen.update(rows=rows, variations=variations))
    entry.queries()["m14_variation_sweep"](spark, sf_dir)
    kinds = [(kind.name, kind.params) for _, _, kind in seen["variations"]]
    assert sorted(params["numTrees"] for _, params in kinds) == [5, 10, 10, 20, 20, 20, 20, 20, 20, 100]
    assert all("maxDepth" not in params for _, params in kinds) and sum(ENTITY in names for _, names, _ in seen["variations"]) == 4
    for names in {tuple(names) for _, names, _ in seen["variations"]}:
        assert seen["rows"].dropna(subset=[*names, TARGET]).count() > 300


def test_entities_and_depth(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(backtest, "learned_per_entity", lambda *a, top=40, **kw: seen.append((a[6], top)))
    monkeypatch.setattr(backtest, "learned", lambda *a: seen.append((a[7], 40)))
    for name in ("m10_m13_backtest_forest", "m11_forest_per_entity", "m11_forest_per_entity_cutoff"):
        entry.queries()[name](spark, sf_dir)
    assert [(kind.params, top) for kind, top in seen] == [({"numTrees": 20}, 40)] * 3
