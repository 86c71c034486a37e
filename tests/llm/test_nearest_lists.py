"""Which lists a search reads, how much it finds, and what it does with few or odd candidates."""

import math
from collections import defaultdict

import numpy as np

from gaugeline.llm import ann


def clustered(n, centres=400, dim=24, spread=0.15, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


def brute(x, ids, q, k):
    score = x @ x[q]
    return [int(ids[i]) for i in np.lexsort((ids, -score)) if i != q][:k]




def test_lists_are_pruned_on_clusters_and_the_ratio_follows_structure():
    rng = np.random.default_rng(1)
    shares = {}
    for name, x in (("clusters", clustered(12000)), ("noise", rng.normal(size=(12000, 24)))):
        top = float(np.sqrt((x * x).sum(1)).max())
        graph = ann.Graph.of(ann.balanced_kmeans(ann.lift(x, top), 94))
        ratio = ann.ratio_of(x, top, graph, 20)
        some = rng.choice(len(x), 200, replace=False)
        near = ann.probes(ann.lift(x[some], top, True), graph, ratio)
        shares[name] = np.mean([len(ids) for ids, _ in near]) / len(graph.centre)
        assert all(np.all(np.diff(d) >= 0) for _, d in near)
        lists = [set(c.tolist()) for c in ann.lists_of(ann.lift(x, top), graph)]
        hit = total = 0
        for q, (ids, _) in zip(some.tolist(), near):
            for j in brute(x, np.arange(len(x)), q, 20):
                hit, total = hit + bool(lists[j] & set(ids.tolist())), total + 1
        assert hit / total >= 0.93
    assert shares["clusters"] < 0.35 < shares["noise"]


def test_the_graph_finds_what_all_centroids_would():
    x = clustered(30000, centres=3000, spread=0.05)
    top = float(np.sqrt((x * x).sum(1)).max())
    graph = ann.Graph.of(ann.balanced_kmeans(ann.lift(x[:9000], top), 1800))
    assert len(graph.centre) > 32 * ann.BEAM
    asked = ann.lift(x[:300], top, True)
    every = np.sqrt(ann._distance(asked, graph.centre))
    gone = []
    search = graph.search
    graph.search = lambda x, b: gone.append(b) or search(x, b)
    found = ann.probes(asked, graph, 1.05)
    assert gone == [16 * ann.BEAM]
    want = [set(np.flatnonzero(d <= 1.05 * np.sort(d)[ann.FLOOR] + 1e-12).tolist()) for d in every]
    assert np.mean([len(w & set(ids.tolist())) / len(w) for w, (ids, _) in zip(want, found)]) > 0.97


def test_two_rounds_find_what_one_task_would(spark):
    """More lists than the first round reads, copies of one vector in a third of the rows, ids that are null or repeated, odd vectors."""
    x = clustered(6000, centres=60, dim=8)
    x[1000:3000] = x[1000]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[5].tolist()), (77, x[78].tolist())]
    rows += [(90001, [math.nan] * 8), (90002, [1.0] * 7 + [None]), (90003, [math.inf] * 8), (90004, [0.0] * 8), (90005, None), (90006, [1.0, 2.0]), (90007, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as bound", "3 as list", "4 as far")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 40 = 0 or vec_id >= 90000")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[90006] == [(90007, 5.0)] and got[90007] == [(90006, 5.0)]  # fewer candidates than k
    assert not {90001, 90002, 90003, 90004, 90005} & set(got)
    good = [(i, v) for i, v in rows if i is not None and i < 90000]
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    hit = total = 0
    for q in range(0, 6000, 40):
        score = m @ x[q]
        want = [(int(ids[i]), score[i]) for i in np.lexsort((ids, -np.round(score, 10))) if ids[i] != q][:20]
        assert len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        floor = want[-1][1]
        hit, total = hit + sum(s >= floor - 1e-9 for _, s in got[q]), total + 20
    assert hit / total >= 0.9
