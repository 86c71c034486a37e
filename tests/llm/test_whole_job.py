"""Operators against plain computations where a bound on size used to leave a part of the job out."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gaugeline.llm import ann, packing, ppm


def plain_ppm(texts, learning):
    """log10 chances of whole texts from all contexts of the learning texts."""
    form = lambda t: b" ".join((t or "").encode().lower().split()) + b"\n"
    after = defaultdict(Counter)
    for t in map(form, learning):
        t = b"\n" * ppm.ORDER + t
        for i in range(ppm.ORDER, len(t)):
            for k in range(ppm.ORDER + 1):
                after[t[i - k : i]][t[i]] += 1
    out = []
    for t in map(form, texts):
        t, score = b"\n" * ppm.ORDER + t, 0.0
        for i in range(ppm.ORDER, len(t)):
            gone = set()
            for k in range(ppm.ORDER, -1, -1):
                here = {b: n for b, n in after[t[i - k : i]].items() if b not in gone}
                total = sum(here.values()) + len(here)
                if t[i] in here:
                    score += math.log10(here[t[i]] / total)
                    break
                if here:
                    score += math.log10(len(here) / total)
                gone |= set(here)
            else:
                score -= math.log10(256 - len(gone))
        out.append(score)
    return out


@pytest.mark.parametrize("parts, group", [(1 << 20, 1 << 22), (64, 100)])
def test_ppm_uses_every_run(spark, monkeypatch, parts, group):
    """The same scores with one group of runs and with many, and when most words are joined."""
    monkeypatch.setattr(ppm, "PARTS", parts)
    monkeypatch.setattr(ppm, "GROUP", group)
    monkeypatch.setattr(ppm, "CHUNK", 500)
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(names, rng.integers(1, 30)))) for i in range(80)] + [(80, None), (81, ""), (82, "Zq"), (None, "zq abc")]
    learning = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    want = dict(zip((d for d, _ in rows), plain_ppm([t for _, t in rows], learning)))
    got = {r.doc_id: r.score for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_nearest_reads_all_lists_within_the_ratio():
    rng = np.random.default_rng(2)
    graph = ann.Graph.of(rng.normal(size=(2000, 48)))
    x = rng.normal(size=(5, 48))
    dist = np.sqrt(((x[:, None] - graph.centre) ** 2).sum(2))
    want = [set(np.flatnonzero(d <= 1.2 * np.sort(d)[ann.FLOOR])) for d in dist]
    assert max(map(len, want)) > 320 and [set(p.tolist()) for p, _ in ann.probes(x, graph, 1.2)] == want


def test_nearest_fills_up_from_further_lists():
    """Ten lone vectors have lists of their own, so the lists near a query among them hold fewer than ``k``."""
    graph = ann.Graph.of(np.array([[i / 100, 1.0] for i in range(10)] + [[50.0 + i, 1.0] for i in range(5)]))
    held = np.array([1] * 10 + [6] * 5)
    ((near, _),) = ann.probes(graph.centre[:1], graph, 1.2, held, 20)
    assert set(range(10)) <= set(near.tolist()) and held[near].sum() >= 20
    assert len(ann.probes(graph.centre[:1], graph, 1.2, held, 1000)[0][0]) == 15


def test_packing_fills_windows_of_short_pieces_by_score():
    """More than 48 short pieces share a seed's rarer terms; longer ones share only the end sign."""
    lengths = [100] + [5] * 100 + [50] * 40
    terms = [np.arange(2, 62)] + [np.array([2, 3 + i % 59]) for i in range(100)] + [np.array([100 + i]) for i in range(40)]
    weights = [np.ones(len(t)) * 2.0 for t in terms]
    more = {"idf": np.ones(1 << 16)} if "idf" in packing.pack.__code__.co_varnames else {}
    first = packing.pack(np.array(lengths), terms, weights, window=600, **more)[0]
    assert {d for d, _, _ in first} == set(range(101))


def test_pipeline_keeps_all_rows_without_words(spark, sf_dir):
    rows = [(None, None)] * 3 + [(None, "")] * 2 + [(5, " \n\x0b")] * 2 + [(5, "\x1f")] * 2 + [(6, "one two")] * 2 + [(None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect())
    assert got == Counter(rows[:7]) | Counter({(5, "\x1f"): 1, (6, "one two"): 1})


def test_pipeline_keeps_all_signs_but_halved_letters(spark, sf_dir):
    """Replacement signs of the input stay; a cut through a letter takes what is left of it; all column names are free."""
    passage = "".join(f"é{i}~" for i in range(70))  # 200 bytes and more, beginning and ending inside a letter below
    rows = [(1, "\ufffd begins, é" + passage + "ö\ufffd ends"), (2, "x ©" + passage + "õ y"), (3, "\ufffd alone \ufffd"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", "1 as _score", "2 as _key", "3 as _row", "4 as _n", "5 as _text", "6 as _n_"
    )
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    # é and © share their last byte, ö and õ their first: on both sides a half goes with the passage and the other half with it.
    assert got == {1: "\ufffd begins, \ufffd ends", 2: "x  y", 3: "\ufffd alone \ufffd", 4: None, 5: ""}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
