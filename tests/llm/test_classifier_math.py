"""The two classifiers' sums and slopes against enumeration, finite differences and plain counting; addresses of archives."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from gaugeline.llm import bytesops as B
from gaugeline.llm import quality, toxicity, warc


def _chains(seed):
    rng = np.random.default_rng(seed)
    first = np.array([0, 3, 3, 4, 9])  # texts of 3, 0, 1 and 5 lines
    return rng.normal(size=9), rng.normal(size=(2, 2)), first, rng


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_marginals_equal_a_sum_over_all_label_sequences(seed):
    bad, pairs, first, _ = _chains(seed)
    p, both, whole = quality.marginals(bad, pairs, first)
    want_both = np.zeros((2, 2))
    for text, (lo, hi) in enumerate(zip(first, first[1:])):
        every = list(itertools.product((0, 1), repeat=hi - lo))
        score = np.array([sum(bad[lo + i] * y for i, y in enumerate(s)) + sum(pairs[a, b] for a, b in zip(s, s[1:])) for s in every])
        chance = np.exp(score) / np.exp(score).sum()
        if hi > lo:
            assert whole[text] == pytest.approx(np.log(np.exp(score).sum()))
        for i in range(hi - lo):
            assert p[lo + i] == pytest.approx(sum(c for c, s in zip(chance, every) if s[i]))
        for c, s in zip(chance, every):
            for a, b in zip(s, s[1:]):
                want_both[a, b] += c
    assert both == pytest.approx(want_both)


def test_slopes_of_the_field_equal_finite_differences():
    bad, pairs, first, _ = _chains(3)
    p, both, _ = quality.marginals(bad, pairs, first)
    step = 1e-5

    def partition(b, q):
        return quality.marginals(b, q, first)[2].sum()

    for i in range(len(bad)):
        d = np.eye(len(bad))[i] * step
        assert p[i] == pytest.approx((partition(bad + d, pairs) - partition(bad - d, pairs)) / (2 * step), abs=1e-7)
    for i in range(4):
        d = np.eye(4)[i].reshape(2, 2) * step
        assert both.ravel()[i] == pytest.approx((partition(bad, pairs + d) - partition(bad, pairs - d)) / (2 * step), abs=1e-7)


def test_line_scores_add_up_the_active_weights():
    block = next(B.blocks(pa.array(["One line.\nAnd two!\n\nthree 3", "", "BUY NOW\nBUY NOW", "x"])))
    measures, _, first = quality.lines(block)
    rng = np.random.default_rng(4)
    edges = np.sort(rng.random((quality.MEASURES, quality.BINS - 1)), 1)
    field = quality.Field(edges, rng.normal(size=3 * quality.MEASURES * quality.BINS + 3), np.zeros((2, 2)), np.array([1.0, 0.0]), 0.5)
    active = field.active(measures, first)
    assert field.bad(active) == pytest.approx(field.weights[active].sum(1))
    span = quality.MEASURES * quality.BINS
    own = [[m * quality.BINS + int((edges[m] < row[m]).sum()) for m in range(quality.MEASURES)] for row in measures]
    for lo, hi in zip(first, first[1:]):
        for i in range(lo, hi):
            before = [x + span for x in own[i - 1]] if i > lo else [3 * span] * quality.MEASURES
            after = [x + 2 * span for x in own[i + 1]] if i + 1 < hi else [3 * span + 1] * quality.MEASURES
            assert active[i].tolist() == [*own[i], *before, *after, 3 * span + 2]


@pytest.mark.parametrize("prior", [0.05, 0.5])  # with the second the estimated loss on clean texts falls below zero
def test_slopes_of_the_risk_equal_finite_differences(prior):
    rng = np.random.default_rng(5)
    positive = [np.flatnonzero(rng.random(6) < 0.6) for _ in range(9)] + [np.zeros(0, int)]
    unlabelled = [np.flatnonzero(rng.random(6) < 0.3) for _ in range(14)]
    w, step = rng.normal(size=7) - (0.5 < prior), 1e-5
    if prior == 0.5:
        w[-1] = -6.0
        w[:-1] = 4.0
    risk, slope = toxicity.risk(w, positive, unlabelled, prior, 1e-2)
    kinked = prior * np.log1p(-1 / (1 + np.exp(-np.array([w[r].sum() + w[-1] for r in positive])))).mean() - np.log1p(
        -1 / (1 + np.exp(-np.array([w[r].sum() + w[-1] for r in unlabelled])))
    ).mean()
    assert (kinked < 0) == (prior == 0.5)

    def loss(v):
        p, u = (np.array([v[r].sum() + v[-1] for r in some]) for some in (positive, unlabelled))
        down = lambda z: np.log1p(np.exp(z))  # noqa: E731  the loss of an output that should be low
        clean = down(u).mean() - prior * down(p).mean()
        return prior * down(-p).mean() + max(0.0, clean) + 0.5e-2 * (v[:-1] ** 2).sum()

    assert risk == pytest.approx(loss(w))
    got = np.array([(loss(w + step * e) - loss(w - step * e)) / (2 * step) for e in np.eye(7)])
    assert slope == pytest.approx(got, abs=1e-7)


def test_copies_count_once():
    a, b, c = (np.arange(12, dtype="<u8") + k for k in (0, 100, 200))
    half = np.concatenate((a[:2], c[2:]))  # shares its first pair with a
    marks = [x.tobytes() for x in (a, b, a)] + [b"", half.tobytes(), b""]
    assert toxicity.apart(marks) == [0, 1, 3, 5]


def test_words_are_counted_where_they_lie(spark):
    texts = [("bad word here", 1), ("bad bad luck", 1), ("good word", 0), ("", 0), (None, 0), ("here " * 50000, 0)]
    rows = spark.createDataFrame(texts, "text string, label int").repartition(3).mapInArrow(toxicity._sets, "label int, words binary")
    rows = rows.selectExpr("*", "monotonically_increasing_id() as nr")
    got = rows.mapInArrow(toxicity._counted(None), "word long, p long, u long").groupBy("word").sum("p", "u").collect()
    want = {1: Counter(), 0: Counter()}
    for text, label in texts:
        block = next(B.blocks(pa.array([text], pa.string())))
        want[label].update(set(toxicity.words(block)[0].view(np.int64).tolist()))
    assert {(r[0], r[1], r[2]) for r in got} == {(w, want[1][w], want[0][w]) for w in want[1] | want[0]}
    assert rows.mapInArrow(toxicity._counted(np.zeros(0, np.int64)), "word long, p long, u long").count() == 0


def test_addresses_of_archives(spark):
    assert warc.place("/shared/a b") == "file:///shared/a b"
    assert warc.place("file:///shared/x") == "file:///shared/x"
    assert warc.place("s3a://bucket/x", "region=eu-west-1") == "s3://bucket/x?region=eu-west-1"
    spark.conf.set("spark.hadoop.fs.s3a.endpoint", "http://store.example:9000")
    spark.conf.set("spark.hadoop.fs.s3a.endpoint.region", "eu-west-1")
    try:
        settings = warc.s3_settings(spark)
    finally:
        spark.conf.unset("spark.hadoop.fs.s3a.endpoint")
        spark.conf.unset("spark.hadoop.fs.s3a.endpoint.region")
    assert warc.s3_settings(spark) == ""
    files, path = fs.FileSystem.from_uri(warc.place("s3a://bucket/folder/x.warc.gz", settings))
    assert (files.type_name, files.region, path) == ("s3", "eu-west-1", "bucket/folder/x.warc.gz")
