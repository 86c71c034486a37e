import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import seasonal, text


def test_words(spark):
    df = spark.createDataFrame([("The dog's (big) bone, isn't 4ever state-of-the-art; Ça va --ok",)], "t string")
    assert df.select(text.words("t").alias("w")).first().w == ["the", "dog", "big", "bone", "is", "ça", "va", "ok"]


def _by_hand(docs):
    counts = {k: Counter(v.split()) for k, v in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for k, c in counts.items():
        raw = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(k, t): v / norm for t, v in raw.items()})
    return out


def test_tf_idf_by_hand(spark):
    docs = {1: "a b b c", 2: "a a d", 3: "a", 4: ""}
    df = spark.createDataFrame(list(docs.items()), "id int, t string")
    got = {(r.id, r.term): r.weight for r in text.tf_idf(df, "id", "t").collect()}
    want = _by_hand(docs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_rare_and_common_terms_meet_their_frequency(spark):
    """Enough distinct terms that both the broadcast and the joined path are taken."""
    docs = spark.range(400).selectExpr("id", "concat_ws(' ', 'common', translate(concat('w', id), '0123456789', 'abcdefghij'), "
                                             "concat_ws(' ', transform(sequence(1, 40), i -> translate(concat('x', id * 40 + i), '0123456789', 'abcdefghij')))) t")  # fmt: skip
    got = text.tf_idf(docs, "id", "t")
    assert got.filter("weight IS NULL").count() == 0 and got.count() == 400 * 42
    assert got.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_sparse_strings(spark):
    weights = spark.createDataFrame([(1, "b", 0.25), (1, "a", 1 / 3), (2, "z", 0.0)], "id int, term string, weight double")
    assert [r.vector for r in text.sparse_strings(weights, "id").collect()] == ["a:0.333333 b:0.250000"]


def test_seasonal_fit_recovers_an_autoregression():
    rng = np.random.default_rng(3)
    y = [0.0]
    for _ in range(600):
        y.append(0.8 * y[-1] + rng.normal())
    fits = {o: seasonal.fit_one(np.array(y), o, 12, 3) for o in seasonal.ORDERS}
    best = min(fits, key=lambda o: fits[o][0])
    assert best[0] == 1 and best[1] == 0
    assert fits[best][1][0] == pytest.approx(0.8 * y[-1], abs=0.4)


def test_seasonal_fit_follows_season_and_trend():
    t = np.arange(200)
    y = 5 * np.sin(2 * np.pi * t / 12) + 0.1 * t
    _, forecast = seasonal.fit_one(y, (0, 0, 0, 0, 1, 0), 12, 12)
    later = np.arange(200, 212)
    np.testing.assert_allclose(forecast, 5 * np.sin(2 * np.pi * later / 12) + 0.1 * later, atol=1e-6)


def test_short_series_has_no_fit():
    assert seasonal.fit_one(np.ones(20), (1, 0, 1, 1, 0, 1), 12, 3) == (float("inf"), None)
