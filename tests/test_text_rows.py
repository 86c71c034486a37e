"""Words of each document counted once; only rows of rare words cross to their word."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import text

ODD = [
    (1, "It's the dog's (big) bone--isn't it? state-of-the-art 4ever"), (1, "the---Bone  x"), (2, None), (3, ""), (None, "the n't 's"), (None, "The  end  l'été ÇA"),
    (4, "--- -a- --'s a--b---c\td\x0be,f;g:h@i#j$k%l&m?n!o\"p(q)r[s]t{u}v<w>x y\r\nz"), (5, "½cup cup½ ¿qué? don't  Ωmega ΣΑΣ İstanbul ab1 1ab o'clock's"),
]


def odd(spark):
    return spark.createDataFrame(ODD, "id int, t string")


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_counts_are_those_of_the_words(spark):
    """Keys repeat or are null; the words are those that ``words`` finds in Spark."""
    want = odd(spark).select("id", F.explode(text.words("t")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    assert _rows(text.term_counts(odd(spark), "id", "t")) == _rows(want)


@pytest.mark.parametrize("most", [1 << 19, 1])
def test_lemmas_of_small_and_large_dictionaries(spark, monkeypatch, most):
    monkeypatch.setattr(text, "LEMMAS", most)
    lemmas = spark.createDataFrame([("bone", "limb"), ("the", "a"), ("dog", None), (None, "x"), ("x", "a"), ("x", "limb")], "term string, lemma string")
    words = odd(spark).select("id", F.explode(text.words("t")).alias("term")).join(lemmas, "term", "left")
    want = words.groupBy("id", F.coalesce("lemma", "term").alias("term")).agg(F.count("*").alias("tf"))
    assert _rows(text.term_counts(odd(spark), "id", "t", lemmas)) == _rows(want)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_cross_few_times(spark):
    """Before, each of these plans held the counting of words several times, and all rows crossed to a struct of word and salt."""
    lemmas = spark.createDataFrame([("the", "a")], "term string, lemma string")
    vocabulary = text.vocabulary(odd(spark), "id", "t")
    for got in (text.tf_idf(odd(spark), "id", "t"), text.tf_idf(odd(spark), "id", "t", lemmas), text.score_tf_idf(odd(spark), "id", "t", vocabulary)):
        assert _shuffles(got) <= 3  # rows of rare words, the vocabulary, all rows to their document


@pytest.mark.parametrize("share", [2e-6, 0.1, 1.0])
def test_frequent_and_rare_words_have_the_same_weights(spark, monkeypatch, share):
    want = {(r.id, r.term): r.weight for r in text.tf_idf(odd(spark), "id", "t").collect()}
    monkeypatch.setattr(text, "FREQUENT", share)
    got = {(r.id, r.term): r.weight for r in text.tf_idf(odd(spark), "id", "t").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    known = text.vocabulary(odd(spark).where("id = 1"), "id", "t")
    scored = text.score_tf_idf(odd(spark), "id", "t", known).collect()
    assert {r.term for r in scored} <= {r.term for r in known.collect()} and sum(r.weight**2 for r in scored if r.id == 1) == pytest.approx(1)
