"""Term weights of short and long texts."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators.lookup import attach
from gaugeline.session import materialize

# Characters that separate words besides white space, and clitics cut off a word's end.
SEPARATORS = r"[\s,;:@#$%&?!\"()\[\]{}<>]+|--+"
CLITICS = r"('s|'m|'d|'ll|'re|'ve|n't)$"
EDGE_PUNCTUATION = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


WORD = r"^\p{L}+$"

_SIGNS = "\t\n\x0b\f\r,;:@#$%&?!\"()[]{}<>"
_CLITICS, _LINE_ENDS = ("'s", "'m", "'d", "'ll", "'re", "'ve", "n't"), ("\u0085", "\u2028", "\u2029")
LEMMAS = 1 << 19  # rows of a dictionary that goes with the tasks, at most
KNOWN, EMIT = 1 << 19, 1 << 17  # tokens whose word a task remembers, and words in a batch of its rows
FREQUENT = 2e-6


def _term(token: Column) -> Column:
    """The word in a token, cut free of clitics and edge punctuation; most tokens are words already."""
    cut = F.regexp_replace(F.regexp_replace(token, CLITICS, ""), EDGE_PUNCTUATION, "")
    return F.when(token.rlike(WORD), token).otherwise(cut)


def words(text: str | Column) -> Column:
    """Lower-case alphabetic words of a text; tokens with digits or inner punctuation are not words."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(F.lower(text), SEPARATORS), _term), lambda t: t.rlike(WORD))


def _tokens(text: str) -> list[str]:
    """Split at ``SEPARATORS``, but for a dash that an odd run of them leaves before the next token, where ``_cut`` takes it off."""
    text = text.replace("--", " ")
    for sign in _SIGNS:
        if sign in text:
            text = text.replace(sign, " ")
    return text.split(" ")


def _cut(token: str) -> str | None:
    """The word in a token as ``_term`` finds it, or None. Before a last line separator a pattern's end matches too, as in Java."""
    body = token[:-1] if token[-1:] in _LINE_ENDS else token
    if body.isalpha():
        return token
    clitic = next((c for c in _CLITICS if body.endswith(c)), "")
    token = body[: len(body) - len(clitic)] + token[len(body) :]
    lo, hi = 0, len(token)
    while lo < hi and unicodedata.category(token[lo])[0] not in "LN":
        lo += 1
    while lo < hi and unicodedata.category(token[hi - 1])[0] not in "LN":
        hi -= 1
    return token[lo:hi] if token[lo:hi].isalpha() else None


def _counted(key: str, lemmas: dict[str, list[str | None]]):
    """Rows in the order of their keys to one row per key with its words and their numbers; what is held are one key's words and a batch."""

    def run(batches):
        known: dict[str, list[str]] = {}
        kind, now, words, out = None, None, None, []

        def batch():
            sizes = np.cumsum([0] + [len(w) for _, w in out])
            offsets = pa.array(sizes, pa.int32())
            terms = pa.ListArray.from_arrays(offsets, pa.array([t for _, w in out for t in w], pa.string()))
            tfs = pa.ListArray.from_arrays(offsets, pa.array([n for _, w in out for n in w.values()], pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), terms, tfs], [key, "_terms", "_tfs"])

        held = 0
        for rows in batches:
            kind = rows.column(0).type
            for k, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                if words is None or not (k == now or (k != k and now != now)):
                    if words:
                        out.append((now, words))
                        held += len(words)
                    now, words = k, {}
                if held > EMIT:
                    yield batch()
                    out, held = [], 0
                if not text.is_valid:
                    continue
                for token, n in Counter(_tokens(text.as_py())).items():
                    if not lemmas and token.isalpha():
                        words[token] = words.get(token, 0) + n
                        continue
                    terms = known.get(token)
                    if terms is None:
                        if len(known) > KNOWN:
                            known.clear()
                        word = _cut(token)
                        terms = known[token] = [] if word is None else [word if x is None else x for x in lemmas.get(word, [None])]
                    for term in terms:
                        words[term] = words.get(term, 0) + n
        if words:
            out.append((now, words))
        if out:
            yield batch()

    return run


def term_arrays(docs: DataFrame, key: str, text: str, lemmas: DataFrame | None = None) -> DataFrame:
    """``(key, _terms, _tfs)``, one row per key that has words: its different words and how often each occurs.

    Texts cross once, to the task of their key, and every token is looked at once. A dictionary of up to ``LEMMAS`` rows goes with the
    tasks; of a larger one see ``term_counts``.
    """
    # Named apart, as a key may be called like the text. Lower case by Spark, which also mends bytes that are no UTF-8.
    rows = docs.select(key, F.lower(F.col(text)).alias("_text")).repartition(F.col(key)).sortWithinPartitions(F.col(key))
    by: dict[str, list[str | None]] = {}
    if lemmas is not None:
        for r in lemmas.select("term", "lemma").where("term IS NOT NULL").collect():
            by.setdefault(r["term"], []).append(r["lemma"])
    schema = T.StructType([rows.schema[key], T.StructField("_terms", T.ArrayType(T.StringType())), T.StructField("_tfs", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(_counted(key, by), schema)


def _rows(arrays: DataFrame, key: str) -> DataFrame:
    pairs = arrays.select(key, F.explode(F.arrays_zip("_terms", "_tfs")).alias("_t"))
    return pairs.select(key, F.col("_t._terms").alias("term"), F.col("_t._tfs").alias("tf"))


def term_counts(docs: DataFrame, key: str, text: str, lemmas: DataFrame | None = None) -> DataFrame:
    """``(key, term, tf)``. ``lemmas`` is an optional ``(term, lemma)`` table; other words stay as they are."""
    if lemmas is None or lemmas.limit(LEMMAS + 1).count() <= LEMMAS:
        return _rows(term_arrays(docs, key, text, lemmas), key)
    # Counted per word first, so the dictionary meets each word of a document once.
    counts = _rows(materialize(term_arrays(docs, key, text), "words"), key)
    weights = counts.groupBy("term").agg(F.count("*").alias("n"))
    table = weights.join(lemmas.select("term", "lemma"), "term")
    found = attach(counts, table.select("term", "lemma", "n"), "term", "n", [key])
    return found.groupBy(key, F.coalesce("lemma", "term").alias("term")).agg(F.sum("tf").alias("tf"))


def _kept_counts(docs: DataFrame, key: str, text: str, lemmas: DataFrame | None) -> DataFrame:
    """``term_counts`` written once, for several passes."""
    if lemmas is None or lemmas.limit(LEMMAS + 1).count() <= LEMMAS:
        return _rows(materialize(term_arrays(docs, key, text, lemmas), "words"), key)
    return materialize(term_counts(docs, key, text, lemmas), "words")


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def _weights(counts: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Weights by ``table`` (``term``, its ``n`` rows, ``idf`` or null); words without ``idf`` are dropped.

    Words with a share of at least ``FREQUENT`` of the rows, known or not, are looked up in a broadcast of at most 1 / ``FREQUENT``
    words and stay where they are; the rows of the others are even over the words and are joined.
    """
    total = table.agg(F.sum("n")).scalar()
    ranked = table.withColumn("_hot", F.col("n") >= F.lit(FREQUENT) * total)
    hot = ranked.filter("_hot").select("term", F.struct("idf").alias("_hot"))
    looked = counts.join(F.broadcast(hot), "term", "left")
    names = [key, "term", (F.col("tf") * F.col("idf")).alias("raw")]
    near = looked.filter("_hot.idf IS NOT NULL").withColumn("idf", F.col("_hot.idf")).select(names)
    cold = ranked.filter("NOT _hot AND idf IS NOT NULL").select("term", "idf")
    far = looked.filter("_hot IS NULL").select(key, "term", "tf").join(cold, "term").select(names)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))  # one document's terms
    return near.union(far).select(key, "term", (F.col("raw") / length).alias("weight"))


def tf_idf(docs: DataFrame, key: str, text: str, lemmas: DataFrame | None = None) -> DataFrame:
    """``(key, term, weight)``: tf * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 per document.

    ``n`` counts all documents, also those without any word. Runs jobs: the words of each document are counted and written once.
    """
    counts = _kept_counts(docs, key, text, lemmas)
    n = docs.agg(F.count("*")).scalar()
    idf = F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    table = document_frequencies(counts).select("term", F.col("df").alias("n"), idf.alias("idf"))
    return _weights(counts, key, materialize(table, "vocabulary"))


def score_tf_idf(docs: DataFrame, key: str, text: str, vocabulary: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Weights of new documents under a fitted vocabulary ``(term, idf)``; unknown terms are dropped. Runs jobs."""
    counts = _kept_counts(docs, key, text, lemmas)
    table = counts.groupBy("term").agg(F.count("*").alias("n")).join(vocabulary.select("term", "idf"), "term", "left")
    return _weights(counts, key, materialize(table, "vocabulary"))


def vocabulary(docs: DataFrame, key: str, text: str, lemmas: DataFrame | None = None) -> DataFrame:
    n = docs.agg(F.count("*")).scalar()
    frequencies = document_frequencies(term_counts(docs, key, text, lemmas))
    return frequencies.select("term", (F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def sparse_strings(weights: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """``term:weight`` pairs of a document in term order, separated by blanks."""
    pair = F.concat(F.col("term"), F.lit(":"), F.format_string(f"%.{digits}f", F.col("weight")))
    rows = weights.filter(F.col("weight") != 0).groupBy(key)
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("term", pair.alias("pair")))).alias("pairs"))
    return packed.select(key, F.array_join("pairs.pair", " ").alias("vector"))
