"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (label 1) and texts of unknown kind, sampled from all learning documents, train a logistic model on the
presence of words and of word beginnings. With the share ``pi`` of toxic texts and logistic losses, the risk is

    pi * E_p[l(+f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])

whose second part estimates the loss on clean texts without any of them being marked; where it would fall below zero it
counts as zero, so nothing is gained by learning the unlabelled sample by heart. Labels 0 serve only for ``pi``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import bytesops as B
from gaugeline.llm.sampling import labelled, remainder
from gaugeline.session import materialize

POSITIVES, UNLABELLED = 3000, 8000  # texts used for fitting, at most (the second in expectation)
LEAST_TEXTS = 6  # a word is an input if so many of these texts have it,
APART = 4.0  # its share of the positives is so many standard deviations above its share of the unlabelled,
RATIO = 3.0  # and so many times that share

# Words for this model: ASCII letters and digits and all bytes above 127; everything else separates.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


PREFIXES = (4, 6)  # bytes of a longer word's beginning that count as inputs too


def words(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the beginnings of longer words, and per text the index of its first."""
    data = np.where(_WORD[block.data], B.lower(block.data), np.uint8(32))
    begins, ends, first = B.word_spans(data, block.starts)
    p = B.prefix_hash(data)
    out = np.empty((len(begins), 1 + len(PREFIXES)), B.U)
    out[:, 0] = B.span_hash(p, begins, ends)
    for i, size in enumerate(PREFIXES):
        out[:, 1 + i] = B.span_hash(p, begins, np.minimum(ends, begins + size)) + B.U(size)  # apart from whole words
    return out.ravel(), first * out.shape[1]


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float

    def score(self, block: B.Block) -> np.ndarray:
        hashes, first = words(block)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        text = np.repeat(np.arange(len(block)), np.diff(first))
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        pairs = np.unique(text[known] * max(len(self.vocabulary), 1) + at[known])  # presence, not number
        text, at = np.divmod(pairs, max(len(self.vocabulary), 1))
        z = self.bias + np.bincount(text, self.weights[at] if len(at) else None, len(block))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sets(batches):
    for batch in batches:
        out = []
        for block in B.blocks(batch.column("text")):
            hashes, first = words(block)
            out += [np.unique(hashes[first[i] : first[i + 1]]).tobytes() for i in range(len(block))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], ["label", "words"])


def _each(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, B.U) for x in batch.column("words").to_pylist()]


def _counted(kept: np.ndarray | None):
    """Words of the texts in ``kept`` (null: of all) with the numbers of positives and others that hold them, added up by batch."""

    def run(batches):
        for batch in batches:
            sets, label = _each(batch), batch.column("label").to_numpy()
            some = np.arange(len(sets)) if kept is None else np.flatnonzero(np.isin(batch.column("nr").to_numpy(), kept))
            if not len(some):
                continue
            held = np.concatenate([sets[i] for i in some])
            word, at = np.unique(held, return_inverse=True)
            p = np.bincount(at, np.repeat(label[some] == 1, [len(sets[i]) for i in some]), len(word)).astype(np.int64)
            n = np.bincount(at, minlength=len(word))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(p), pa.array(n - p)], ["word", "p", "u"])

    return run


def _marks(common: np.ndarray):
    """Twelve minima over the words of a text that are not in ``common``; none for a text without such words."""

    def run(batches):
        for batch in batches:
            out = []
            for s in _each(batch):
                own = s[~np.isin(s, common, assume_unique=True)]
                low = [B.mix(own ^ B.mix(B.U(i + 1) * own)).min() for i in range(12)] if len(own) else []
                out.append(np.array(low, B.U).tobytes())
            begin = [x[:64] for x in batch.column("words").to_pylist()]
            columns = [batch.column("nr"), batch.column("label"), pa.array(begin, pa.binary()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["nr", "label", "begin", "low"])

    return run


def _within(vocabulary: np.ndarray, kept: np.ndarray):
    """Which inputs every kept text has."""

    def run(batches):
        for batch in batches:
            sets, some = _each(batch), np.flatnonzero(np.isin(batch.column("nr").to_numpy(), kept))
            out = []
            for i in some:
                at = np.minimum(np.searchsorted(vocabulary, sets[i]), len(vocabulary) - 1)
                out.append(at[vocabulary[at] == sets[i]].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("nr").take(pa.array(some)), pa.array(out, pa.binary())], ["nr", "inputs"])

    return run


def apart(marks: list[bytes]) -> list[int]:
    """Which texts stay when of each group of copies only the first does, so that a copied text's words do not count as often as it was copied.

    Texts are copies here if they share one of six pairs of minima over their rare words; those without rare words all stay.
    """
    kept, seen = [], set()
    for nr, low in enumerate(marks):
        pairs = [(i, low[16 * i : 16 * i + 16]) for i in range(len(low) // 16)]
        if seen.isdisjoint(pairs):
            seen.update(pairs)
            kept.append(nr)
    return kept


def choose(p: np.ndarray, u: np.ndarray, positives: int, others: int, prior: float) -> tuple[np.ndarray, float]:
    """Which words are inputs, from the numbers of positives and of other texts that hold them, and the prior after a look at the strongest."""
    share = (p + u) / (positives + others)
    spread = np.sqrt(share * (1 - share) * (1 / positives + 1 / others)) + 1e-9
    in_p, in_u = p / positives, u / others
    chosen = (p + u >= LEAST_TEXTS) & (in_p - in_u >= APART * spread) & (in_p >= RATIO * in_u)
    if chosen.any():
        # Words that hardly any clean text has appear in both samples in the ratio pi to 1. The sample's own share can lie
        # above the labels' share; taken too small, toxic texts of the unlabelled sample would count as clean.
        strong = np.argsort(-((in_p - in_u) / spread)[chosen])[:30]
        prior = min(0.5, max(prior, 1.2 * float(np.median(in_u[chosen][strong] / in_p[chosen][strong]))))
    return chosen, prior


def risk(w: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, penalty: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights ``w`` (the constant last) with its penalty, and the slope by each weight."""
    rows = positive + unlabelled
    index, text = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    q = 1 / (1 + np.exp(-np.clip(np.bincount(text, w[index], len(rows)) + w[-1], -40, 40)))
    qp, qu = q[: len(positive)], q[len(positive) :]
    rest = -np.log(np.maximum(1 - qu, 1e-12)).mean() + prior * np.log(np.maximum(1 - qp, 1e-12)).mean()
    # Slopes of the losses by the outputs: l(+f) has q - 1, l(-f) has q.
    clean = np.concatenate((-prior * qp / len(qp), qu / len(qu)))
    slope = np.concatenate((prior * (qp - 1) / len(qp), np.zeros(len(qu)))) + (clean if rest >= 0 else 0)
    g = np.append(np.bincount(index, slope[text], len(w) - 1) + penalty * w[:-1], slope.sum())
    return -prior * np.log(np.maximum(qp, 1e-12)).mean() + max(0.0, rest) + penalty / 2 * (w[:-1] ** 2).sum(), g


def descend(positive: list[np.ndarray], unlabelled: list[np.ndarray], inputs: int, prior: float, bias: float, epochs: int = 60, rate: float = 0.1, penalty: float = 1e-5) -> np.ndarray:
    """Weights and, last, the constant that lower the risk over batches of both samples."""
    rng, w, steps = np.random.default_rng(7), np.zeros(inputs + 1), 0
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    w[-1] = bias
    batches = max(1, min(16, min(len(positive), len(unlabelled)) // 8))
    for _ in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)):
            _, g = risk(w, [positive[i] for i in p], [unlabelled[i] for i in u], prior, penalty)
            steps += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            w = w - rate * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.999**steps)) + 1e-8)
    return w


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", divisor: int = 3, held: int = 1,
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Model:
    """Fits on documents whose crc32(id) mod ``divisor`` is not ``held``: at most ``positives`` labelled 1, and about ``unlabelled`` of all.

    The words of these texts stay in the shared folder and are counted there, so texts may be of any length; the driver gets 200 bytes a
    text, the words that over 1 % of the texts hold, the inputs, and which of them each text has. Null and empty texts have no words, null ids
    are not learned from, repeated rows are copies. Without positive or unlabelled texts every text scores the prior. Runs jobs.
    """
    learn = labels.where(remainder(id_col, divisor) != held).where(F.col(f"`{label_col}`").isin(0, 1))
    n, ones = learn.agg(F.count("*"), F.sum(f"`{label_col}`")).first()
    prior = min(max((ones or 0) / n, 1e-3), 0.5) if n else 0.05
    bias = float(np.log(prior / (1 - prior)))
    chosen = F.broadcast(labelled(learn.where(f"`{label_col}` = 1"), id_col, label_col, divisor, held, positives))  # at most ``positives`` rows
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).where(remainder("doc", divisor) != held)
    part = min(1.0, unlabelled / max(rows.select("doc").count(), 1))
    some = rows.where(F.pmod(F.xxhash64("doc", F.lit("unlabelled")), F.lit(1 << 20)) < int(part * (1 << 20))).select("text", F.lit(0).alias("label"))
    sets = rows.join(chosen, "doc").select("text", "label").union(some).mapInArrow(_sets, "label int, words binary")
    sets = materialize(sets.withColumn("nr", F.monotonically_increasing_id()), "words")
    schema = "word long, p long, u long"
    counts = sets.mapInArrow(_counted(None), schema).groupBy("word").agg(F.sum(F.col("p") + F.col("u")).alias("n"))
    common = counts.where(F.col("n") > max(2, sets.count() // 100)).select("word").toArrow()["word"].to_numpy().view(B.U)
    found = sets.mapInArrow(_marks(common), "nr long, label int, begin binary, low binary").collect()
    found = sorted(found, key=lambda r: (bytes(r.begin), bytes(r.low), r.nr))  # the same order in every run
    groups = [[r for r in found if r.label == v] for v in (1, 0)]
    kept = [[g[i].nr for i in apart([bytes(r.low) for r in g])] for g in groups]
    if not all(kept):
        return Model(np.zeros(0, B.U), np.zeros(0), bias)
    every = np.array(sum(kept, []), np.int64)
    counts = sets.mapInArrow(_counted(every), schema).groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # Only words that can become inputs: far fewer than all.
    counts = counts.where((F.col("p") + F.col("u") >= LEAST_TEXTS) & (F.col("p") * len(kept[1]) >= RATIO * F.col("u") * len(kept[0]))).toArrow()
    word, p, u = (counts[c].to_numpy() for c in ("word", "p", "u"))
    order = np.argsort(word.view(B.U))
    word, p, u = word.view(B.U)[order], p[order], u[order]
    chosen, prior = choose(p, u, len(kept[0]), len(kept[1]), prior)
    vocabulary = word[chosen]
    if not len(vocabulary):
        return Model(np.zeros(0, B.U), np.zeros(0), bias)
    inputs = {r.nr: np.frombuffer(bytes(r.inputs), np.int32) for r in sets.mapInArrow(_within(vocabulary, every), "nr long, inputs binary").collect()}
    w = descend(*([inputs[nr] for nr in some] for some in kept), len(vocabulary), prior, bias)
    return Model(vocabulary, w[:-1], float(w[-1]))


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            score = [model.score(block) for block in B.blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())], ["doc", "_score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", divisor: int = 3, held: int = 1) -> DataFrame:
    """``<id_col>, held_out, score, predicted``, one row per row of ``docs``; only the text is looked at.

    ``score`` rises with the chance of label 1; null and empty texts score as texts without any known word. ``predicted`` is 1
    from 0.7. A null id is not held out. Further columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_scored(model), f"doc {rows.schema['doc'].dataType.simpleString()}, _score double")
    held_out = F.coalesce(remainder("doc", divisor) == held, F.lit(False))
    return out.select(F.col("doc").alias(id_col), held_out.alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.7, 1).otherwise(0).alias("predicted"))
