"""Document quality from a linear-chain conditional random field over lines.

Every non-empty line is good or bad. A line's score for bad is linear in binned measures of the line itself and of the lines
before and after it; pairs of neighbouring labels have weights too. The weights maximise the likelihood of the labels of
the learning documents, whose lines all bear the document's label. A document's measure is the mean of its lines'
forward-backward marginals for good, weighted by length; a logistic curve fitted on the learning documents turns it into
the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import bytesops as B
from gaugeline.llm.sampling import labelled, remainder

SAMPLE = 6000  # labelled documents used for fitting, at most
BINS = 6

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"$%&*#", b".,;:", b"?'\"()-", b"<>{}[]=/\\@~^_`+", bytes(range(128, 256)), b" "]
_CLASS = np.zeros((len(_CLASSES), 256), bool)
for _i, _set in enumerate(_CLASSES):
    _CLASS[_i, list(_set)] = True
MEASURES = len(_CLASSES) + 8


def lines(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all non-empty lines, their lengths, and per text the index of its first line."""
    data, n = block.data, len(block.data)
    edge = np.zeros(n + 1, bool)
    edge[block.starts] = True
    inside = data != 10
    starts = np.flatnonzero(inside & (edge[:n] | np.concatenate(([True], ~inside[:-1])))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1 if n else np.zeros(0, np.int64)
    first, size = np.searchsorted(starts, block.starts), ends - starts
    out = np.zeros((len(starts), MEASURES), np.float32)
    if not len(starts):
        return out, size, first
    for i, members in enumerate(_CLASS):
        total = np.concatenate(([0], np.cumsum(members[data])))
        out[:, i] = (total[ends] - total[starts]) / size
    at = len(_CLASSES)
    small = B.lower(data)
    p = B.prefix_hash(small)
    begins, stops, _ = B.word_spans(small, block.starts)
    hashes, line = B.span_hash(p, begins, stops), np.searchsorted(starts, begins, side="right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(np.float32)
    per = np.maximum(words, 1)
    order = np.lexsort((hashes, line))
    fresh = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1]))) if len(order) else np.zeros(0, bool)
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))) if len(order) else np.zeros(0, bool)
    capital = _CLASS[0][data[begins]] if len(begins) else np.zeros(0, bool)
    out[:, at] = np.log1p(size)
    out[:, at + 1] = np.log1p(words)
    out[:, at + 2] = size / per
    out[:, at + 3] = np.bincount(line[order][fresh], minlength=len(starts)) / per
    out[:, at + 4] = np.bincount(line[same], minlength=len(starts)) / per
    out[:, at + 5] = np.bincount(line[capital], minlength=len(starts)) / per
    whole = B.span_hash(p, starts, ends)
    text = np.searchsorted(block.starts, starts, side="right") - 1
    order = np.lexsort((whole, text))
    twin = (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1])
    out[order[1:][twin], at + 6] = 1
    out[order[:-1][twin], at + 6] = 1
    out[:, at + 7] = np.isin(data[ends - 1], np.frombuffer(b".!?\"", np.uint8))
    return out, size, first


@dataclass
class Field:
    """A fitted field: bin edges, weights by bin for the line and its neighbours, label-pair weights, and the final curve."""

    edges: np.ndarray  # (MEASURES, BINS - 1)
    weights: np.ndarray  # 3 * MEASURES * BINS + 3 for a missing neighbour and a constant
    pairs: np.ndarray  # (2, 2)
    curve: np.ndarray  # slope and constant
    empty: float  # score of a text without lines

    def active(self, measures: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Indices of the weights that hold for every line, one column after another."""
        n = len(measures)
        own = np.empty((n, MEASURES), np.int16, order="F")
        for m in range(MEASURES):
            own[:, m] = m * BINS + np.searchsorted(self.edges[m], measures[:, m], side="left")
        span, last = MEASURES * BINS, 3 * MEASURES * BINS
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        out = np.empty((n, 3 * MEASURES + 1), np.int16, order="F")
        for m in range(MEASURES):
            before, after = out[:, MEASURES + m], out[:, 2 * MEASURES + m]
            out[:, m], before[:1], after[-1:] = own[:, m], last, last + 1
            before[1:] = np.where(begins[1:n], last, own[:-1, m] + span)
            after[:-1] = np.where(begins[1:n], last + 1, own[1:, m] + 2 * span)
        out[:, -1] = last + 2
        return out

    def bad(self, active: np.ndarray) -> np.ndarray:
        """Every line's score for bad; column by column, so that no second array of that size is made."""
        total = np.zeros(len(active))
        for column in active.T:
            total += self.weights[column]
        return total

    def score(self, block: B.Block) -> np.ndarray:
        measures, size, first = lines(block)
        out = np.full(len(block), self.empty)
        if len(measures):
            bad, _, _ = marginals(self.bad(self.active(measures, first)), self.pairs, first)
            some = np.flatnonzero(first[1:] > first[:-1])
            good = np.add.reduceat((1 - bad) * size, first[some]) / np.add.reduceat(size, first[some])
            out[some] = _curve(good, self.curve)
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _curve(good: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(curve[0] * _logit(good) + curve[1])))


def marginals(bad: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(bad) of every line, expected label pairs, and log partition per text, by forward-backward over all texts at once."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    starts, count = first[:-1][order], count[order]
    n, top = len(bad), int(count[0]) if len(count) else 0
    unary = np.stack((np.zeros(n), bad), 1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    live = [starts[: int(np.searchsorted(-count, -t, side="left"))] + t for t in range(top)]  # texts with more than t lines
    if top:
        forward[live[0]] = unary[live[0]]
    for t in range(1, top):
        x = forward[live[t] - 1]
        forward[live[t]] = unary[live[t]] + np.logaddexp(x[:, :1] + pairs[0], x[:, 1:] + pairs[1])
    for t in range(top - 2, -1, -1):
        at = live[t][: len(live[t + 1])]
        x = unary[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(pairs[:, 0] + x[:, :1], pairs[:, 1] + x[:, 1:])
    whole = np.zeros(len(first) - 1)
    some = np.flatnonzero(first[1:] > first[:-1])
    last = first[1:][some] - 1
    whole[some] = np.logaddexp(forward[last, 0], forward[last, 1])
    z = np.repeat(whole, np.diff(first))
    p = np.exp(forward[:, 1] + backward[:, 1] - z)
    follows = np.ones(n, bool)
    follows[first[:-1][some]] = False
    at = np.flatnonzero(follows)
    both = forward[at - 1][:, :, None] + pairs + (unary[at] + backward[at])[:, None, :] - z[at, None, None]
    return p, np.exp(both).sum(0), whole


def fit(measures: np.ndarray, size: np.ndarray, count: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.1, penalty: float = 2.0) -> Field:
    """A field from the lines of the learning texts; ``count`` lines per text, ``label`` 1 for good texts.

    Without texts of both labels, every text scores the share of label 1 (0.5 if there is none).
    """
    share = float(label.mean()) if len(label) else 0.5
    field = Field(np.zeros((MEASURES, BINS - 1)), np.zeros(3 * MEASURES * BINS + 3), np.zeros((2, 2)), np.array([0.0, float(_logit(np.array(share)))]), share)
    if share in (0.0, 1.0) or not len(measures):
        return field
    field.edges = np.stack([np.quantile(measures[:, m], np.linspace(0, 1, BINS + 1)[1:-1]) for m in range(MEASURES)])
    # Measures that are nearly always 0 get bins over their other values.
    for m in range(MEASURES):
        other = measures[measures[:, m] > 0, m]
        if field.edges[m, -2] <= 0 and len(other):
            field.edges[m] = np.concatenate(([0.0], np.quantile(other, np.linspace(0, 1, BINS - 1)[1:-1]), [other.max()]))[: BINS - 1]
    first = np.concatenate(([0], np.cumsum(count)))
    active = field.active(measures, first)
    truth = np.repeat(1.0 - label, count)
    follows = np.ones(len(truth), bool)
    follows[first[:-1][count > 0]] = False
    at = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[at - 1].astype(int), truth[at].astype(int)), 1)
    n = len(count)
    m1, m2 = [np.zeros_like(field.weights), np.zeros((2, 2))], [np.zeros_like(field.weights), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        p, pairs, _ = marginals(field.bad(active), field.pairs, first)
        slope = penalty * field.weights
        for column in active.T:
            slope = slope + np.bincount(column, p - truth, len(field.weights))
        for i, g in enumerate((slope / n, (pairs - seen + penalty * field.pairs) / n)):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            move = rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
            if i == 0:
                field.weights = field.weights - move
            else:
                field.pairs = field.pairs - move
    p, _, _ = marginals(field.bad(active), field.pairs, first)
    some = np.flatnonzero(count > 0)
    good = np.add.reduceat((1 - p) * size, first[some]) / np.add.reduceat(size, first[some])
    x, y, curve = _logit(good), label[some], np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of a logistic regression with one input
        q = 1 / (1 + np.exp(-(curve[0] * x + curve[1])))
        g = np.array([((q - y) * x).sum() + 1e-2 * (curve[0] - 0.1), (q - y).sum()])
        w = q * (1 - q) + 1e-6
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        curve = curve - np.linalg.solve(h, g)
    field.curve = curve
    return field


def _measured(batches):
    for batch in batches:
        for block in B.blocks(batch.column("text")):
            measures, size, first = lines(block)
            cut = [measures[first[i] : first[i + 1]].tobytes() for i in range(len(block))]
            sizes = [size[first[i] : first[i + 1]].astype(np.int64).tobytes() for i in range(len(block))]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(block.row, len(block)), pa.array(cut, pa.binary()), pa.array(sizes, pa.binary())], ["label", "measures", "sizes"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", divisor: int = 4, held: int = 2, sample: int = SAMPLE) -> Field:
    """Fits on at most ``sample`` labelled documents whose crc32(id) mod ``divisor`` is not ``held``. Only their line measures reach the driver.

    Null and empty texts have no lines and count only for the share of label 1; rows of a null id are not learned from; repeated rows count as
    often as they occur. Without rows every text scores 0.5. Runs jobs.
    """
    chosen = F.broadcast(labelled(labels, id_col, label_col, divisor, held, sample))  # at most ``sample`` rows
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).join(chosen, "doc")
    got = rows.select("text", "label").mapInArrow(_measured, "label int, measures binary, sizes binary").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (got["label"].iat[i], got["measures"].iat[i]))]  # the same order in every run
    measures = np.frombuffer(b"".join(got["measures"]), np.float32).reshape(-1, MEASURES)
    size = np.frombuffer(b"".join(got["sizes"]), np.int64)
    return fit(measures, size, got["sizes"].map(len).to_numpy(dtype=np.int64) // 8, got["label"].to_numpy(dtype=float))


def _scored(field: Field):
    def run(batches):
        for batch in batches:
            score = [field.score(block) for block in B.blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())], ["doc", "_score"])

    return run


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4, held: int = 2) -> DataFrame:
    """``<id_col>, held_out, score, predicted``, one row per row of ``docs``; only the text is looked at.

    ``score`` rises with the chance of label 1; null and empty texts and texts of line breaks only score the learning rows'
    share of label 1. ``predicted`` is 1 from 0.7. A null id is not held out. Further columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_scored(field), f"doc {rows.schema['doc'].dataType.simpleString()}, _score double")
    held_out = F.coalesce(remainder("doc", divisor) == held, F.lit(False))
    return out.select(F.col("doc").alias(id_col), held_out.alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.7, 1).otherwise(0).alias("predicted"))
