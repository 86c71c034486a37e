"""Regression trees for many models at once.

All trees of a task grow together, level by level, with numpy: one pass over the task's rows serves all open nodes of all its trees. A model
of up to ``LOCAL`` rows is grown in grouped tasks, some trees in each. A larger one is first split by Spark: one aggregate per
level over (tree, node, feature, bin) for all open nodes, until a node has at most ``LOCAL`` rows; these nodes are then grown in
grouped tasks like small models. Jobs grow with the depth of the upper part, not with trees, models or entities.

``best`` splits try every value of every feature (in the upper part every ``1 / BINS`` quantile); ``random`` splits try one cut per node and
feature, drawn from the node's own range by a seeded hash. Rows are drawn by a hash of row and tree, as often as Poisson's law
says, so a repeated task draws the same ones.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Send the functions themselves to the workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOCAL = 1 << 18  # rows of a node that one task grows on
BINS = 256  # candidate cuts per feature in the upper part of large models
NODES = 1024  # open nodes per aggregate; further ones wait for the next
DEPTH = 60  # of the upper part at most
ENTRIES = 1 << 20  # rows times trees that grow together in one task


@dataclass(frozen=True)
class Growth:
    """How an ensemble is grown. ``splits``: ``best`` or ``random``; ``drawn``: each tree sees a random draw of the rows."""

    trees: int = 20
    splits: str = "best"
    drawn: bool = True
    depth: int | None = None
    least: int = 1  # rows on either side of a split
    seed: int = 42


@dataclass
class Trees:
    """Nodes of several trees in one table; leaves have feature -1. ``roots``: the first node of each tree."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees of each row's value."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            going = np.arange(len(x))
            while len(going):
                going = going[self.feature[at[going]] >= 0]
                node = at[going]
                lower = x[going, self.feature[node]] <= self.cut[node]
                at[going] = np.where(lower, self.left[node], self.right[node])
            total += self.value[at]
        return total


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(*keys) -> np.ndarray:
    """A number in [0, 1) for each combination of whole numbers."""
    out = np.uint64(0x9E3779B97F4A7C15)
    for k in keys:
        out = _mix(out + np.asarray(k).astype(np.int64).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
    return (out >> np.uint64(11)).astype(float) / 2.0**53


def drawn_weights(row: np.ndarray, tree: int, growth: Growth) -> np.ndarray:
    """How often a tree sees each row: Poisson with mean 1; all rows once if none would be drawn or nothing is to be drawn."""
    if not growth.drawn:
        return np.ones(len(row))
    share = np.exp(-1) * np.cumsum(1 / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 16)))))
    return np.searchsorted(share, _uniform(row, tree, growth.seed), side="right").astype(float)


def whole(y: np.ndarray, most: float, rows: float) -> np.ndarray:
    """Labels as whole multiples of a power of two, so small that sums over ``rows`` of them are exact in whatever order they are taken.

    Cuts that part the rows in the same way then have the same gain, and the first of them is always taken.
    """
    bits = 51 - int(np.ceil(np.log2(max(rows, 1) + 1)))
    return np.rint(y / 2.0 ** (int(np.ceil(np.log2(max(most, 1e-300)))) - bits))


def grow(x: np.ndarray, y: np.ndarray, row: np.ndarray, trees: range, growth: Growth, base: int = 0, root: int = 1) -> Trees:
    """Trees number ``trees`` on the given rows. ``base`` levels lie above these rows already, below which they are node ``root``."""
    order = np.argsort(row, kind="stable")  # whatever order rows arrive in, sums are taken in the same one
    x, y, row = x[order], y[order], row[order]
    which, weight = [], []
    for t in trees:
        w = drawn_weights(row, t, growth)
        if not w.any():
            w = np.ones(len(row))
        some = np.flatnonzero(w)
        which.append(some)
        weight.append(w[some])
    sizes = np.array([len(w) for w in which])
    r, w = np.concatenate(which), np.concatenate(weight)
    node = np.repeat(np.arange(len(sizes)), sizes)
    path = _mix(np.array(list(trees), np.int64).astype(np.uint64) + np.uint64(root) * np.uint64(0x9E3779B97F4A7C15))
    limit = np.inf if growth.depth is None else growth.depth - base
    best = growth.splits == "best"
    orders = [np.arange(len(r))]
    if best:
        orders = []
        for f in range(x.shape[1]):
            rank = np.empty(len(x), np.int64)
            rank[np.argsort(x[:, f], kind="stable")] = np.arange(len(x))
            orders.append(np.lexsort((rank[r], node)))
    exact = whole(y, np.abs(y).max(), w.sum())
    exact -= np.rint(exact.mean())
    out, first, level = [], 0, 0
    while len(sizes):
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        wy = w * exact[r]
        # Entries lie in the order of nodes.
        n, s = np.add.reduceat(w, starts), np.add.reduceat(wy, starts)
        low, high = np.minimum.reduceat(y[r], starts), np.maximum.reduceat(y[r], starts)
        pure = low == high
        value = np.where(pure, low, np.add.reduceat(w * y[r], starts) / n)
        feature, cut = _best(x, y, r, w, wy, node, orders, starts, n, s, growth) if best else _random(x, r, w, wy, node, starts, n, s, path, growth)
        feature[pure | (level >= limit)] = -1
        split = feature >= 0
        children = np.cumsum(split) - 1
        left = np.where(split, first + len(sizes) + 2 * children, -1)
        out.append((feature, np.where(split, cut, 0.0), left, np.where(split, left + 1, -1), value))
        first, level = first + len(sizes), level + 1
        keep = split[node]
        lower = np.zeros(len(r), bool)
        lower[keep] = x[r[keep], feature[node[keep]]] <= cut[node[keep]]
        new = np.where(keep, 2 * children[node] + ~lower, -1)
        sizes = np.bincount(new[keep], minlength=2 * int(split.sum()))
        path = _mix(np.repeat(path[split], 2) * np.uint64(2) + np.tile(np.array([0, 1], np.uint64), int(split.sum())))
        ends = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
        # Entries are put in the order of the new nodes; every feature's order is parted in the same way, so nothing is sorted again.
        place = np.full(len(r), -1)
        at = np.flatnonzero(keep)
        place[at] = _parted(new[at], ends)
        orders = [o[keep[o]] for o in orders]
        moved = []
        for o in orders:
            now = np.empty(len(o), np.int64)
            now[_parted(new[o], ends)] = place[o]
            moved.append(now)
        orders = moved if best else [np.arange(len(at))]
        back = np.empty(len(at), np.int64)
        back[place[at]] = at
        r, w, node = r[back], w[back], new[back]
    columns = [np.concatenate(c) for c in zip(*out)]
    return Trees(np.arange(len(trees)), columns[0].astype(np.int32), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4])


def _parted(new: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of entries, whose old nodes lie one behind the other, in the order of their new nodes, otherwise unchanged."""
    if not len(new):
        return np.zeros(0, np.int64)
    second = (new & 1).astype(bool)
    ones = np.cumsum(second)
    zeros = np.arange(1, len(new) + 1) - ones
    pair = new >> 1
    first = np.concatenate(([True], pair[1:] != pair[:-1]))
    ahead = np.maximum.accumulate(np.where(first, np.arange(len(new)), 0))
    ones_before = np.where(ahead > 0, ones[ahead - 1], 0)
    zeros_before = np.where(ahead > 0, zeros[ahead - 1], 0)
    return ends[new] + np.where(second, ones - ones_before, zeros - zeros_before) - 1


def _gain(nl, sl, n, s, least):
    nr, sr = n - nl, s - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sl * sl / nl + sr * sr / nr
    return np.where((nl >= least) & (nr >= least) & (nl > 0) & (nr > 0), gain, -np.inf)


def _best(x, y, r, w, wy, node, orders, starts, n, s, growth):
    top = np.full(len(starts), -np.inf)
    feature, cut = np.full(len(starts), -1), np.zeros(len(starts))
    before = lambda c: np.where(starts > 0, c[starts - 1], 0.0)
    last = np.concatenate((starts[1:], [len(r)])) - 1
    for f, o in enumerate(orders):
        v, own = x[r[o], f], node[o]
        cw, cs = np.cumsum(w[o]), np.cumsum(wy[o])
        gain = _gain(cw - before(cw)[own], cs - before(cs)[own], n[own], s[own], growth.least)
        same = np.concatenate((v[1:] <= v[:-1], [True]))
        same[last] = True  # no cut between equal values or behind a node's last row
        gain[same] = -np.inf
        most = np.maximum.reduceat(gain, starts)
        at = np.minimum.reduceat(np.where(gain == most[own], np.arange(len(o)), len(o)), starts)
        better = most > top
        p = at[better]
        middle = v[p] + (v[p + 1] - v[p]) / 2
        top[better], feature[better], cut[better] = most[better], f, np.where(middle < v[p + 1], middle, v[p])
    return feature, cut


def _random(x, r, w, wy, node, starts, n, s, path, growth):
    v = x[r]
    low, high = np.minimum.reduceat(v, starts, axis=0), np.maximum.reduceat(v, starts, axis=0)
    cut = random_cuts(low, high, path, growth.seed)
    lower = v <= cut[node]
    gain = _gain(np.add.reduceat(lower * w[:, None], starts, axis=0), np.add.reduceat(lower * wy[:, None], starts, axis=0), n[:, None], s[:, None], growth.least)
    gain[low == high] = -np.inf
    feature = gain.argmax(1)
    rows = np.arange(len(starts))
    return np.where(np.isfinite(gain[rows, feature]), feature, -1), cut[rows, feature]


def random_cuts(low: np.ndarray, high: np.ndarray, path: np.ndarray, seed: int) -> np.ndarray:
    """(node, feature): one cut from each node's own range of each feature."""
    at = _uniform(path[:, None].astype(np.int64), np.arange(low.shape[1])[None, :], seed)
    cut = low + at * (high - low)
    return np.where(cut < high, cut, low)


# --- the upper part of large models -----------------------------------------------------------------------


@dataclass
class Upper:
    """Splits found so far of one ensemble: per tree ``node -> (feature, cut)``, root 1, children 2 i and 2 i + 1."""

    splits: list[dict[int, tuple[int, float]]]

    def route(self, tree: int, x: np.ndarray) -> np.ndarray:
        at, splits = np.ones(len(x), np.int64), self.splits[tree]
        if not splits:
            return at
        nodes = np.array(sorted(splits))
        features = np.array([splits[i][0] for i in nodes.tolist()])
        cuts = np.array([splits[i][1] for i in nodes.tolist()])
        going = np.arange(len(x))
        while len(going):
            k = np.minimum(np.searchsorted(nodes, at[going]), len(nodes) - 1)
            inner = nodes[k] == at[going]
            going, k = going[inner], k[inner]
            at[going] = 2 * at[going] + (x[going, features[k]] > cuts[k])
        return at


def matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _open_rows(batch, width, upper, growth, todo):
    """For each tree with nodes to do: their number, rows, weights and labels."""
    x, y, row = matrix(batch.column("x"), width), batch.column("y").to_numpy(zero_copy_only=False), batch.column("row").to_numpy(zero_copy_only=False)
    for tree in sorted({t for t, _ in todo}):
        own = np.array(sorted(n for t, n in todo if t == tree))
        numbers = np.array([todo[tree, n] for n in own.tolist()])
        at = upper.route(tree, x)
        k = np.minimum(np.searchsorted(own, at), len(own) - 1)
        w = drawn_weights(row, tree, growth)
        some = np.flatnonzero((own[k] == at) & (w > 0))
        if len(some):
            yield numbers[k[some]], x[some], w[some], y[some]


def _ranges(width, shared, growth, todo):
    def run(batches):
        low, high = np.full((len(todo), width), np.inf), np.full((len(todo), width), -np.inf)
        for batch in batches:
            for number, x, _, _ in _open_rows(batch, width, shared.value, growth, todo):
                np.minimum.at(low, number, x)
                np.maximum.at(high, number, x)
        some = np.flatnonzero(np.isfinite(low[:, 0]))
        k, f = (i.ravel() for i in np.meshgrid(some, np.arange(width), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(low[k, f]), pa.array(high[k, f])], ["number", "feature", "low", "high"])

    return run


def _counts(width, shared, growth, todo, cuts, most, total):
    """Rows and sums of labels per (node, feature, bin); ``cuts``: per feature, or per node and feature."""
    bins = cuts.shape[-1] + 1

    def run(batches):
        n, s = np.zeros((len(todo), width, bins)), np.zeros((len(todo), width, bins))
        for batch in batches:
            for number, x, w, y in _open_rows(batch, width, shared.value, growth, todo):
                y = whole(y, most, total)
                for f in range(width):
                    b = np.searchsorted(cuts[f], x[:, f]) if cuts.ndim == 2 else (x[:, f] > cuts[number, f, 0]).astype(int)
                    key = number * bins + b
                    n[:, f] += np.bincount(key, w, len(todo) * bins).reshape(-1, bins)
                    s[:, f] += np.bincount(key, w * y, len(todo) * bins).reshape(-1, bins)
        k, f, b = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(b), pa.array(n[k, f, b]), pa.array(s[k, f, b])], ["number", "feature", "bin", "n", "s"])

    return run


def upper_part(rows: DataFrame, growth: Growth, width: int, local: int | None = None) -> Upper:
    """The splits above all nodes that hold at most ``local`` rows, for ``rows (row, x, y)`` of one model. Runs up to two jobs per level."""
    spark, local = rows.sparkSession, local or LOCAL
    upper = Upper([{} for _ in range(growth.trees)])
    size = rows.agg(F.count("*").alias("n"), F.max(F.abs("y")).alias("most")).first()
    if size["n"] <= local:
        return upper
    # Quantiles for best splits: one row with BINS numbers per feature.
    if growth.splits == "best":
        points = [i / BINS for i in range(1, BINS)]
        exprs = [F.percentile_approx(F.get("x", F.lit(f)), points, 20 * BINS).alias(f"q{f}") for f in range(width)]
        quantiles = rows.agg(*exprs).first()
        fixed = np.full((width, BINS - 1), np.inf)
        for f in range(width):
            own = np.unique(np.array(quantiles[f"q{f}"], float))
            fixed[f, : len(own)] = own
    waiting = [(t, 1) for t in range(growth.trees)]
    while waiting:
        now, waiting = waiting[:NODES], waiting[NODES:]
        todo = {node: i for i, node in enumerate(now)}
        shared = spark.sparkContext.broadcast(upper)
        if growth.splits == "best":
            cuts = fixed
        else:
            spans = rows.mapInArrow(_ranges(width, shared, growth, todo), "number long, feature long, low double, high double")
            low, high = np.zeros((len(now), width)), np.zeros((len(now), width))
            for r in spans.groupBy("number", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # NODES x features
                low[r["number"], r["feature"]], high[r["number"], r["feature"]] = r["low"], r["high"]
            path = _mix(np.array([t for t, _ in now], np.uint64) + np.array([n for _, n in now], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            cuts = random_cuts(low, high, path, growth.seed)[:, :, None]
        bins = rows.mapInArrow(_counts(width, shared, growth, todo, cuts, size["most"], size["n"] * 8.0), "number long, feature long, bin long, n double, s double")
        bins = bins.groupBy("number", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        found = bins.groupBy("number").applyInArrow(_chosen(cuts, growth), "number long, feature long, cut double, left_rows double, right_rows double")
        for r in found.collect():  # one row per open node
            tree, node = now[r["number"]]
            upper.splits[tree][node] = (r["feature"], r["cut"])
            depth = node.bit_length()
            if depth < DEPTH and (growth.depth is None or depth < growth.depth):
                waiting += [(tree, 2 * node + side) for side, n in ((0, r["left_rows"]), (1, r["right_rows"])) if n > local]
        waiting.sort(key=lambda w: w[1])
    return upper


def _chosen(cuts, growth):
    def run(table: pa.Table) -> pa.Table:
        number = table["number"][0].as_py()
        feature, b = table["feature"].to_numpy(), table["bin"].to_numpy()
        order = np.lexsort((b, feature))
        feature, b, n, s = feature[order], b[order], table["n"].to_numpy()[order], table["s"].to_numpy()[order]
        starts = np.flatnonzero(np.diff(feature, prepend=-1))
        own = np.cumsum(np.diff(feature, prepend=-1) > 0) - 1
        cn, cs = np.cumsum(n), np.cumsum(s)
        nl, sl = cn - np.where(starts > 0, cn[starts - 1], 0)[own], cs - np.where(starts > 0, cs[starts - 1], 0)[own]
        all_n, all_s = np.add.reduceat(n, starts)[own], np.add.reduceat(s, starts)[own]
        gain = _gain(nl, sl, all_n, all_s, growth.least)
        gain[np.concatenate((starts[1:], [len(n)])) - 1] = -np.inf
        i = int(gain.argmax())
        out = [[], [], [], [], []]
        if np.isfinite(gain[i]):
            at = cuts[feature[i], b[i]] if cuts.ndim == 2 else cuts[number, feature[i], 0]
            out = [[number], [int(feature[i])], [float(at)], [float(nl[i])], [float(all_n[i] - nl[i])]]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(("number", "feature", "cut", "left_rows", "right_rows"), out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))})

    return run


# --- one ensemble as a table of pieces --------------------------------------------------------------------

PIECE = "tree int, node long, roots array<long>, feature array<int>, cut array<double>, left array<long>, right array<long>, value array<double>"


def pieces(rows: DataFrame, growth: Growth, width: int, local: int | None = None) -> tuple[Upper, DataFrame]:
    """The upper part, and one row per group of trees and node below it. ``rows (row, x, y)`` are read several times. Runs jobs."""
    upper = upper_part(rows, growth, width, local)
    shared = rows.sparkSession.sparkContext.broadcast(upper)
    together = _chunk(rows.count(), growth.trees)

    def place(batches):
        for batch in batches:
            x, row = matrix(batch.column("x"), width), batch.column("row").to_numpy(zero_copy_only=False)
            for tree in range(growth.trees):
                if any(shared.value.splits):
                    some = np.flatnonzero(drawn_weights(row, tree, growth))
                    node = shared.value.route(tree, x[some])
                elif tree % together == 0:  # small: rows go once to each group of trees, which draws for itself
                    some, node = np.arange(len(row)), np.ones(len(row), np.int64)
                else:
                    continue
                own = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), tree, np.int32)), pa.array(node), *[own.column(c) for c in ("row", "x", "y")]], ["tree", "node", "row", "x", "y"])

    def finish(table: pa.Table) -> pa.Table:
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        numbers = range(tree, min(tree + together, growth.trees)) if not any(shared.value.splits) else range(tree, tree + 1)
        grown = grow(matrix(table["x"], width), table["y"].to_numpy(), table["row"].to_numpy(), numbers, growth, node.bit_length() - 1, node)
        made = [[tree], [node], [grown.roots], [grown.feature], [grown.cut], [grown.left], [grown.right], [grown.value]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(PIECE.split(", "), made, kinds)})

    dealt = rows.mapInArrow(place, "tree int, node long, row long, x array<double>, y double")
    if not any(upper.splits):
        dealt = dealt.repartition(2 * -(-growth.trees // together), "tree", "node")  # few heavy groups
    return upper, dealt.groupBy("tree", "node").applyInArrow(finish, PIECE)


def _chunk(rows: int, trees: int) -> int:
    """Trees that grow together: at most ``ENTRIES`` rows of theirs, and at least eight groups of trees where there are as many."""
    return max(1, min(-(-trees // 8), ENTRIES // max(rows, 1)))


def trees_of(piece) -> Trees:
    return Trees(*[np.asarray(piece[c]) for c in ("roots", "feature", "cut", "left", "right", "value")])


def sent_scorer(shared, count: int):
    """A function of a column of arrays for an ensemble that was sent to all tasks as ``(upper, {(tree, node): Trees})``."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        upper, found = shared.value
        if not len(values):
            return pd.Series([], dtype="float64")
        x, total = np.stack(values.to_list()).astype(float), np.zeros(len(values))
        for tree in sorted({t for t, _ in found}):
            node = upper.route(tree, x)
            for n in np.unique(node).tolist():
                own = np.flatnonzero(node == n)
                total[own] += found[tree, n].predict(x[own])
        return pd.Series(total / count)

    return score


def joined_scores(rows: DataFrame, upper: Upper, table: DataFrame, width: int, count: int) -> DataFrame:
    """``row, predict`` for ``rows (row, x)`` and an ensemble too large to send: rows meet each tree's piece in a task of its own."""
    shared = rows.sparkSession.sparkContext.broadcast(upper)
    starts = sorted({r["tree"] for r in table.select("tree").distinct().collect()})  # at most one per tree

    def place(batches):
        for batch in batches:
            x = matrix(batch.column("x"), width)
            for tree in starts:
                node = shared.value.route(tree, x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(node), *batch.columns], ["tree", "node", *batch.schema.names])

    def score(asked: pa.Table, piece: pa.Table) -> pa.Table:
        if not asked.num_rows or not piece.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "part": pa.array([], pa.float64())})
        trees = Trees(*[piece[c].combine_chunks().flatten().to_numpy() for c in ("roots", "feature", "cut", "left", "right", "value")])
        return pa.table({"row": asked["row"], "part": pa.array(trees.predict(matrix(asked["x"], width)))})

    dealt = rows.select("row", "x").mapInArrow(place, "tree int, node long, row long, x array<double>")
    parts = dealt.groupBy("tree", "node").cogroup(table.groupBy("tree", "node")).applyInArrow(score, "row long, part double")
    return parts.groupBy("row").agg((F.sum("part") / count).alias("predict"))


# --- many small models in one job -------------------------------------------------------------------------


@dataclass(frozen=True)
class Work:
    """One ensemble over some of a table's feature columns. ``coded``: columns whose values count by their order among the model's rows."""

    name: str
    columns: tuple[int, ...]
    growth: Growth
    scaled: bool = False
    coded: tuple[int, ...] = ()


def shares(work: list[Work], at_once: int) -> list[list[tuple[int, range]]]:
    """The trees of all ensembles dealt out to tasks: ``(index of the ensemble, numbers of its trees)`` for each task, ``at_once`` trees each."""
    out, room = [[]], at_once
    for i, w in enumerate(work):
        first = 0
        while first < w.growth.trees:
            if room == 0:
                out.append([])
                room = at_once
            n = min(room, w.growth.trees - first)
            out[-1].append((i, range(first, first + n)))
            first, room = first + n, room - n
    return out


def _encoded(train: np.ndarray, test: np.ndarray, w: Work):
    """Codes as positions among the training values, -1 for others; then standard scores where asked for."""
    a, b = train[:, w.columns].copy(), test[:, w.columns].copy()
    for c in w.coded:
        at = w.columns.index(c)
        known = np.unique(a[:, at])
        a[:, at] = np.searchsorted(known, a[:, at])
        place = np.minimum(np.searchsorted(known, b[:, at]), len(known) - 1)
        b[:, at] = np.where(known[place] == b[:, at], place, -1)
    if w.scaled:
        mean, spread = a.mean(0), a.std(0)
        spread = np.where(spread > 0, spread, 1.0)
        a, b = (a - mean) / spread, (b - mean) / spread
    return a, b


def fit_predict(rows: DataFrame, model: list[str], work: list[Work], width: int, at_once: int = 8, tasks: int | None = None) -> DataFrame:
    """``model, work, row, predict`` for every row to predict, with one ensemble per model and entry of ``work``; one shuffle, lazy.

    ``rows (model..., row, x, y, test)``: ``x`` holds ``width`` doubles, null or NaN where unknown; rows with an unknown feature of an
    ensemble, and training rows with an unknown ``y``, take no part in it. A model's rows are gathered in as many tasks as its trees
    need, so every model must be small enough for a task (``LOCAL`` rows). A model without training rows predicts nothing.
    """
    dealt = shares(work, at_once)
    keys = [rows.schema[m] for m in model]
    shape = ", ".join([f"`{k.name}` {k.dataType.simpleString()}" for k in keys] + ["work int, row long, total double"])

    def run(table: pa.Table) -> pa.Table:
        x, y = matrix(table["x"], width), table["y"].to_numpy(zero_copy_only=False).astype(float)
        row, test = table["row"].to_numpy(), table["test"].to_numpy(zero_copy_only=False).astype(bool)
        named, found, total = [], [], []
        for i, numbers in dealt[table["share"][0].as_py()]:
            w = work[i]
            whole = np.isfinite(x[:, w.columns]).all(1)
            a, b = np.flatnonzero(whole & ~test & np.isfinite(y)), np.flatnonzero(whole & test)
            if not len(a) or not len(b):
                continue
            seen, asked = _encoded(x[a], x[b], w)
            sums, most = np.zeros(len(b)), max(1, ENTRIES // len(a))
            for first in range(numbers.start, numbers.stop, most):
                some = range(first, min(first + most, numbers.stop))
                sums += grow(seen, y[a], row[a], some, w.growth).predict(asked)
            named.append(np.full(len(b), i, np.int32))
            found.append(row[b])
            total.append(sums)
        n = sum(map(len, found))
        out = {m: table[m].combine_chunks().take(pa.array(np.zeros(n, np.int64))) for m in model}
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({**out, "work": join(named, pa.int32()), "row": join(found, pa.int64()), "total": join(total, pa.float64())})

    copies = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(len(dealt) - 1))))
    if tasks is not None:  # a fixed number: groups are few and heavy, adaptive execution would put them together by their bytes
        copies = copies.repartition(tasks, *model, "share")
    sums = copies.groupBy(*model, "share").applyInArrow(run, shape)
    counts = F.element_at(F.array(*[F.lit(float(w.growth.trees)) for w in work]), F.col("work") + 1)
    return sums.groupBy(*model, "work", "row").agg(F.sum("total").alias("total")).withColumn("predict", F.col("total") / counts).drop("total")

