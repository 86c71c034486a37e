"""Nearest neighbours by largest inner product over balanced posting lists.

The largest inner product becomes the smallest distance once every vector ``x`` gets one more component ``sqrt(M^2 - |x|^2)``, with M the largest
norm, and every query a zero. The centroids of the lists, at most ``LISTS`` but for splits, come from a bounded sample by k-means that splits lists
which grow too large; lists near a vector are found through a graph of near centroids held in memory, best first. A vector is written to its
nearest list and, if it lies near a boundary, to further lists whose distance is within a ratio of the least, unless a list chosen
before lies nearer to that list than the vector does.

A query reads the lists within a ratio of its ninth nearest list's distance (the first may be its own), and further lists in the order of
their distance until they hold enough vectors for ``k`` neighbours. The ratio is fitted: within the sample, it reaches ``REACH`` of the true
neighbours of sampled queries, so it is small where vectors lie in clusters and large where they have no structure. The graph finds these lists
unless they are a large share of all, in which case all centroids are compared.

Lists are read in two rounds. The first ``FIRST`` lists of a query give its k-th score so far; the others return only what is above that,
and lists whose centroid and radius cannot hold such a vector are not read at all.

Lists are read in blocks of a bounded size, so a long list is several tasks. Equal vectors are indexed once, with the ids that can be
among the nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm import vectors as V
from gaugeline.session import materialize

LIST = 128  # vectors per list aimed at
LISTS = V.SAMPLE // 4  # at most, so that the centroids fit in every task
REPLICAS, BOUNDARY = 4, 1.15  # lists per vector at most, and the ratio of distances up to which it is replicated
FLOOR = 8  # distances are told by the list that has so many nearer ones
REACH, ASKED = 0.97, 256  # share of the sample's true neighbours that the ratio reaches, and queries it is fitted with
FIRST = 16  # lists of a query that are read first
DEGREE, BACK, BEAM = 24, 8, 32
BLOCK = 4096


def balanced_kmeans(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Centroids of about ``k`` lists; lists with more than twice the mean are split in two again and again."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = max(1, min(k, len(x)))
    most = max(2, 2 * len(x) // k)

    def means(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        centre = rows[rng.choice(len(rows), k, replace=False)]
        for _ in range(8):
            home = _nearest(rows, centre)
            total, n = np.zeros_like(centre), np.bincount(home, minlength=k)
            np.add.at(total, home, rows)
            centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rows[rng.choice(len(rows), k)])
        return centre, _nearest(rows, centre)

    centre, home = means(x, k)
    todo, out = [x[home == i] for i in range(k)], []
    while todo:
        rows = todo.pop()
        if len(rows) > most:
            _, side = means(rows, 2)
            if 0 < side.sum() < len(rows):
                todo += [rows[side == 0], rows[side == 1]]
                continue
        if len(rows):
            out.append(rows.mean(0))
    return np.array(out)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _nearest(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, in parts, as a row per vector and a column per centroid would be large."""
    return np.concatenate([_distance(rows[part : part + V.PART], centre).argmin(1) for part in range(0, len(rows), V.PART)])


@dataclass
class Graph:
    """Centroids, each with edges to near centroids, to some that it is near to, and two to places far off."""

    centre: np.ndarray
    edges: np.ndarray

    @staticmethod
    def of(centre: np.ndarray) -> Graph:
        n = len(centre)
        degree = min(DEGREE, max(n - 1, 1))
        edges = np.zeros((n, degree + 2), np.int64)
        rng = np.random.default_rng(1)
        for part in range(0, n, 512):
            d = _distance(centre[part : part + 512], centre)
            d[np.arange(len(d)), np.arange(part, part + len(d))] = np.inf if n > 1 else 0
            edges[part : part + 512, :degree] = np.argsort(d, axis=1)[:, :degree]
        edges[:, degree:] = rng.integers(0, n, (n, 2))
        # Few centroids have edges to one that lies apart: its nearest ones get an edge back, those with the fewest edges to them first.
        back, used = np.repeat(np.arange(n)[:, None], BACK, 1), np.zeros(n, np.int64)
        for i in np.argsort(np.bincount(edges[:, :degree].ravel(), minlength=n), kind="stable").tolist():
            given = 0
            for j in edges[i, :degree].tolist():
                if given < BACK // 2 and used[j] < BACK and j != i:
                    back[j, used[j]] = i
                    used[j] += 1
                    given += 1
        return Graph(centre, np.concatenate((edges, back), 1))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids of each row, nearest first, with distances: a best-first walk for all rows in step."""
        n, b = len(self.centre), min(beam, len(self.centre))
        rows = np.arange(len(x))[:, None]
        norm = (self.centre * self.centre).sum(1)
        own = (x * x).sum(1)[:, None]
        near = lambda at: np.maximum(own + norm[at] - 2 * np.einsum("rd,rkd->rk", x, self.centre[at]), 0)
        entry = np.unique(np.linspace(0, n - 1, min(n, max(b, 64))).astype(int))
        ids = np.repeat(entry[None, :], len(x), 0)
        seen = np.zeros((len(x), n), bool)
        seen[:, entry] = True
        dist = near(ids)
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :b]
            ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
            open_ = np.where(done | ~np.isfinite(dist), np.inf, dist)
            pick = np.argsort(open_, axis=1)[:, :4]
            live = np.isfinite(open_[rows, pick])
            if not live.any():
                return ids, np.sqrt(dist)
            done[rows, pick] = True
            more = np.where(live[:, :, None], self.edges[ids[rows, pick]], 0).reshape(len(x), -1)
            fresh = ~seen[rows, more] & np.repeat(live, self.edges.shape[1], 1)
            seen[rows, more] = True
            # The same centroid can come from two edges: only its first place counts.
            order = np.argsort(more, axis=1, kind="stable")
            twin = np.zeros(more.shape, bool)
            twin[rows, order[:, 1:]] = more[rows, order[:, 1:]] == more[rows, order[:, :-1]]
            fresh &= ~twin
            ids, done = np.concatenate((ids, more), 1), np.concatenate((done, ~fresh), 1)
            dist = np.concatenate((dist, np.where(fresh, near(more), np.inf)), 1)


def lift(x: np.ndarray, top: float, query: bool = False) -> np.ndarray:
    """Vectors with one component more, scaled to length 1; the nearest to a query has the largest inner product with it."""
    x = V.unit(x) if query else x / top
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
    return np.concatenate((x, more[:, None]), 1)


def lists_of(x: np.ndarray, graph: Graph) -> list[np.ndarray]:
    """The lists each lifted vector is written to."""
    ids, dist = graph.search(x)
    out = []
    for row, d in zip(ids, dist):
        chosen = [int(row[0])]
        for c, far in zip(row[1:].tolist(), d[1:].tolist()):
            if len(chosen) == REPLICAS or far > BOUNDARY * d[0]:
                break
            if all(np.sqrt(((graph.centre[c] - graph.centre[o]) ** 2).sum()) >= far for o in chosen):
                chosen.append(c)
        out.append(np.array(chosen))
    return out


def ratio_of(sample: np.ndarray, top: float, graph: Graph, k: int, seed: int = 7) -> float:
    """The ratio of distances within which ``REACH`` of the ``k`` nearest vectors of sampled queries have a list, all within the sample."""
    rng = np.random.default_rng(seed)
    asked = np.sort(rng.choice(len(sample), min(ASKED, len(sample)), replace=False))
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    some, back = np.unique(near, return_inverse=True)
    lists = [c for part in range(0, len(some), V.PART) for c in lists_of(lift(sample[some[part : part + V.PART]], top), graph)]
    dist = np.sqrt(_distance(lift(sample[asked], top, query=True), graph.centre))
    ref = np.maximum(_reference(np.sort(dist, axis=1)), 1e-12)
    back = back.reshape(near.shape)
    needed = [min(dist[i, c] for c in lists[j]) / ref[i] for i, row in enumerate(back) for j in row]
    return max(1.0, float(np.quantile(needed, REACH)))


def _reference(ordered: np.ndarray) -> np.ndarray:
    """Of each row of ascending distances the one that tells which others are near."""
    return ordered[:, min(FLOOR, ordered.shape[1] - 1)]


def probes(x: np.ndarray, graph: Graph, ratio: float, held: np.ndarray | None = None, least: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """The lists each lifted query reads, nearest first, and their distances. By ``held`` vectors per list, they hold ``least`` together or are all."""
    n, out = len(graph.centre), [None] * len(x)
    enough = lambda ids: held is None or held[ids].sum() >= least
    open_ = np.arange(len(x))
    if n > 32 * BEAM:  # the graph, where the lists wanted are at most an eighth of what it goes through, so that it misses few
        ids, dist = graph.search(x, 16 * BEAM)
        far = ratio * _reference(dist) + 1e-12
        for i in open_.tolist():
            inside = int(np.searchsorted(dist[i], far[i], side="right"))
            if 8 * inside <= len(ids[i]) and enough(ids[i][:inside]):
                out[i] = ids[i][:inside], dist[i][:inside]
        open_ = np.array([i for i in open_ if out[i] is None], np.int64)
    if len(open_):
        every = np.sqrt(_distance(x[open_], graph.centre))
        order = np.argsort(every, axis=1, kind="stable")
        dist = np.take_along_axis(every, order, 1)
        far = ratio * _reference(dist) + 1e-12
        for i, ids, d, f in zip(open_.tolist(), order, dist, far):
            inside = int(np.searchsorted(d, f, side="right"))
            if not enough(ids[:inside]):
                inside = max(inside, int(np.searchsorted(np.cumsum(held[ids]), least)) + 1)
            out[i] = ids[:inside], d[:inside]
    return out


@dataclass
class Index:
    """Lists of vectors of one length: where they lie, the largest norm, the fitted ratio; then what each list holds and how far it reaches."""

    graph: Graph
    top: float
    ratio: float
    held: np.ndarray
    radius: np.ndarray


def _lists(dim: int, numbers: np.ndarray) -> np.ndarray:
    return (np.int64(dim) << 32) + numbers


def _blocks(batches, columns):
    """``dim, rows, vectors`` of up to 512 rows of one length."""
    for batch in batches:
        vector = batch.column("vector").to_pylist()
        dims = np.array([len(v) // 8 for v in vector], np.int64)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            for part in range(0, len(rows), 512):
                some = rows[part : part + 512]
                yield dim, some, [vector[i] for i in some], [batch.column(c).to_numpy(zero_copy_only=False)[some] for c in columns]


def _posted(index: dict[int, Index]):
    """Vectors with the lists they are written to, and their distance from the list's centroid."""

    def run(batches):
        for dim, some, vector, (node,) in _blocks(batches, ["node"]):
            if dim not in index:
                lists, far = [np.zeros(1, np.int64)] * len(some), np.zeros(len(some))
            else:
                x = lift(V.matrix(vector), index[dim].top)
                lists = lists_of(x, index[dim].graph)
            at = np.repeat(np.arange(len(some)), [len(c) for c in lists])
            numbers = np.concatenate(lists)
            if dim in index:
                far = np.sqrt(((x[at] - index[dim].graph.centre[numbers]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_lists(dim, numbers)), pa.array(node[at]), pa.array([vector[i] for i in at], pa.binary()), pa.array(far)], ["list", "node", "vector", "far"]
            )

    return run


def _reads(index: dict[int, Index], least: int, later: bool):
    """Queries with the lists they read: the first ones, or later the others, less those that hold nothing above ``bound``."""

    def run(batches):
        for dim, some, vector, (node, bound) in _blocks(batches, ["node", "bound"]):
            if dim not in index:
                lists = [np.zeros(0 if later else 1, np.int64)] * len(some)
            else:
                own = index[dim]
                x = V.matrix(vector)
                length = np.sqrt((x * x).sum(1))
                lists = []
                for (ids, dist), size, b in zip(probes(lift(x, own.top, True), own.graph, own.ratio, own.held, least), length, bound):
                    if later:
                        ids, dist = ids[FIRST:], dist[FIRST:]
                        # The nearest that a list's vectors can be, and the inner product of that; a little more for rounding.
                        most = (1 - np.maximum(dist - own.radius[ids], 0) ** 2 / 2) * own.top * size
                        ids = ids[most * (1 + 1e-9) + 1e-9 * own.top * size >= b]
                    else:
                        ids = ids[:FIRST]
                    lists.append(ids)
            at = np.repeat(np.arange(len(some)), [len(c) for c in lists])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_lists(dim, np.concatenate(lists).astype(np.int64))), pa.array(node[at]), pa.array([vector[i] for i in at], pa.binary()), pa.array(bound[at])], ["list", "node", "vector", "bound"]
            )

    return run


def _searched(k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks, there = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(asks) or not len(there):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)})
        q, node = V.matrix(asks["vector"].tolist()), there["node"].to_numpy()
        x = V.matrix(there["vector"].tolist())
        own, bound, out = asks["node"].to_numpy(), asks["bound"].to_numpy(), []
        for part in range(0, len(q), 256):
            score = q[part : part + 256] @ x.T
            edge = bound[part : part + 256, None]
            if len(node) > k:
                edge = np.maximum(edge, np.partition(score, len(node) - k, axis=1)[:, len(node) - k, None])
            row, col = np.nonzero(score >= edge - 1e-9 * np.abs(np.where(np.isfinite(edge), edge, 0)))  # ties at the edge stay
            out.append((own[part : part + 256][row], node[col], score[row, col]))
        return pd.DataFrame({"query": np.concatenate([o[0] for o in out]), "node": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` rows of ``df`` with the largest inner product found.

    Ids and vectors have the same names in both tables. The score is the inner product in double precision; ties go to the smaller id, and
    a row is no candidate for a query of the same id. Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows with a null id; vectors of another length than the query's are no candidates. Repeated ids among
    candidates are found as rows of their own, repeated query rows are answered once. With fewer candidates all are returned. Other
    columns are ignored. The lists and the ratio come from a sample of at most ``vectors.SAMPLE`` rows; every row is indexed. Runs jobs.
    """
    spark = df.sparkSession
    vectors = materialize(V.packed(df.where(f"`{id_col}` is not null"), id_col, vector_col).where("vector is not null"), "vectors")
    asked = V.packed(queries.where(f"`{id_col}` is not null"), id_col, vector_col).where("vector is not null").distinct()
    classes = V.classes_of(vectors)
    n = classes.count()
    tops = {r["dim"]: r["top"] for r in classes.select(F.expr("octet_length(vector) div 8").alias("dim"), "vector").mapInArrow(_norms, "dim long, top double").groupBy("dim").agg(F.max("top").alias("top")).collect()}  # one row per length of vectors
    index = {}
    for dim, x in V.sample(classes).items():
        if dim in tops:
            k_lists = max(1, min(LISTS, n // LIST, len(x) // 4))
            graph = Graph.of(balanced_kmeans(lift(x, tops[dim]), k_lists))
            index[dim] = Index(graph, tops[dim], ratio_of(x, tops[dim], graph, k), np.zeros(len(graph.centre), np.int64), np.zeros(len(graph.centre)))
    shared = spark.sparkContext.broadcast(index)  # at most LISTS centroids in all but for splits
    postings = materialize(classes.select("node", "vector").mapInArrow(lambda b: _posted(shared.value)(b), "list long, node long, vector binary, far double"), "lists")
    counts = postings.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far"))  # one row per list
    for r in counts.collect():
        if r["list"] >> 32 in index:
            own, number = index[r["list"] >> 32], r["list"] & 0xFFFFFFFF
            own.held[number], own.radius[number] = r["n"], r["far"]
    # k + 1 different vectors, even if each of them is in all the lists it may be in.
    full, least = spark.sparkContext.broadcast(index), REPLICAS * (k + 1)
    sizes = counts.select("list", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    there = postings.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).select("list", "block", F.lit(False).alias("asks"), "node", "vector", F.lit(0.0).alias("bound"))
    # A query's nearest rows lie in its k + 1 nearest classes; a class can give at most its k + 1 smallest ids.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first", "node")

    def search(asks: DataFrame, later: bool) -> DataFrame:
        reads = asks.mapInArrow(lambda b: _reads(full.value, least, later)(b), "list long, node long, vector binary, bound double").join(sizes, "list")
        reads = reads.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("list", "block", F.lit(True).alias("asks"), "node", "vector", "bound")
        return reads.union(there).groupBy("list", "block").applyInPandas(_searched(k + 1), "query long, node long, score double")

    def nearest_of(found: DataFrame) -> DataFrame:
        found = found.groupBy("query", "node").agg(F.max("score").alias("score")).join(classes.select("node", "first"), "node")
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("query", "node", "score")

    asks = materialize(asked.select("vector").distinct().withColumn("node", F.xxhash64("vector")), "asks")
    open_ = F.lit(float("-inf"))
    first = materialize(nearest_of(search(asks.withColumn("bound", open_), False)), "found")
    # Only k + 1 found classes bound the rest.
    bounds = first.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
    bounded = asks.join(bounds, asks["node"] == bounds["query"], "left").select("vector", "node", F.coalesce("least", open_).alias("bound"))
    found = materialize(nearest_of(first.union(search(bounded, True))), "found")
    ids = vectors.join(classes.select("vector", "node"), "vector").join(found.select("node").distinct(), "node", "left_semi").select("node", "id")
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("nth") <= k + 1).groupBy("node").agg(F.collect_list("id").alias("ids"))
    named = asked.withColumn("query", F.xxhash64("vector")).select(F.col("id").alias("query_id"), "query")
    rows = named.join(found, "query").join(ids, "node").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _norms(batches):
    for batch in batches:
        dims, vector = batch.column("dim").to_numpy(), batch.column("vector").to_pylist()
        kinds = np.unique(dims)
        tops = [max(float(np.sqrt((np.frombuffer(v, "<f8") ** 2).sum())) for v, d in zip(vector, dims) if d == k) for k in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(tops, pa.float64())], ["dim", "top"])
