"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are one class from the start. Every class has a home cell, that of its nearest centroid, and visits each earlier
cell that may hold a vector within the angle: with home centroid ``h``, limit angle ``t`` and any cell ``c``, a vector whose home is ``c`` lies
on c's side of the plane between the centroids, so a vector ``b`` can only be near it if ``b . (c - h) >= -sin(t) * |c - h|``. Each home vector
is compared with all vectors that are at home in its cell or visit it, so all links are found, each once, at any size.

Cells are dealt out in pairs of blocks, a bounded number of vectors per task; the larger the blocks, the fewer copies of a vector
cross. As many pairs as move every vector about twice are one round, whose shuffle files go when it ends, so the disk that is taken grows
with the vectors and not with the pairs. A pair of blocks is compared tile by tile and gives the number of links per vector and a spanning
forest of its links, never the pairs.

A tile is first compared in the few directions that hold most of the vectors' length, in single precision: with unit vectors cut into a
head and a tail, ``a . b <= head(a) . head(b) + |tail(a)| * |tail(b)|``, so only pairs for which the right side reaches the limit, less
what rounding can take, are multiplied in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import links
from gaugeline.llm import vectors as V
from gaugeline.session import brief_shuffles, materialize, release

BLOCK, TILE = 65536, 512  # vectors on a side of a pair of blocks at most, and of what is compared at once
SIDES, LEAST = 8, 4096  # blocks that all vectors make at least, if they are not below this size
SIDE = 1 << 25  # bytes of a block in double precision, at most
CELLS = 4096  # at most; with more vectors cells have more blocks
MOVED, ROUND = 2, 1 << 28  # times that a round moves all vectors, about, and bytes that it may always move
CROSSING = 2048  # comparisons that take as long as one more copy of a vector
TURNED = 1024  # components up to which heads are found


def gaps(centre: np.ndarray) -> np.ndarray:
    """Distances of all centroids from each other."""
    out = np.empty((len(centre), len(centre)))
    for part in range(0, len(centre), V.PART):
        out[part : part + V.PART] = np.sqrt(np.maximum(2 - 2 * centre[part : part + V.PART] @ centre.T, 0))
    return out


def visits(x: np.ndarray, centre: np.ndarray, gap: np.ndarray, least: float, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, if it is not given, and the earlier cells that it visits as well."""
    near = x @ centre.T
    home = near.argmax(1) if home is None else home
    sine = np.sqrt(max(0.0, 1 - least * least))
    there = near - near[np.arange(len(x)), home][:, None] >= -sine * gap[home] - 1e-9
    return home, there & (np.arange(len(centre)) < home[:, None])


def centroids(sample: np.ndarray, n: int, least: float) -> np.ndarray:
    """As many cells as pay off: of halving numbers, the one with the fewest expected comparisons per vector."""
    x, best = V.unit(sample), None
    k = max(1, min(CELLS, int(np.sqrt(n)), len(x) // 8))
    while True:
        centre = V.spherical_kmeans(x, k)
        gap, homes, guests = gaps(centre), np.zeros(len(centre)), np.zeros(len(centre))
        for part in range(0, len(x), V.PART):
            home, there = visits(x[part : part + V.PART], centre, gap, least)
            homes += np.bincount(home, minlength=len(centre))
            guests += there.sum(0)
        homes, guests = homes / len(x), guests / len(x)
        # Comparisons where it is looked up, with centroids, and what further copies cost.
        work = float(homes @ (homes / 2 + guests)) * n + 4 * len(centre) + CROSSING * guests.sum()
        if k == 1:  # the cells' own pass over all vectors has to pay off too
            return best[1] if best and best[0] < 0.8 * work else centre
        if best is None or work < best[0]:
            best = (work, centre)
        k = max(1, k // 4)


def _parts(batch, kind: str):
    """Length, rows and unit vectors of parts of a batch, whose vectors may differ in length."""
    vector = batch.column("vector").to_pylist()
    dims = np.array([len(v) // np.dtype(kind).itemsize for v in vector], np.int64)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        for part in range(0, len(rows), 2048):
            some = rows[part : part + 2048]
            yield dim, some, V.unit(V.matrix([vector[i] for i in some], kind))


def _at_home(centre: dict[int, np.ndarray], kind: str):
    """The class with its home cell. A number of components that the sample does not hold is one cell."""

    def run(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for dim, some, x in _parts(batch, kind):
                cell[some] = (dim << 32) + ((x @ centre[dim].T).argmax(1) if dim in centre else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


def _placed(centre: dict[int, np.ndarray], least: float, kind: str, wanted: frozenset | None, full: bool):
    """A row per class and cell it is at home in or visits, of the wanted cells; not full: numbers per batch and cell."""

    def run(batches):
        gap = {dim: gaps(c) for dim, c in centre.items() if len(c) > 1}
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            of, to = [np.arange(len(cell))], [cell]
            for dim, some, x in _parts(batch, kind):
                if dim in gap:
                    at, visited = np.nonzero(visits(x, centre[dim], gap[dim], least, cell[some] & 0xFFFFFFFF)[1])
                    of, to = [*of, some[at]], [*to, (dim << 32) + visited]
            of, to = np.concatenate(of), np.concatenate(to)
            if wanted is not None:
                kept = np.isin(to, np.fromiter(wanted, np.int64, len(wanted)))
                of, to = of[kept], to[kept]
            home = to == cell[of]
            if full:
                rest = batch.select(["node", "copies", "vector"])
                for part in range(0, len(of), 4096):
                    some = slice(part, part + 4096)
                    yield pa.RecordBatch.from_arrays([pa.array(to[some]), pa.array(home[some]), *rest.take(pa.array(of[some])).columns], ["cell", "home", "node", "copies", "vector"])
            elif len(to):
                cells, at = np.unique(to, return_inverse=True)
                n, homes = np.bincount(at), np.bincount(at, weights=home).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(homes), pa.array(n - homes)], ["cell", "homes", "guests"])

    return run


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest reachable column of every row and column of a two-sided link matrix (the number of columns: no link)."""
    none = near.shape[1]
    of_col = np.where(near.any(0), np.arange(none), none)
    of_row = np.full(near.shape[0], none)
    while True:
        row = np.where(near, of_col, none).min(1, initial=none)
        col = np.minimum(of_col, np.where(near, row[:, None], none).min(0, initial=none))
        if (row == of_row).all() and (col == of_col).all():
            return row, col
        of_row, of_col = row, col


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` nodes the smallest that the links ``a, b`` reach."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _directions(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray | None:
    """The directions (component, direction) of the head that makes the comparison of ``x`` and ``y`` cheapest."""
    dim = x.shape[1]
    if dim > TURNED:
        return None
    some, other = (z[:: -(-len(z) // most)] for z, most in ((x, 1024), (y, 1024)))
    turn = np.linalg.eigh(some.T @ some + other.T @ other)[1][:, ::-1]
    best, size = None, 8
    while size < dim:
        u, v = (_headed(z, turn[:, :size]) for z in (some[::2], other))
        # Thousandths of a nanosecond for a pair, as measured: the product, pairs that are left, and tiles that hold one.
        left = float((u @ v.T >= least).mean())
        cost = 350 + 10 * size + 150_000 * left + 250 * min(1, left * TILE * TILE)
        if best is None or cost < best[0]:
            best = (cost, turn[:, :size])
        size += 8 if size < 64 else size // 2
    return best[1] if best and best[0] < 350 + 10 * dim else None


def _headed(x: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
    if turn is None:
        return x.astype(np.float32)
    head = x @ turn
    tail = np.sqrt(np.maximum(0, 1 + 1e-12 - (head * head).sum(1, keepdims=True)))
    return np.hstack((head, tail)).astype(np.float32)


def _compared(least: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        own, same = rows["asks"].to_numpy(), key[1] == key[2]
        if not own.any() or not same and own.all():
            return empty
        node, copies, vector = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["vector"].to_numpy()
        kind = V.SINGLE if len(vector[0]) == 4 * (int(key[0]) >> 32) else V.DOUBLE
        ask = np.flatnonzero(own)
        there = ask if same else np.flatnonzero(~own)
        x = V.unit(V.matrix(vector[ask], kind))
        y = x if same else V.unit(V.matrix(vector[there], kind))
        turn = _directions(x, y, least)
        u = _headed(x, turn)
        v = u if same else _headed(y, turn)
        # Below the limit by more than products of single precision can be off.
        low = np.float32(least - (u.shape[1] + 16) * 2.0**-22)
        product, high = np.empty(TILE * TILE, np.float32), np.empty(TILE * TILE, bool)
        n, edges, held = np.zeros(len(rows), np.int64), [], 0
        for i in range(0, len(ask), TILE):
            for j in range(i if same else 0, len(there), TILE):
                p, q = ask[i : i + TILE], there[j : j + TILE]
                size = len(p) * len(q)
                np.matmul(u[i : i + TILE], v[j : j + TILE].T, out=product[:size].reshape(len(p), len(q)))
                hit = np.flatnonzero(np.greater_equal(product[:size], low, out=high[:size]))
                if not len(hit):
                    continue
                if 32 * len(hit) > size:
                    near = (x[i : i + TILE] @ y[j : j + TILE].T >= least) & (node[p][:, None] != node[q])
                    if same and i == j:
                        near = np.triu(near, 1)
                    if not near.any():
                        continue
                    n[p] += near @ copies[q]
                    n[q] += copies[p] @ near
                    row, col = forest(near)
                    a, b = row < len(q), col < len(q)
                    edges += [(p[a], q[row[a]]), (q[b], q[col[b]])]
                else:
                    a, b = hit // len(q), hit % len(q)
                    if same and i == j:
                        a, b = a[a < b], b[a < b]
                    close = (np.einsum("ij,ij->i", x[i + a], y[j + b]) >= least) & (node[p[a]] != node[q[b]])
                    a, b = p[a[close]], q[b[close]]
                    np.add.at(n, a, copies[b])
                    np.add.at(n, b, copies[a])
                    edges.append((a, b))
                held += sum(len(e[0]) for e in edges[-2:])
                if held > 8 * len(rows):
                    root = stars(*(np.concatenate([e[side] for e in edges]) for side in (0, 1)), len(rows))
                    edges, held = [(np.arange(len(rows)), root)], len(rows)
        linked = n > 0
        if not linked.any():
            return empty
        root = stars(*(np.concatenate([e[side] for e in edges]) for side in (0, 1)), len(rows))
        return pd.DataFrame({"a": node[linked], "b": node[root[linked]], "n": n[linked]})

    return run


def _summed(found: DataFrame) -> DataFrame:
    """Links ``a, b, n`` as one row per node: its root and its number of links. Runs jobs."""
    roots = links.components(found.select("a", "b"))
    sums = found.groupBy("a").agg(F.sum("n").alias("n")).join(roots.select(F.col("node").alias("a"), F.col("root").alias("b")), "a", "left")
    out = materialize(sums.select("a", F.coalesce("b", "a").alias("b"), "n"), "summed")
    release(roots)
    return out


def _links(classes: DataFrame, n: int, least: float, block: int | None, kind: str) -> DataFrame:
    """``a, b, n`` of :func:`_summed` for all classes, which are deleted. Runs jobs."""
    block = block or max(LEAST, min(BLOCK, -(-n // SIDES)))
    width = np.dtype(kind).itemsize
    centre = {dim: centroids(x, n, least) for dim, x in V.sample(classes, kind=kind, n=n).items()}
    some = classes.select("node", "copies", "vector")
    split = any(len(c) > 1 for c in centre.values())
    if split:
        some = materialize(some.mapInArrow(_at_home(centre, kind), "node long, copies long, vector binary, cell long"), "cells")
        release(classes)
        classes = some
        sizes = some.mapInArrow(_placed(centre, least, kind, None, False), "cell long, homes long, guests long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests"))
    else:
        some = some.withColumn("cell", F.shiftleft((F.length("vector") / width).cast("long"), 32))
        sizes = some.groupBy("cell").agg(F.count("*").alias("homes"), F.lit(0).cast("long").alias("guests"))
    # One row per cell: at most CELLS per length of vectors.
    sizes = sizes.where("homes > 0").toPandas()
    cell, dim = sizes["cell"].to_numpy(), sizes["cell"].to_numpy() >> 32
    side = np.minimum(block, np.maximum(1, SIDE // (8 * np.maximum(1, dim))))
    own, guest = -(-sizes["homes"].to_numpy() // side), -(-sizes["guests"].to_numpy() // side)
    moved = float(((sizes["homes"].to_numpy() * (own + guest) + sizes["guests"].to_numpy() * own) * (dim * width + 32)).sum())
    once = float((sizes["homes"].to_numpy() * (dim * width + 32)).sum())
    rounds = max(1, int(np.ceil(moved / max(ROUND, MOVED * once))))
    spark = classes.sparkSession
    blocks = spark.createDataFrame(pd.DataFrame({"cell": cell, "own": own, "guest": guest}), "cell long, own long, guest long")
    state, parts, rows = [], [], 0
    for r in range(rounds):
        part = materialize(_paired(some, blocks, centre, least, kind, split, cell, own + guest, r, rounds).groupBy("cell", "i", "j").applyInPandas(_compared(least), "a long, b long, n long"), "links")
        parts, rows = [*parts, part], rows + (part.count() if r + 1 < rounds else 0)
        if rows > max(n, 1 << 20) or r + 1 == rounds:
            now = state + parts
            found = now[0]
            for more in now[1:]:
                found = found.union(more)
            state, parts, rows = [_summed(found)], [], 0
            if rounds > 1:
                release(*now)
    release(classes)
    return state[0]


def _paired(some: DataFrame, blocks: DataFrame, centre: dict[int, np.ndarray], least: float, kind: str, split: bool, cell: np.ndarray, parts: np.ndarray, r: int, rounds: int) -> DataFrame:
    """The vectors of the pairs of blocks of round ``r``: pair (i, j) of a cell, ``i <= j``, is compared in round (cell + i + j) modulo ``rounds``.

    A cell's own blocks come first, then those of its visitors, which are compared with its own only.
    """
    if split:
        wanted = None
        if rounds > 1:  # cells that have a pair whose i + j falls into the round
            wanted = frozenset(cell[(r - cell) % rounds <= 2 * (parts - 1)].tolist())
        placed = some.mapInArrow(_placed(centre, least, kind, wanted, True), "cell long, home boolean, node long, copies long, vector binary")
    else:
        placed = some.withColumn("home", F.lit(True))
    spread = F.xxhash64("node")
    placed = placed.join(F.broadcast(blocks), "cell")
    placed = placed.withColumn("at", F.when(F.col("home"), F.pmod(spread, F.col("own"))).otherwise(F.col("own") + F.pmod(spread, F.greatest("guest", F.lit(1)))))
    first = F.pmod(F.lit(r) - F.col("cell") - F.col("at"), F.lit(rounds).cast("long"))
    last = F.when(F.col("home"), F.col("own") + F.col("guest")).otherwise(F.col("own")) - 1
    partners = F.when(first <= last, F.sequence(first, last, F.lit(rounds).cast("long")))
    placed = placed.withColumn("to", F.explode(partners))
    return placed.select("cell", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), (F.col("at") <= F.col("to")).alias("asks"), "node", "copies", "vector")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, block: int | None = None) -> DataFrame:
    """``<id_col>, n_links, component_id, kept``, one row per input row.

    Two vectors are linked if their cosine, in double precision, is at least ``least``; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` tells the row that has it. Vectors that are null, empty, zero or hold null or
    non-finite components have no links, and vectors of different lengths none with each other. Null ids never name a group; a row with
    a null id is kept only if it has no links. Repeated ids are rows of their own. Other columns are ignored. Runs jobs.
    """
    with brief_shuffles(df.sparkSession):
        kind = V.kind_of(df, vector_col)
        vectors = materialize(V.packed(df, id_col, vector_col, kind), "vectors")
        classes = V.classes_of(vectors)
        # A second hash, so that no two vectors share a name here.
        names = [F.xxhash64("vector").alias("node"), F.xxhash64(F.lit(1), "vector").alias("more")]
        rows = materialize(vectors.select("id", *(F.when(F.col("vector").isNotNull(), name).alias(at) for name, at in zip(names, ("node", "more")))), "rows")
        release(vectors)
        heads = materialize(classes.select(*names, "first", "copies"), "heads")
        found = _links(classes, classes.count(), least, block, kind)
        near = found.select(F.col("a").alias("node"), F.col("b").alias("root"), "n")
        named = heads.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = materialize(named.select("node", "more", "first", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
        release(heads, found)
        firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
        named, rooted = materialize(named.join(firsts, "root").select("node", "more", "n_links", "component_id"), "named"), named
        release(rooted)
    out = rows.join(named, ["node", "more"], "left")
    component = F.when(F.coalesce("n_links", F.lit(0)) > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    kept = F.when(F.col("id").isNull(), F.col("n_links") == 0).otherwise(F.col("id") == F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
