"""Connected components of links, and the links of groups that share a bucket, without emitting all pairs.

Nodes are 64-bit numbers that stand for distinct texts or vectors. Nothing here goes through the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import materialize, owning, release, scratch_of

SMALL, BLOCK = 16, 1024


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node of its component.

    Alternating large-star and small-star steps: every step hangs neighbours to the smallest one known, so the number of
    rounds grows with the logarithm of a chain's length. Sums are combined before each shuffle; the joins are plain
    equi-joins, which adaptive execution splits where one node has many links. A step's links are deleted after the next one.
    Runs jobs. No edges: no rows.
    """
    now = materialize(_ordered(edges), "links")
    mark = _mark(now)
    while True:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        release(before)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return owning(roots, scratch_of(now))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def bucket_components(members: DataFrame, prepare: Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], DataFrame]], percent: int) -> DataFrame:
    """``(node, root)`` of the components of all links between nodes that share a bucket; nodes without a link are left out.

    ``members(bucket, node)`` holds each node once per bucket it is in. ``prepare`` gets the nodes that share a bucket with
    another and returns a function that takes pairs ``(a, b)`` and returns those that are links, and the sets ``(node, n, items)``.

    First, every node of a bucket is compared with two pivots of it. That settles buckets of up to three nodes, and as the
    pivots differ between buckets, nearly all of a large group of copies becomes one component. What is left are buckets with
    nodes of several components; only pairs that lie in two components matter there. Up to ``SMALL`` nodes, such pairs are
    confirmed at once. Larger buckets that share nodes are one family, and the sets of a family's nodes outside its largest
    component are compared with those of all its nodes: in blocks, so that no task holds more than two blocks, and without
    making pairs; a block returns a link per node and component found. Runs jobs.
    """
    ranked = F.struct(F.xxhash64("node", "bucket").alias("rank"), "node")
    tops = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(ranked).alias("p0"), F.max(ranked).alias("p1")).where("size > 1")
    # Written first, so that both sides of the join are plain shuffles, which adaptive execution splits for a hot bucket.
    tops = materialize(tops.select("bucket", "size", F.array("p0.node", "p1.node").alias("pivots")), "pivots")
    shared = materialize(members.join(tops, "bucket"), "buckets")
    confirm, sets = prepare(shared.select("node").distinct())
    found = materialize(confirm(_pairs(shared.select(F.explode("pivots").alias("a"), F.col("node").alias("b")))), "found")
    roots = materialize(components(found), "roots")
    rest = shared.where("size > 3").select("bucket", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = materialize(rest, "rooted")
    mixed = materialize(rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket"), "mixed")
    rest = materialize(rest.join(mixed, "bucket"), "open")
    small = rest.where(f"size <= {SMALL}")
    other = small.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"))
    near = small.select("bucket", F.col("node").alias("a"), F.col("root").alias("ra")).join(other, "bucket").where("a < b and ra != rb").select("a", "b")
    more = materialize(confirm(_pairs(near)).union(_across(rest.where(f"size > {SMALL}"), sets, percent)), "found")
    if more.isEmpty():
        return roots
    # Links between the roots of what is known already; the others keep theirs.
    return materialize(components(more.union(roots.toDF("a", "b").where("a != b"))), "roots")


def _across(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each family of large buckets."""
    hubs = large.groupBy("bucket").agg(F.min("node").alias("hub"))
    family = components(large.join(hubs, "bucket").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    nodes = materialize(large.select("node", "root").distinct().join(family.select("node", F.col("root").alias("family")), "node"), "family")
    parts = nodes.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family")
    tops = parts.agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("minor"))
    tops = materialize(tops.where("minor > 0").select("family", "top", F.ceil(F.col("n") / BLOCK).alias("all"), F.ceil(F.col("minor") / BLOCK).alias("minors")), "families")
    rows = nodes.join(tops, "family").join(sets, "node")
    spread = F.xxhash64("node")
    asks = rows.where("root != top").withColumn("i", F.pmod(spread, "minors")).withColumn("j", F.explode(F.expr("sequence(0L, all - 1)")))
    there = rows.withColumn("j", F.pmod(spread, "all")).withColumn("i", F.explode(F.expr("sequence(0L, minors - 1)")))
    names = ["family", "i", "j", "node", "root", "items"]
    both = asks.select(*names, F.lit(True).alias("asks")).union(there.select(*names, F.lit(False).alias("asks")))
    return both.groupBy("family", "i", "j").applyInPandas(_alike(percent), "a long, b long")


def _alike(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks, there = rows[rows["asks"]], rows[~rows["asks"]]
        out = []
        if len(asks) and len(there):
            node, root, size = there["node"].to_numpy(), there["root"].to_numpy(), there["items"].map(len).to_numpy()
            # An index from each item to the sets that hold it.
            item, of = np.concatenate(there["items"].tolist()), np.repeat(np.arange(len(there)), size)
            order = np.argsort(item, kind="stable")
            item, of = item[order], of[order]
            for u, r, own in zip(asks["node"], asks["root"], asks["items"]):
                low, high = np.searchsorted(item, own), np.searchsorted(item, own, side="right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                common = np.bincount(of[at], minlength=len(there))
                hit = np.flatnonzero((100 * common >= percent * (size + len(own) - common)) & (root != r))
                _, one = np.unique(root[hit], return_index=True)
                out += [(u, int(node[i])) for i in hit[one]]
        return pd.DataFrame({"a": np.array([a for a, _ in out], np.int64), "b": np.array([b for _, b in out], np.int64)})

    return run


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
