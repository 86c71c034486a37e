"""Near-duplicate texts by circulant MinHash.

Two permutations of the 32-bit numbers make all signature coordinates: the first, sigma, scatters the shingles; the second,
pi, is applied after a circular shift by k, and coordinate k is the minimum of ``pi(sigma(x) + k mod 2**32)`` over the
set. Bands of coordinates give buckets; every pair that a bucket proposes is confirmed by the exact Jaccard similarity of
the full shingle sets before it counts.

Texts with equal sets are one class from the start, found by a 128-bit digest of the set, so copies never meet in pairs.
The remaining classes are linked by ``links.bucket_components``, which loses no link between the members of a bucket. With 32
bands of 5, two sets of similarity 0.8 share no bucket with probability 3e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import bytesops as B
from gaugeline.llm import links
from gaugeline.session import materialize

BANDS, ROWS = 32, 5


def signature(sets: np.ndarray, coordinates: int) -> np.ndarray:
    """The signature of one set of 64-bit shingle hashes."""
    scattered = B.mix32((sets ^ (sets >> B.U(32))).astype(np.uint32))
    shift = np.arange(coordinates, dtype=np.uint32)
    low = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for part in range(0, len(scattered), 512):
        low = np.minimum(low, B.mix32(scattered[part : part + 512, None] + shift).min(0))
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band."""
    low = low.reshape(bands, rows).astype(B.U)
    key = np.arange(1, bands + 1, dtype=B.U)
    for i in range(rows):
        key = B.mix(key * B.U(0x9FB21C651E98DF25) + low[:, i])
    return key


def _digests(words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            sizes, fa, fb, keys = [], [], [], []
            for block in B.blocks(batch.column("text")):
                hashes, first = B.word_hashes(block)
                for i in range(len(block)):
                    s = B.shingles(hashes[first[i] : first[i + 1]], words)
                    sizes.append(len(s))
                    fa.append(int(B.mix(s + B.U(len(s))).sum(dtype=B.U).astype(np.int64)) if len(s) else 0)
                    fb.append(int(B.mix(s ^ B.U(0xA5A5A5A5A5A5A5A5)).sum(dtype=B.U).astype(np.int64)) if len(s) else 0)
                    keys.append(band_keys(signature(s, bands * rows), bands, rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc", "n_shingles", "fa", "fb", "buckets"],
            )

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            fa, fb, out = [], [], []
            for block in B.blocks(batch.column("text")):
                hashes, first = B.word_hashes(block)
                for i in range(len(block)):
                    s = B.shingles(hashes[first[i] : first[i + 1]], words)
                    fa.append(int(B.mix(s + B.U(len(s))).sum(dtype=B.U).astype(np.int64)) if len(s) else 0)
                    fb.append(int(B.mix(s ^ B.U(0xA5A5A5A5A5A5A5A5)).sum(dtype=B.U).astype(np.int64)) if len(s) else 0)
                    out.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["fa", "fb", "items"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Groups of near-duplicate texts: ``<id_col>, n_shingles, component_id, kept``, one row per input row.

    Words are runs of bytes other than blank and \\x09-\\x0D, ASCII letters lower-cased. A text's set holds its distinct runs of
    ``words`` words (a shorter text counts as one run). Two texts are linked if ``100 * |A & B| >= percent * |A | B|``;
    ``component_id`` is the smallest id reachable over links, ``kept`` tells the row that has it. Null and empty texts, and
    texts of separators only, have an empty set and stay alone. A row with a null id can be linked, but never names a
    group: its ``kept`` is true only if it is alone, and a group without any id has a null ``component_id``. Rows that
    repeat an id each get their own text's group. Other columns are ignored, whatever their names. Runs jobs.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    shape = f"doc {kind}, n_shingles long, fa long, fb long, buckets array<long>"
    digests = materialize(texts.mapInArrow(_digests(words, bands, rows), shape), "minhash")
    full = digests.where("n_shingles > 0")
    # One class per distinct set; (fa, fb) is its 128-bit digest and fa alone names the node.
    classes = materialize(
        full.groupBy("fa", "fb").agg(F.min("doc").alias("doc"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.first("buckets").alias("buckets")), "classes"
    )
    members = classes.select(F.explode("buckets").alias("bucket"), F.col("fa").alias("node"))
    sizes = classes.select(F.col("fa").alias("node"), "n", "doc", "fb")

    def prepare(nodes: DataFrame):
        # The full sets of all texts that share a bucket, made from the texts again and kept once per class.
        wanted = nodes.join(sizes, "node")
        ids = wanted.select(F.col("doc").alias("id")).distinct()
        held = texts.join(ids, F.col("doc").eqNullSafe(F.col("id")), "left_semi")
        sets = held.select("text").mapInArrow(_sets(words), "fa long, fb long, items array<long>").groupBy("fa", "fb").agg(F.first("items").alias("items"))
        sets = materialize(sets.join(wanted.select(F.col("node").alias("fa"), "fb", "n"), ["fa", "fb"]).select(F.col("fa").alias("node"), "n", "items"), "sets")

        def confirm(pairs: DataFrame) -> DataFrame:
            # The similarity cannot reach the limit where the sizes differ too much.
            side = sets.select("node", "n")
            pairs = pairs.join(side.toDF("a", "na"), "a").join(side.toDF("b", "nb"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
            both = pairs.join(sets.select("node", "items").toDF("b", "ib"), "b").join(sets.select("node", "items").toDF("a", "ia"), "a")
            common = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ia", "ib")).alias("c"))
            return common.where(f"100 * c >= {percent} * (na + nb - c)").select("a", "b")

        return confirm, sets

    roots = links.bucket_components(members, prepare, percent)
    named = classes.select("fa", "fb", "doc", "copies").join(roots.withColumnRenamed("node", "fa"), "fa", "left").withColumn("root", F.coalesce("root", "fa"))
    heads = named.groupBy("root").agg(F.min("doc").alias("component_id"), F.sum("copies").alias("members"))
    # Only classes with more than one text have to be looked up; the rest name themselves.
    grouped = named.join(heads, "root").where("members > 1").select("fa", "fb", "component_id")
    out = digests.select("doc", "n_shingles", "fa", "fb").join(grouped.withColumn("linked", F.lit(True)), ["fa", "fb"], "left")
    component = F.when(F.col("linked") & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc"))
    out = out.select("doc", "n_shingles", component.alias("component_id"), "linked")
    kept = F.when(F.col("doc").isNull(), F.col("linked").isNull()).otherwise(F.col("doc") == F.col("component_id"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
