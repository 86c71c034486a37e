"""The operators of this package over the given tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import ann, bpe, codes, embed_dedup, infill, minhash, packing, ppm, quality, shards, suffixes, toxicity, twins, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


@query
def op4_warc(spark, sf_dir):
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, CAST(strlen(html) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""


@query
def op5_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), 20)


@query
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op8_ppm(spark, sf_dir):
    return ppm.score(table(spark, sf_dir, "documents"))


@query
def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_repeats(spark, sf_dir):
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


@query
def op11_hilbert(spark, sf_dir):
    return shards.place(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])


ORACLE["op11_hilbert"] = twins.hilbert_shards(["lang", "source", "n_chars"])


@query
def op12_vector_codes(spark, sf_dir):
    return codes.digest(*codes.compress(table(spark, sf_dir, "embeddings")))


ORACLE["op12_vector_codes"] = twins.vector_codes()


@query
def op13_fill_in_middle(spark, sf_dir):
    return infill.digest(infill.fill_in_middle(table(spark, sf_dir, "documents")))


ORACLE["op13_fill_in_middle"] = twins.FILL_IN_MIDDLE
