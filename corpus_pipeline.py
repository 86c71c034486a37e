"""Quality, toxicity, near-duplicates, repeated passages and packing, one after another over ``documents``.

Every stage takes the table the one before has kept and returns the columns of ``documents``; the last returns pieces of sequences.
Null and repeated ids, null and empty texts are rows like others. Extra columns, whatever their names, are passed on up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm import minhash, packing, quality, rowwise, suffixes, toxicity
from gaugeline.session import materialize

LIMIT = 0.7


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not use."""
    while name in docs.columns:
        name += "_"
    return name


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines' field gives them at least 0.7 for quality.

    Null and empty texts have no lines and score the learning share; rows alike score alike; an empty table stays empty.
    """
    field, score = quality.train(docs, _labels(spark, sf_dir)), _free(docs, "_score")
    return rowwise.with_score(docs, "text", score, field.score).where(F.col(score) >= LIMIT).drop(score)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 for toxicity. Null and empty texts hold no toxic word; rows alike score alike; an empty table stays empty."""
    model, score = toxicity.train(docs, _labels(spark, sf_dir)), _free(docs, "_score")
    return rowwise.with_score(docs, "text", score, model.score).where(F.col(score) < LIMIT).drop(score)


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by 5-word shingles and a similarity of 0.8; rows alike in id and text are one.

    Texts without words are linked with nothing: all their rows stay.
    """
    key, nth = _free(docs, "_key"), _free(docs, "_n")
    worded = F.coalesce("text", F.lit("")).rlike(r"[^ \x09-\x0D]")
    # Ids may be null or repeated: a row is known by its id (null behind all others) and its text.
    keyed = docs.where(worded).withColumn(key, F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("text")))
    kept = minhash.near_duplicates(keyed, id_col=key, words=5, percent=80).where("kept").select(key).distinct()
    first = Window.partitionBy(key).orderBy("n_chars")
    one = keyed.join(kept, key, "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(docs.columns)
    return one.union(docs.where(~worded))


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that start in several places; halves of letters at a cut go too, all else stays.

    Null and empty texts stay as they are. Rows alike in id and text are copies of each other, so passages of 200 bytes go from all of them.
    """
    row, text = _free(docs, "_row"), _free(docs, "_text")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    removed = suffixes.remove_repeats(keyed, id_col=row, whole_letters=True).select(row, "starts", "kept")
    # Where nothing was cut the text stays as it is.
    cut = removed.where(F.size("starts") > 0).select(row, F.col("kept").cast("string").alias(text)).dropDuplicates([row])
    out = keyed.join(cut, row, "left").withColumn("text", F.coalesce(text, "text")).drop(text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 4096 tokens. Null and empty texts are one token, rows alike are documents of their own, no rows give no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
