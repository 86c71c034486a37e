"""Term-weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import text
from gaugeline.queries.registry import query, rounded, table

_TOKENS = r"""
raw AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\s,;:@#$%&?!"()\[\]{}<>]+|--+')) AS t FROM documents),
tok AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(''s|''m|''d|''ll|''re|''ve|n''t)$', ''), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS term FROM raw),
counts AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE regexp_full_match(term, '\p{L}+') GROUP BY ALL)"""

_WEIGHTS = (
    _TOKENS
    + """,
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
w AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)::DOUBLE) / (1.0 + df)::DOUBLE) + 1.0::DOUBLE) AS raw FROM counts JOIN dfs USING (term)),
weights AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w)"""
)


@query("m18_term_counts", f"WITH {_TOKENS} SELECT doc_id, term, tf FROM counts")
def _(spark, d):
    return text.term_counts(table(spark, d, "documents"), "doc_id", "text")


@query("m18_document_frequency", f"WITH {_TOKENS} SELECT term, count(*) AS df FROM counts GROUP BY 1")
def _(spark, d):
    return text.document_frequencies(text.term_counts(table(spark, d, "documents"), "doc_id", "text"))


@query("m18_tf_idf", f"WITH {_WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def _(spark, d):
    return rounded(text.tf_idf(table(spark, d, "documents"), "doc_id", "text"))


# A small dictionary: plural forms of the region names, and one common word mapped onto another.
_LEMMAS = "lemmas AS (SELECT lower(r_name) || 's' AS term, lower(r_name) AS lemma FROM region UNION ALL SELECT 'and', 'or'),"
_LEMMA_WEIGHTS = _LEMMAS + _WEIGHTS.replace(
    "counts AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE regexp_full_match(term, '\\p{L}+') GROUP BY ALL)",
    """counts AS (SELECT doc_id, coalesce(lemma, tok.term) AS term, count(*) AS tf FROM tok LEFT JOIN lemmas ON tok.term = lemmas.term
      WHERE regexp_full_match(tok.term, '\\p{L}+') GROUP BY ALL)""",
)


@query("m18_tf_idf_lemmas", f"WITH {_LEMMA_WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def _(spark, d):
    regions = table(spark, d, "region").select(F.concat(F.lower("r_name"), F.lit("s")).alias("term"), F.lower("r_name").alias("lemma"))
    lemmas = regions.unionByName(spark.sql("SELECT 'and' AS term, 'or' AS lemma"))
    return rounded(text.tf_idf(table(spark, d, "documents"), "doc_id", "text", lemmas))


@query(
    "m19_sparse_vectors",
    f"""WITH {_WEIGHTS} SELECT doc_id, string_agg(term || ':' || format('{{:.4f}}', weight), ' ' ORDER BY term) AS vector FROM weights GROUP BY 1""",
)
def _(spark, d):
    weights = text.tf_idf(table(spark, d, "documents"), "doc_id", "text")
    return text.sparse_strings(weights, "doc_id", digits=4)


# Conversation turns weighed with the vocabulary of the documents.
_BOTH = "(SELECT 'd' || doc_id AS doc_id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"
_SCORED = _WEIGHTS.replace("t FROM documents)", f"t FROM {_BOTH})").replace("FROM counts GROUP BY 1)", "FROM counts WHERE doc_id LIKE 'd%' GROUP BY 1)")


@query("m18_scored_with_vocabulary", f"WITH {_SCORED} SELECT doc_id, term, round(weight, 6) AS weight FROM weights WHERE doc_id LIKE 'c%'")
def _(spark, d):
    vocabulary = text.vocabulary(table(spark, d, "documents"), "doc_id", "text")
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    turns = table(spark, d, "conversations").select(key.alias("doc_id"), "text")
    return rounded(text.score_tf_idf(turns, "doc_id", "text", vocabulary))
