"""Cleaning, filters, sampling, encoding and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators import clean, encode, sampling, scores
from gaugeline.operators import features as feat
from gaugeline.operators.lookup import attach
from gaugeline.queries.common import ENTITY, TARGET, TS, feature_table
from gaugeline.queries.registry import FEATURES, GRID, events, query, rounded, table


@query("b1_squeeze_names", "SELECT event_id, ts, user_id, event_type, value, props AS raw_props FROM events")
def _(spark, d):
    padded = events(spark, d).toDF(" event_id", "ts  ", "user _id", " event   _ type ", "value", "raw _props")
    return clean.squeeze_names(padded)


@query("b2_trim_strings", "SELECT event_id, event_type, props FROM events")
def _(spark, d):
    pad = F.lit(" \t ")
    padded = events(spark, d).select("event_id", F.concat(pad, "event_type", pad).alias("event_type"), F.concat("props", pad).alias("props"))
    return clean.trim_strings(padded)


@query("b2_trim_named", "SELECT event_id, event_type, props || '  ' AS props FROM events")
def _(spark, d):
    padded = events(spark, d).select(
        "event_id", F.concat(F.lit("  "), "event_type").alias("event_type"), F.concat("props", F.lit("  ")).alias("props")
    )
    return clean.trim_strings(padded, ["event_type", "event_id"])


_PRICES = ["l_orderkey", "l_linenumber", "l_returnflag", "price"]


def _texts(spark, d, bad: bool, readable: str | None = None):
    whole = price = F.concat(F.lit(" "), F.format_number("l_extendedprice", 2))
    if bad:
        price = F.when(F.col("l_returnflag") == "N", F.lit("n/a")).otherwise(price)
    return table(spark, d, "lineitem").withColumn("price", price).select(*_PRICES, *([whole.alias(readable)] if readable else []))


@query(
    "b3_numbers_null_bad",
    """SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag <> 'N' THEN round(l_extendedprice, 2) END AS price FROM lineitem""",
)
def _(spark, d):
    return clean.to_numbers(_texts(spark, d, True), ["price"])


@query("b3_numbers_strict", "SELECT l_orderkey, l_linenumber, l_returnflag, round(l_extendedprice, 2) AS price FROM lineitem")
def _(spark, d):
    return clean.to_numbers(_texts(spark, d, False), ["price"], "strict")


@query(
    "b3_numbers_keep_column",
    """SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE ' ' || format('{:,.2f}', l_extendedprice) END AS price,
      round(l_extendedprice, 2) AS clean_price FROM lineitem""",
)
def _(spark, d):
    # Of two columns of texts the one with an unreadable value stays as it was, blanks and commas included.
    texts = _texts(spark, d, True, "clean_price")
    return rounded(clean.to_numbers(texts, ["price", "clean_price"], "keep_column"), 2)


@query("b4_parse_time", "SELECT date_trunc('minute', ts) AS ts, event_id FROM events")
def _(spark, d):
    text = events(spark, d).select("event_id", F.date_format(TS, " M/d/yy H:mm ").alias("DATETIMEUTC"))
    return clean.parse_time(text, "DATETIMEUTC", TS, "M/d/yy H:mm")


@query("b5_keep_entities", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def _(spark, d):
    return clean.keep_entities(events(spark, d), ENTITY, ["click", "view"]).select("event_id", ENTITY, TARGET)


@query("b6_one_entity", "SELECT event_id, ts, value FROM events WHERE event_type = 'error'")
def _(spark, d):
    return clean.one_entity(events(spark, d), ENTITY, "error").select("event_id", TS, TARGET)


@query("b7_time_slice", """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-14 23:59:59'""")
def _(spark, d):
    return clean.time_slice(events(spark, d), TS, "2024-01-08 00:00:00", "2024-01-15 00:00:00").select("event_id", TS)


@query(
    "b8_time_slice_closed",
    f"WITH {GRID} SELECT event_type, ts FROM grid WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'",
)
def _(spark, d):
    grid = feature_table(spark, d, [], drop=False)
    return clean.time_slice(grid, TS, "2024-01-08 00:00:00", "2024-01-15 00:00:00", closed=True).select(ENTITY, TS)


@query(
    "b9_cutoff_split",
    """SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first_ts,
    max(ts) AS last_ts FROM events GROUP BY 1""",
)
def _(spark, d):
    train, test = clean.cutoff_split(events(spark, d), TS, "2024-01-20 00:00:00")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))


@query("b10_drop_incomplete", f"""WITH {GRID}, l AS (SELECT *, lag(value, 48) OVER (PARTITION BY event_type ORDER BY ts) AS hist_2D FROM grid)
    SELECT event_type, ts, round(hist_2D, 6) AS hist_2D FROM l WHERE hist_2D IS NOT NULL""")  # fmt: skip
def _(spark, d):
    return rounded(feat.drop_incomplete(feature_table(spark, d, ["hist_2D"], drop=False), ["hist_2D"]).select(ENTITY, TS, "hist_2D"))


@query("b11_features_and_target", f"WITH {FEATURES} SELECT event_type, ts, hour, round(value, 6) AS value FROM features")
def _(spark, d):
    return rounded(feature_table(spark, d).select(ENTITY, TS, "hour", TARGET))


@query(
    "b12_survival",
    f"""WITH {GRID}, l AS (SELECT *, lag(value, 384) OVER (PARTITION BY event_type ORDER BY ts) AS h FROM grid)
    SELECT event_type, count(*) AS before, count(h) AS after, count(*) - count(h) AS dropped, count(h) * 2 < count(*) AS warn
    FROM l GROUP BY 1""",
)
def _(spark, d):
    return feat.survival(feature_table(spark, d, ["hist_16D"], drop=False), ENTITY, ["hist_16D"])


@query("b13_valid_target", "SELECT l_suppkey, count(DISTINCT l_tax) >= 2 AS valid FROM lineitem GROUP BY 1")
def _(spark, d):
    return scores.valid_targets(table(spark, d, "lineitem"), "l_suppkey", "l_tax")


@query(
    "b14_valid_target_strict",
    """SELECT o_custkey, count(*) FILTER (WHERE n > 1) >= 2 AS valid FROM
    (SELECT o_custkey, o_orderpriority, count(o_orderpriority) AS n FROM orders GROUP BY ALL) GROUP BY 1""",
)
def _(spark, d):
    return scores.valid_targets_strict(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("b15_first_entities", "SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 20)")
def _(spark, d):
    return clean.cap_entities(events(spark, d), "user_id", 20).select("event_id", "user_id", TARGET)


@query("b16_distinct_values", "SELECT DISTINCT c_mktsegment FROM customer")
def _(spark, d):
    return clean.distinct_values(table(spark, d, "customer"), "c_mktsegment")


@query("b17_conform", "SELECT CAST(user_id AS VARCHAR) AS VM_ID, CAST(hour(ts) AS BIGINT) AS hour, value AS hist_1D FROM events")
def _(spark, d):
    raw = events(spark, d).select(F.hour(TS).alias(" hour"), F.col(TARGET).cast("string").alias("hist-1D"), F.col("user_id").alias("VM_ID"), TS)
    contract = T.StructType([
        T.StructField("VM_ID", T.StringType()), T.StructField("hour", T.LongType()), T.StructField("hist_1D", T.DoubleType()),
    ])
    return clean.conform(raw, contract)


@query(
    "b18_report_filter",
    "SELECT event_type, ts, value FROM events WHERE event_type = 'view' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'",
)
def _(spark, d):
    return clean.report_filter(events(spark, d), ENTITY, "view", TS, "2024-01-05", "2024-01-09", [TARGET])


# --- joins ------------------------------------------------------------------------------------------------


@query("j3_allowed_keys", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    allowed = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return clean.keep_entities(events(spark, d), "user_id", allowed).select("event_id", "user_id")


@query(
    "j4_lookup_codes",
    """WITH codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT event_type AS v FROM events WHERE ts < TIMESTAMP '2024-01-01 00:20:00'))
    SELECT event_id, event_type, coalesce(code, -1) AS code FROM events LEFT JOIN codes ON event_type = v""",
)
def _(spark, d):
    ev = events(spark, d)
    codes = encode.fit_codes(ev.filter(F.col(TS) < F.lit("2024-01-01 00:20:00").cast("timestamp_ntz")), ENTITY)
    return encode.apply_codes(ev.select("event_id", ENTITY), ENTITY, codes, "code", ["event_id"])


@query(
    "j4_skew_safe_lookup",
    "SELECT l_orderkey, l_linenumber, l_suppkey, n.n_lines FROM lineitem JOIN (SELECT l_suppkey, count(*) AS n_lines FROM lineitem GROUP BY 1) n USING (l_suppkey)",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    counts = lines.groupBy("l_suppkey").agg(F.count("*").alias("_w"), F.count("*").alias("n_lines"))
    return attach(lines, counts, "l_suppkey", "_w", ["l_orderkey", "l_linenumber"])


# --- sampling ---------------------------------------------------------------------------------------------


@query(
    "s1_sample_entities",
    """WITH k AS (SELECT md5(user_id || ':42') AS d, user_id FROM (SELECT DISTINCT user_id FROM events)),
    r AS (SELECT user_id, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM k)
    SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT user_id FROM r WHERE r <= floor(n * 5.0 / 100))""",
)
def _(spark, d):
    return sampling.sample_entities(events(spark, d), "user_id", 5.0).select("event_id", "user_id", TARGET)


@query("s2_random_split", """SELECT event_id, CASE WHEN substr(md5(event_id || ':42'), 1, 8) < '80000000' THEN 'a' ELSE 'b' END AS part FROM events""")
def _(spark, d):
    a, b = sampling.random_split(events(spark, d), "event_id")
    return a.select("event_id", F.lit("a").alias("part")).unionByName(b.select("event_id", F.lit("b").alias("part")))


@query(
    "s3_subsample_keeping",
    """SELECT event_id, event_type FROM events WHERE event_type = 'error' OR substr(md5(event_id || ':42'), 1, 8) < '19999999'""",
)
def _(spark, d):
    return sampling.subsample_keeping(events(spark, d), F.col(ENTITY) == "error", "event_id", 0.1).select("event_id", ENTITY)


@query("s4_shuffled", "SELECT doc_id, md5(doc_id || ':42') AS place FROM documents")
def _(spark, d):
    docs = sampling.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id")
    return docs.withColumn("place", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))))


# --- encoding ---------------------------------------------------------------------------------------------


@query(
    "m1_string_codes",
    """WITH a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT event_type AS v FROM events)),
    b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT props AS v FROM events))
    SELECT event_id, a.c AS event_type, b.c AS props, value FROM events JOIN a ON event_type = a.v JOIN b ON props = b.v""",
)
def _(spark, d):
    ev = events(spark, d).select("event_id", ENTITY, "props", TARGET)
    columns = encode.string_columns(ev)
    return encode.encode_strings(ev, columns, {c: encode.fit_codes(ev, c) for c in columns}, ["event_id"])


@query(
    "m2_entity_code",
    """WITH a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS v FROM events))
    SELECT event_id, CAST(user_id AS VARCHAR) AS VM_ID, c AS VM_mapped FROM events JOIN a ON CAST(user_id AS VARCHAR) = v""",
)
def _(spark, d):
    ev = events(spark, d).select("event_id", F.col("user_id").cast("string").alias("VM_ID"))
    return encode.apply_codes(ev, "VM_ID", encode.fit_codes(ev, "VM_ID"), "VM_mapped", ["event_id"])


@query(
    "m3_standard_scale",
    """WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - qm) / qs, 6) AS l_quantity, round((l_tax - tm) / ts, 6) AS l_tax, 0.0::DOUBLE AS fixed
    FROM lineitem, s""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(7.0).alias("fixed"))
    columns = ["l_quantity", "l_tax", "fixed"]
    return rounded(encode.apply_scale(lines, columns, encode.fit_scale(lines, columns)))
