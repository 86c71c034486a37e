import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators import clean, encode, sampling
from gaugeline.operators.lookup import attach
from gaugeline.sources import files


def test_names_lose_spaces_and_must_stay_distinct(spark):
    df = spark.createDataFrame([(1, 2)], [" cpu        _ usage       ", "hist-1D"])
    assert clean.squeeze_names(df).columns == ["cpu_usage", "hist_1D"]
    with pytest.raises(ValueError):
        clean.squeeze_names(spark.createDataFrame([(1, 2)], ["a b", "ab"]))


def test_number_modes(spark):
    df = spark.createDataFrame([(" 1,234.5 ",), ("n/a",), (None,)], "x string")
    assert [r.x for r in clean.to_numbers(df, ["x", "absent"]).collect()] == [1234.5, None, None]
    assert clean.to_numbers(df, ["x"], "keep_column").schema["x"].dataType == T.StringType()
    assert clean.to_numbers(df.filter("x <> 'n/a'"), ["x"], "keep_column").schema["x"].dataType == T.DoubleType()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.to_numbers(df, ["x"], "strict").collect()


def test_time_slices(series):
    df = series([("a", f"2024-01-01 {h:02}:00:00", 1.0) for h in range(4)])
    assert clean.time_slice(df, "ts", "2024-01-01 00:00:00", "2024-01-01 02:00:00").count() == 2
    assert clean.time_slice(df, "ts", "2024-01-01 00:00:00", "2024-01-01 02:00:00", closed=True).count() == 3


def test_keep_entities_short_long_and_table(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert clean.keep_entities(df, "k", [1, 2, 5000]).count() == 2
    assert clean.keep_entities(df, "k", range(500)).count() == 500
    assert clean.keep_entities(df, "k", spark.range(10)).count() == 10


def test_first_of_duplicates_is_by_order(spark):
    df = spark.createDataFrame([("a", 1, 9, "x"), ("a", 1, 3, None), ("a", 2, 1, "z")], "e string, t int, seq int, v string")
    rows = clean.first_wins(df, ["e", "t"], ["seq"]).orderBy("t").collect()
    assert [(r.seq, r.v) for r in rows] == [(3, None), (1, "z")]


def test_conform_names_what_is_missing(spark):
    contract = T.StructType([T.StructField("hour", T.LongType()), T.StructField("hist_1D", T.DoubleType())])
    with pytest.raises(ValueError, match="hist_1D"):
        clean.conform(spark.createDataFrame([(1,)], ["hour"]), contract)


def _write(path, text, opener=open):
    with opener(path, "wb") as f:
        f.write(text.encode())
    return str(path)


def test_usage_files_of_different_layouts(spark, tmp_path):
    a = _write(tmp_path / "a.csv", " VM_ID , cpu        _ usage       ,Unnamed: 0\n v1 ,\"1,200.5\",0\n v2 ,7,1\n")
    b = _write(tmp_path / "b.csv.gz", "cpu_usage,VM_ID\n3,v1\n", gzip.open)
    c = _write(tmp_path / "c.csv", "cpu_usage,VM_ID\nbad,v3\n")
    rows = files.read_usage(spark, [a, b, c], with_source=True).orderBy("VM_ID", "cpu_usage").collect()
    assert [(r.VM_ID, r.cpu_usage) for r in rows] == [("v1", 3.0), ("v1", 1200.5), ("v2", 7.0), ("v3", None)]
    assert {os.path.basename(r.source) for r in rows} == {"a.csv", "b.csv.gz", "c.csv"}
    assert rows[0]["Unnamed:0"] is None


def test_carriage_return_line_ends(spark, tmp_path):
    path = _write(tmp_path / "cr.csv", "DATETIMEUTC,cpu_usage\r4/14/17 2:15,649.3\r4/14/17 2:30,651.6\n")
    df = clean.parse_time(files.append_files(spark, [path]), "DATETIMEUTC", pattern="M/d/yy H:mm")
    rows = df.selectExpr("ts", "weekday(ts) w").orderBy("ts").collect()
    assert [(str(r.ts), r.w) for r in rows] == [("2017-04-14 02:15:00", 4), ("2017-04-14 02:30:00", 4)]


def test_labelled_lines_skip_wrong_field_counts(spark, tmp_path):
    path = _write(tmp_path / "t.tsv", "ham\thello \"quoted\n" "spam\ta\tb\n" "broken\n" "spam\tbuy, now\n")
    rows = files.read_labelled(spark, path).collect()
    assert sorted((r.label, r.message) for r in rows) == [("ham", 'hello "quoted'), ("spam", "buy, now")]


def test_same_layout_is_required(spark):
    with pytest.raises(ValueError):
        files.concat_same_layout([spark.range(1), spark.range(1).withColumnRenamed("id", "x")])


def test_runs():
    assert files.runs(["a", "b", "c"], max_files=2) == [["a"], ["b"]]
    assert files.runs(["a", "b", "c"], max_files=2, joined=True) == [["a", "b"]]
    assert sorted(sum(files.runs(["a", "b", "c"], shuffle_seed=1), [])) == ["a", "b", "c"]


def test_sample_size_and_spelling(spark):
    df = spark.range(1000).selectExpr("concat(' vm', id % 40, repeat(' ', id % 3)) VM_ID", "id")
    for percent, want in ((0, 0), (5, 2), (50, 20), (99.9, 39), (100, 40)):
        picked = sampling.sample_entities(df, "VM_ID", percent)
        trimmed = picked.select(F.trim("VM_ID").alias("k"))
        assert trimmed.distinct().count() == want and trimmed.count() == want * 25
    assert sampling.sample_entities(df, "VM_ID", 50).filter("VM_ID LIKE '% '").count() > 0


def test_split_is_complete_and_repeatable(spark):
    df = spark.range(2000)
    a, b = sampling.random_split(df, "id", 0.3, seed=5)
    assert a.count() + b.count() == 2000 and 500 < a.count() < 700
    assert a.subtract(sampling.random_split(df.repartition(7), "id", 0.3, seed=5)[0]).count() == 0


def test_codes_follow_sorted_order_and_unseen_is_minus_one(spark):
    train = spark.createDataFrame([(v,) for v in ["b", "a", "c", "b", None]], "v string")
    codes = encode.fit_codes(train, "v")
    assert sorted((r.value, r.code, r.n) for r in codes.collect()) == [("a", 0, 1), ("b", 1, 2), ("c", 2, 1)]
    new = spark.createDataFrame([(1, "c"), (2, "zz"), (3, None), (4, "a")], "id int, v string")
    coded = encode.apply_codes(new, "v", codes, "code", ["id"])
    assert {r.id: r.code for r in coded.collect()} == {1: 2, 2: -1, 3: -1, 4: 0}


def test_codes_over_many_ranges(spark):
    values = spark.range(5000).selectExpr("concat('vm-', lpad(id * 7919 % 5000, 5, '0')) v")
    codes = encode.fit_codes(values, "v").orderBy("value").collect()
    assert [r.code for r in codes] == list(range(5000))


def test_lookup_with_a_hot_key(spark):
    """Half of the rows share one key; they are found by broadcast and spread over the join."""
    left = spark.range(20_000).selectExpr("id", "if(id % 2 = 0, 'hot', concat('k', id % 15000)) k")
    table = left.groupBy("k").agg(F.count("*").alias("n"), F.length("k").alias("size"))
    got = attach(left, table, "k", "n", ["id"])
    assert got.count() == 20_000 and got.filter("size <> length(k) OR size IS NULL").count() == 0
    lost = attach(left, table.filter("k <> 'hot'"), "k", "n", ["id"])
    assert lost.filter("size IS NULL").count() == 10_000 == lost.filter("k = 'hot'").count()


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    rows = encode.apply_scale(df, ["x", "c"], encode.fit_scale(df, ["x", "c"])).orderBy("x").collect()
    assert [(r.x, r.c) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]
