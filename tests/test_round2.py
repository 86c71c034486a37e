"""Cases found by review: hot and null lookup keys, mistyped keys, odd numbers and blanks, quoted CSV, null entities."""

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import clean, features
from gaugeline.operators.lookup import attach
from gaugeline.operators.models import model_kind
from gaugeline.sources import files, store


@pytest.mark.parametrize("hot", ["'hot'", "cast(null as string)"])
def test_a_hot_or_null_key_is_spread(spark, hot):
    """Nine rows of ten share one key; no partition of the join holds more than twice the mean."""
    left = spark.range(40_000).selectExpr("id", f"if(id % 10 > 0, {hot}, concat('k', id % 15000)) k")
    table = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.length("k").alias("size"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        got = attach(left, table, "k", "n", ["id"])
        parts = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(parts) == 40_000 and max(parts) <= 2 * sum(parts) / 8
    assert got.where("k is not null and size is null").count() == 0


@pytest.mark.parametrize("n", [200, 201])
def test_keys_of_another_type(spark, n):
    df = spark.range(1000).toDF("e")
    assert clean.keep_entities(df, "e", [str(i) for i in range(n - 2)] + ["x", None]).count() == n - 2


def test_numbers_and_blanks(spark):
    rows = spark.createDataFrame([("12d",), ("1f",), ("0x1p3",), (" 1,200.5 ",), ("1e3",), ("",), (None,)], "t string")
    assert [r[0] for r in clean.to_numbers(rows, ["t"]).collect()] == [None, None, None, 1200.5, 1000.0, None, None]
    with pytest.raises(Exception, match="not a number"):
        clean.to_numbers(rows, ["t"], "strict").collect()
    assert clean.to_numbers(rows.where("t is null"), ["t"], "strict").first()[0] is None
    assert clean.trim_strings(rows).collect()[3][0] == "1,200.5"


def test_quotes_and_line_breaks(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write('a,b,c\n1,"say ""hi, there"" now",5\n2,"two\nlines",6\n')
    rows = files.read_csv(spark, path, line_breaks=True).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", 'say "hi, there" now', "5"), ("2", "two\nlines", "6")]


def test_null_entities_are_stored_once(spark, tmp_path):
    rows = spark.sql("select cast(null as string) e, timestamp_ntz'2024-01-01 00:00:00' t, 1.0D predict, 2.0D actual union all select 'a', timestamp_ntz'2024-01-01 00:00:00', 1.0D, 2.0D")
    path, config = str(tmp_path / "s"), {"target": "cpu", "features": [], "interval": "1h", "train_days": 1, "predict_days": 1}
    for _ in range(3):
        store.merge(rows, path, "e", "t", ["predict"])
        store.write_predictions(rows, path + "p", config, "e", "t")
    assert store.read_store(spark, path).count() == 2 and store.read_predictions(spark, path + "p").count() == 2


def test_records_take_a_repeated_moment_once(spark):
    rows = spark.sql("select 'a' e, timestamp_ntz'2024-01-01 00:00:00' t, cast(id as double) predict, 2.0D actual from range(2)")
    config = {"target": "cpu", "features": [], "interval": "1h", "train_days": 1, "predict_days": 1}
    assert store.flatten(store.records(rows, config, "e", "t")).count() == 1


def test_boolean_and_impossible_features(spark):
    df = spark.sql("select 'a' e, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) t, cast(id as double) y, id % 2 = 0 up, date'2024-01-01' day_ from range(6)")
    rows = features.transform(df, "e", "t", "y", ["hour", "up"], "2h").orderBy("t").collect()
    assert [r.up for r in rows] == [0.5, 0.5, 0.5]
    with pytest.raises(ValueError, match="day_"):
        features.transform(df, "e", "t", "y", ["day_"], "2h")


def test_leaf_size_of_extra_trees():
    kind = model_kind("ET", {"et__min_samples_leaf": 5})
    assert kind.estimator().getOrDefault("minInstancesPerNode") == 5


def test_a_folder_of_several_layouts(spark, tmp_path):
    folder = tmp_path / "odd [x] *"
    folder.mkdir()
    for name, text in {"a b%20c.csv": "VM_ID,cpu_usage,mem_usage\nx,1,2\n", "b{1}.csv": "VM_ID,mem_usage,cpu_usage\ny,200,100\n", "c.csv": "cpu_usage,VM_ID\n3,z\n", "d.csv": ""}.items():
        (folder / name).write_text(text)
    (tmp_path / "odd x").mkdir()
    (tmp_path / "odd x" / "e.csv").write_text("VM_ID,cpu_usage,mem_usage\nw,7,8\n")
    got = files.append_files(spark, [f"{tmp_path}/odd*"]).select("VM_ID", "cpu_usage", "mem_usage").orderBy("VM_ID").collect()
    assert [tuple(r) for r in got] == [("w", "7", "8"), ("x", "1", "2"), ("y", "100", "200"), ("z", "3", None)]
