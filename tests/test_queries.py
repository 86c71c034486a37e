"""Every registered query: against its SQL twin where there is one, otherwise for shape."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(0 < r["error"] < 1 for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf_dir, name):
    _, difference = oracle.compare(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert difference is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_learned(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    names = rows.columns
    found = rows.collect()
    assert found
    if "predict" in names:
        actual = "actual" if "actual" in names else "value"
        assert all(r["predict"] is not None and r[actual] is not None for r in found)
        if name != "m17_seasonal_search":  # averaged trees stay within the target's range
            top = spark.read.parquet(f"{sf_dir}/events.parquet").agg({"value": "max"}).first()[0]
            assert all(0 <= r["predict"] <= top for r in found)
