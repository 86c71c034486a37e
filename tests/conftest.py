from __future__ import annotations

import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from gaugeline.session import RECOMMENDED  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").appName("gaugeline-tests")
    settings = {
        **RECOMMENDED, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="gaugeline-tests-"), "spark.ui.showConsoleProgress": "false",
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def series(spark):
    """Rows ``(entity, ts text, value)`` as a table with a zone-free timestamp."""

    def make(rows, value_type="double"):
        df = spark.createDataFrame(rows, f"entity string, t string, value {value_type}")
        return df.selectExpr("entity", "cast(t as timestamp_ntz) ts", "value")

    return make
