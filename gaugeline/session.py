"""Where shared intermediate files go, and the session settings this library is tuned for."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster session should carry; none of them is required for right results.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names. Only a local session without one gets a fresh folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="gaugeline-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path under the shared folder."""
    return f"{shared_root(spark)}/gaugeline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return owning(spark.read.schema(df.schema).parquet(path), path)


def owning(df: DataFrame, path: str | None) -> DataFrame:
    """Notes that ``df`` reads ``path`` of the shared folder."""
    df._scratch_path = path
    return df


def scratch_of(df: DataFrame) -> str | None:
    return df.__dict__.get("_scratch_path")


def release(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = scratch_of(df)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Queries that end within leave no shuffle files, which else stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
