"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, Observation, SparkSession

#: Lets Spark delete a write's shuffle files as soon as the write is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none need be set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_dir()
    return base


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that is not there yet; what comes to be there goes when the application ends, at the latest."""
    path = f"{shared_dir(spark)}/tickforge-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, *observed) -> tuple[DataFrame, dict]:
    """df as a Parquet table in the shared folder, and the values of the aggregates in `observed`.

    Cuts lineage and survives lost executors. The write's shuffle files go with it.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    if observed:
        seen = Observation()
        df = df.observe(seen, *observed)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), (seen.get if observed else {}) | {"path": path}


def drop_table(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
