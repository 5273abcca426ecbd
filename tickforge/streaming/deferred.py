"""Runs that leave their open minute to the next one, and the reconciliation that settles what was left.

Each micro-batch looks at its rows and at the tail that the batch before it left. Rows before the cutoff (the minute of the newest
row) are settled; the others are its tail. Both are written under the batch's number and read by number alone, so a batch that is run again after
a failure writes the same again. closed() settles the last tail, when no more rows of its time can come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def cutoff(rows: DataFrame, stamp: str) -> DataFrame:
    """One row: `cutoff`, the minute of the newest row; null without rows, and then nothing is settled."""
    return rows.agg(F.date_trunc("minute", F.max(stamp)).alias("cutoff"))


def settle(batch: DataFrame, number: int, path: str, key: str, stamp: str) -> None:
    """One batch: tail of the batch before and new rows, a key once (its newest row), settled before the cutoff, else left to the next."""
    spark = batch.sparkSession
    rows = batch
    if number:
        rows = spark.read.schema(batch.schema).parquet(f"{path}/tail/batch={number - 1}").unionByName(batch)
    rest = [c for c in batch.columns if c != key]
    rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(stamp, F.xxhash64(*rest))).alias("row")).select(key, "row.*").select(*batch.columns)
    cut = rows.crossJoin(F.broadcast(cutoff(rows, stamp)))
    settled = F.coalesce(F.col(stamp) < F.col("cutoff"), F.lit(False))
    cut.where(settled).drop("cutoff").write.mode("overwrite").parquet(f"{path}/settled/batch={number}")
    cut.where(~settled).drop("cutoff").write.mode("overwrite").parquet(f"{path}/tail/batch={number}")


def run(stream: DataFrame, path: str, key: str, stamp: str) -> None:
    """One run over what is new in the source since the last run on this path. A run without new rows is none."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: settle(batch, number, path, key, stamp))
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def _numbered(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)


def settled(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The settled rows with `batch`, the number of the batch that settled them."""
    return _numbered(spark, schema, f"{path}/settled")


def closed(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The settled rows and, as of one batch more, the last tail: the day is closed, no cutoff holds any more."""
    tails = _numbered(spark, schema, f"{path}/tail")
    newest = tails.agg(F.max("batch").alias("newest"))
    left = tails.join(F.broadcast(newest), F.col("batch") == F.col("newest")).withColumn("batch", F.col("batch") + 1).drop("newest")
    return settled(spark, schema, path).unionByName(left)


def compared(official: DataFrame, other: DataFrame, key: str, stamp: str, group: Column) -> DataFrame:
    """(day, cutoff, expected, official_n, deferred, only_official, only_other, status): two sources of one list, compared before each day's cutoff.

    The cutoff is the minute of the other source's newest row of the day; rows on or after it are deferred. Ids are compared, not numbers:
    a day matches if no id before the cutoff is in one source alone.
    """
    own = other.select(key, stamp, group.alias("day"))
    cuts = own.groupBy("day").agg(F.date_trunc("minute", F.max(stamp)).alias("cutoff"))
    sides = lambda df, name: df.select(key, F.col(stamp).alias(f"{name}_at"), group.alias("day"))
    both = sides(official, "a").join(own.select(key, F.col(stamp).alias("b_at"), "day"), ["day", key], "full_outer").join(cuts, "day")
    a, b = F.coalesce(F.col("a_at") < F.col("cutoff"), F.lit(False)), F.coalesce(F.col("b_at") < F.col("cutoff"), F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    found = both.groupBy("day", "cutoff").agg(count(b).alias("expected"), count(a).alias("official_n"), count(F.col("b_at") >= F.col("cutoff")).alias("deferred"), count(a & ~b).alias("only_official"), count(b & ~a).alias("only_other"))
    return found.withColumn("status", F.when((F.col("only_official") == 0) & (F.col("only_other") == 0), "match").otherwise("count_mismatch"))
