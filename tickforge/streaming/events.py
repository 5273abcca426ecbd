"""Streaming twins of the bar, dedupe and session queries, over a folder or file of events.

A drained source leaves its last windows open, so results are not appended as windows close: each micro-batch writes the windows it
touched (or, for sessions, all of them), and a window's last version counts. Nothing of the input is missing
then, and state stays what the watermark lets it be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickforge.sources.shared import fresh_path

LATE = "1 day"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may be a folder, as Spark writes it, or a single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def bars(events: DataFrame) -> DataFrame:
    """Hourly bars per event type; state is one row per open window and type."""
    order = F.struct("ts", "event_id")
    found = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.min_by("value", order).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", order).alias("c"), F.count(F.lit(1)).alias("v"))
    return found.select("event_type", F.col("window.start").alias("ts"), "o", "h", "l", "c", "v")


def first_of_day(events: DataFrame) -> DataFrame:
    """One event per user, type and day; what the watermark has passed is forgotten."""
    return events.withColumn("day", F.to_date("ts")).dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def sessions(events: DataFrame) -> DataFrame:
    """Sessions of a user, over after six hours without an event."""
    found = events.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """What is there once the source is drained, from a table in the shared folder: checkpoint and sink survive a lost executor.

    mode: "update" (a key's last version counts), "complete" (the last batch counts) or "append".
    """
    path = fresh_path(spark)

    def keep(rows: DataFrame, batch: int) -> None:
        # A batch that is run again after a failure replaces what it wrote.
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch").drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*(F.col("row")[c].alias(c) if c in rest else c for c in stream.columns))
