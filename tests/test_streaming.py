"""Streams over a folder of files, and what a drained source leaves."""

from pyspark.sql import functions as F

from tickforge.plans import incremental


def test_streams_read_folders_and_drop_no_window(spark, tmp_path):
    sf = str(tmp_path)
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(f"{sf}/events.parquet")
    bars = incremental.stream_bars(spark, sf)
    assert bars.agg(F.sum("v")).first()[0] == rows.count()
    assert incremental.stream_session(spark, sf).agg(F.sum("n")).first()[0] == rows.count()
    want = rows.select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()
    got = incremental.stream_dedupe(spark, sf)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_window_keeps_its_last_version(spark, tmp_path):
    """Two files in two micro-batches, the second one late but within the watermark."""
    from tickforge.streaming import events as stream

    sf = str(tmp_path)
    make = lambda *rows: spark.createDataFrame([(i, t, 1, "view", v) for i, t, v in rows], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    make((1, "2024-01-01 10:10:00", 5.0), (2, "2024-01-01 12:00:00", 7.0)).write.parquet(f"{sf}/events.parquet")
    first = spark.read.parquet(f"{sf}/events.parquet").schema
    make((3, "2024-01-01 10:50:00", 9.0)).write.mode("append").parquet(f"{sf}/events.parquet")
    rows = spark.readStream.schema(first).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parque[t]").withWatermark("ts", stream.LATE)
    got = {str(r["ts"]): (r["o"], r["h"], r["c"], r["v"]) for r in stream.run(spark, stream.bars(rows), "update", ["event_type", "ts"]).collect()}
    assert got == {"2024-01-01 10:00:00": (5.0, 9.0, 9.0, 2), "2024-01-01 12:00:00": (7.0, 7.0, 7.0, 1)}
