"""Numbers of a total order over many ranges, read with the rows' other columns."""

from pyspark.sql import functions as F

from tickforge.operators.series import numbered


def test_numbers_over_many_ranges_are_exact_and_no_row_is_lost(spark):
    n = 300_000
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(n).select("id", F.xxhash64("id").alias("score"), (F.col("id") % 7).alias("tie"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
        got, seen = numbered(rows, F.desc("score"), F.col("id"), name="place", observed=[F.count(F.lit(1)).alias("n")])
        out = got.agg(F.count(F.lit(1)), F.countDistinct("place"), F.min("place"), F.max("place"), F.countDistinct("id"), F.countDistinct("more")).first()
        assert seen["n"] == n and tuple(out) == (n, n, 1, n, n, n)
        order = [r.id for r in got.where("place <= 1000").orderBy("place").select("id").collect()]
        assert order == [r.id for r in rows.orderBy(F.desc("score"), "id").limit(1000).collect()]
        ties, _ = numbered(rows, F.col("tie"), name="place")
        assert ties.where(f"tie = 0 and place > {n // 7 + 1} or tie = 6 and place <= {n - n // 7 - 1}").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_an_empty_table_is_numbered(spark):
    got, _ = numbered(spark.range(0), F.col("id"), name="place")
    assert got.columns == ["id", "place"] and got.count() == 0
