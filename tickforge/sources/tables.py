"""Tables of a scale-factor folder and the views that the analytics stand on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all tasks by a key: a small file of many rows is few tasks' work, which counts where a row takes long."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, d, o, h, l, c, v, n): daily bars per supplier; a trade's price is extended price over quantity."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    trades = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"), price.alias("p"), order.alias("t"), F.col("l_quantity").alias("q"))
    return trades.groupBy("k", "d").agg(F.min_by("p", "t").alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", "t").alias("c"), F.sum("q").alias("v"), F.count(F.lit(1)).alias("n"))


def bars_minutes(spark: SparkSession, sf_dir: str, minutes: int = 5) -> DataFrame:
    """(k, ts, o, h, l, c, v): bars of `minutes` per user; every event is one trade of one unit."""
    start = F.timestamp_seconds((F.unix_timestamp("ts") / (60 * minutes)).cast("long") * 60 * minutes)
    order = F.struct("ts", "event_id")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), start.alias("bucket"), order.alias("t"), "value")
    return events.groupBy("k", F.col("bucket").alias("ts")).agg(F.min_by("value", "t").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "t").alias("c"), F.count(F.lit(1)).alias("v"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, c): the index, the mean close of all bars of a day."""
    return bars_daily(spark, sf_dir).groupBy("d").agg(F.avg("c").alias("c"))


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, code, name, sector, region, is_active)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(dim), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("s_suppkey").alias("k"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"), F.col("r_name").alias("region"), (F.col("s_acctbal") > 0).alias("is_active"))
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, fy, segment, amount, submitted_at, doc_id): an order is a filing of its customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("fy"), F.col("o_orderpriority").alias("segment"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("submitted_at"), F.col("o_orderkey").alias("doc_id"))


# The same views for the SQL that checks the queries.
BARS_SQL = """bars AS (
  SELECT k, d, arg_min(p, t) AS o, max(p) AS h, min(p) AS l, arg_max(p, t) AS c, sum(q) AS v, count(*) AS n FROM (
    SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS p, l_quantity AS q,
      {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'e': l_extendedprice} AS t FROM lineitem) GROUP BY k, d)"""
MARKET_SQL = "market AS (SELECT d, avg(c) AS c FROM bars GROUP BY d)"
STOCKS_SQL = """stocks AS (
  SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS code, s_name AS name, n_name AS sector, r_name AS region, s_acctbal > 0 AS is_active
  FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey)"""
FACTS_SQL = """facts AS (
  SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS fy, o_orderpriority AS segment, o_totalprice AS amount, o_orderdate AS submitted_at, o_orderkey AS doc_id FROM orders)"""
MINUTES_SQL = """minutes AS (
  SELECT k, ts, arg_min(value, t) AS o, max(value) AS h, min(value) AS l, arg_max(value, t) AS c, count(*) AS v FROM (
    SELECT user_id AS k, to_timestamp(CAST(floor(epoch(ts) / 300) AS BIGINT) * 300) AT TIME ZONE 'UTC' AS ts, value, {'a': ts, 'b': event_id} AS t FROM events) GROUP BY k, ts)"""
