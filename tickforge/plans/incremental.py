"""JSON columns, maps, revisions, merges and other state that grows run by run; streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import rounded
from tickforge.operators.facts import revisions
from tickforge.plans.registry import query
from tickforge.sources.tables import table
from tickforge.streaming import events as stream


@query("SELECT event_id AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (7, 42, 99)")
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), n.alias("n")).where(F.col("n").isin(7, 42, 99))


@query("SELECT user_id AS k, CASE WHEN len(s) = 0 THEN NULL ELSE '[' || array_to_string(s, ',') || ']' END AS months FROM (SELECT user_id, list_sort(list(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) FILTER (event_type = 'purchase' AND value > 100)) AS s FROM events GROUP BY user_id)".replace("len(s) = 0", "s IS NULL OR len(s) = 0"))
def json_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct values per key as JSON, null where the set is empty."""
    n = F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), F.from_json("props", "k bigint")["k"])
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.sort_array(F.collect_set(n)).alias("s"))
    return g.select("k", F.when(F.size("s") > 0, F.to_json("s")).alias("months"))


@query("SELECT user_id AS k, event_type AS series, CAST(ts AS DATE) AS day, round(sum(value), 2) AS total FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def map_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of series to points per key, built and unfolded again."""
    points = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    series = points.groupBy("k", "series").agg(F.collect_list(F.struct("day", "total")).alias("points"))
    maps = series.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("series", "points"))).alias("m"))
    return maps.select("k", F.explode("m").alias("series", "points")).select("k", "series", F.inline("points")).select("k", "series", "day", rounded("total", 2).alias("total"))


@query("""WITH c AS (SELECT user_id AS k, ts, event_id, event_type AS value FROM events), x AS (SELECT * FROM c QUALIFY value IS DISTINCT FROM lag(value) OVER (PARTITION BY k ORDER BY ts, event_id) OR row_number() OVER (PARTITION BY k ORDER BY ts, event_id) = 1)
SELECT k, event_id, value, CAST(row_number() OVER o AS INT) AS revision, lead(ts) OVER o AS valid_to FROM x WINDOW o AS (PARTITION BY k ORDER BY ts, event_id)""")
def scd2_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", "event_id", F.col("event_type").alias("value"))
    return revisions(rows, "k", ["ts", "event_id"], "value").select("k", "event_id", "value", "revision", "valid_to")


@query("""WITH e AS (SELECT user_id AS k, CAST(ts AS DATE) AS d, event_id, value, ts >= TIMESTAMP '2024-01-20' AS fresh FROM events) SELECT k, d, arg_max(value, {'f': fresh, 'e': event_id}) AS value FROM e WHERE d >= DATE '2024-01-10' GROUP BY k, d""")
def merge_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and fresh rows by (key, day), the fresh one wins, days before the cutoff go."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("d"), "event_id", "value", (F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).alias("fresh"))
    old, new = rows.where("not fresh"), rows.where("fresh")
    return old.unionByName(new).where("d >= date '2024-01-10'").groupBy("k", "d").agg(F.max_by("value", F.struct("fresh", "event_id")).alias("value"))


@query("SELECT user_id AS k, event_type AS kind, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("kind")).agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN s_suppkey IS NULL THEN 'insert' WHEN s_acctbal < 0 THEN 'deactivate' WHEN s_nationkey <> c_nationkey THEN 'transfer' ELSE 'keep' END AS action FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey) GROUP BY action""")
def overlay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying a newer listing to the master would do, by action."""
    master = table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "customer").join(master, F.col("s_suppkey") == F.col("c_custkey"), "left")
    action = F.when(F.col("s_suppkey").isNull(), "insert").when(F.col("s_acctbal") < 0, "deactivate").when(F.col("s_nationkey") != F.col("c_nationkey"), "transfer").otherwise("keep")
    return rows.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, month, indicator, round(value, 2) AS value, round(value - lag(value) OVER (PARTITION BY k, indicator ORDER BY month), 2) AS change FROM (SELECT k, month, unnest(['flow', 'count']) AS indicator, unnest([flow, CAST(n AS DOUBLE)]) AS value FROM (SELECT event_type AS k, strftime(ts, '%Y-%m-%d') AS month, sum(value) AS flow, count(*) AS n FROM events GROUP BY ALL))")
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide figures as long observations with the change against the slot before."""
    wide = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("month")).agg(F.sum("value").alias("flow"), F.count(F.lit(1)).cast("double").alias("count"))
    long = wide.unpivot(["k", "month"], ["flow", "count"], "indicator", "value")
    before = F.lag("value").over(Window.partitionBy("k", "indicator").orderBy("month"))
    return long.select("k", "month", "indicator", rounded("value", 2).alias("value"), rounded(F.col("value") - before, 2).alias("change"))


@query("SELECT event_type, date_trunc('hour', ts) AS ts, arg_min(value, {'a': ts, 'b': event_id}) AS o, max(value) AS h, min(value) AS l, arg_max(value, {'a': ts, 'b': event_id}) AS c, count(*) AS v FROM events GROUP BY event_type, date_trunc('hour', ts)")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.run(spark, stream.bars(stream.source(spark, sf_dir)), "update", ["event_type", "ts"])


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.run(spark, stream.first_of_day(stream.source(spark, sf_dir)), "append", [])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, nth""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.run(spark, stream.sessions(stream.source(spark, sf_dir)), "complete", ["user_id", "start"])
