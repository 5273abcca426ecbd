"""Filings and their facts: dedupe, growth windows, joins, set operations, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import ratio, rounded
from tickforge.operators.facts import as_of, difference, growth_window, latest_wins
from tickforge.plans.registry import query
from tickforge.sources.tables import BARS_SQL, FACTS_SQL, STOCKS_SQL, bars_daily, facts, stocks, table

WINNERS_SQL = "winners AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY k, fy, segment ORDER BY submitted_at DESC, doc_id) = 1)"
YEARS_SQL = "years AS (SELECT k, fy, sum(amount) AS amount FROM winners GROUP BY k, fy)"
WINDOW_SQL = """w AS (SELECT k, min(fy) AS first_fy, max(fy) AS last_fy, count(*) AS n_years, arg_min(amount, fy) AS first, arg_max(amount, fy) AS last, max(amount) FILTER (n = 2) AS previous
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fy DESC) AS n FROM years) WHERE n <= 5 GROUP BY k)"""
GROWTH_SQL = f"""{FACTS_SQL}, {WINNERS_SQL}, {YEARS_SQL}, {WINDOW_SQL}, growth AS (
  SELECT *, CASE WHEN first > 0 AND last > 0 AND last_fy > first_fy THEN pow(last / first, 1.0 / (last_fy - first_fy)) - 1 END AS cagr, CASE WHEN previous > 0 THEN last / previous - 1 END AS yoy, n_years < last_fy - first_fy + 1 AS gap FROM w)"""


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_wins(facts(spark, sf_dir), ["k", "fy", "segment"], "submitted_at", "doc_id")


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth_window(winners(spark, sf_dir).groupBy("k", "fy").agg(F.sum("amount").alias("amount")))


@query(f"WITH {FACTS_SQL}, {WINNERS_SQL} SELECT k, fy, segment, amount, submitted_at, doc_id FROM winners")
def latest_doc_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(spark, sf_dir).select("k", "fy", "segment", "amount", "submitted_at", "doc_id")


@query(f"WITH {GROWTH_SQL} SELECT k, first_fy, last_fy, n_years, round(first, 2) AS first, round(last, 2) AS last, round(cagr, 6) AS cagr, round(yoy, 6) AS yoy, gap FROM growth", name="growth_window")
def growth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth(spark, sf_dir).select("k", "first_fy", "last_fy", "n_years", rounded("first", 2).alias("first"), rounded("last", 2).alias("last"), rounded("cagr", 6).alias("cagr"), rounded("yoy", 6).alias("yoy"), "gap")


@query(f"WITH {GROWTH_SQL} SELECT g.k, c_name AS name, round(cagr, 6) AS cagr, round(yoy, 6) AS yoy FROM growth g JOIN customer ON c_custkey = g.k WHERE n_years >= 3 AND cagr >= 0.05 AND c_acctbal > 0 ORDER BY g.cagr DESC NULLS LAST, g.k LIMIT 100")
def growth_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 customers of the steepest growth, at least three years seen and a positive balance."""
    names = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    found = growth(spark, sf_dir).where("n_years >= 3 and cagr >= 0.05").join(names, "k")
    return found.orderBy(F.desc_nulls_last("cagr"), "k").limit(100).select("k", "name", rounded("cagr", 6).alias("cagr"), rounded("yoy", 6).alias("yoy"))


@query(f"WITH {GROWTH_SQL} SELECT y.k, y.fy, round(y.amount, 2) AS amount, round(CASE WHEN lag(y.amount) OVER o > 0 THEN y.amount / lag(y.amount) OVER o - 1 END, 6) AS yoy FROM years y WINDOW o AS (PARTITION BY k ORDER BY fy)")
def yoy_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = winners(spark, sf_dir).groupBy("k", "fy").agg(F.sum("amount").alias("amount"))
    before = F.lag("amount").over(Window.partitionBy("k").orderBy("fy"))
    return years.select("k", "fy", rounded("amount", 2).alias("amount"), rounded(F.when(before > 0, ratio("amount", before) - 1), 6).alias("yoy"))


@query(f"WITH {GROWTH_SQL} SELECT g.k, round(g.cagr, 6) AS cagr FROM growth g WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = g.k AND o.o_orderstatus = 'P' AND year(o.o_orderdate) BETWEEN g.first_fy AND g.last_fy)")
def hold_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of those without an open correction (status P) within their window: equi keys with a range residual."""
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("ok"), F.year("o_orderdate").alias("oy")).distinct()
    g = growth(spark, sf_dir)
    return g.join(open_, (g.k == open_.ok) & F.col("oy").between(g.first_fy, g.last_fy), "left_anti").select("k", rounded("cagr", 6).alias("cagr"))


@query(f"WITH {GROWTH_SQL} SELECT g.k, round(CASE WHEN held THEN NULL ELSE g.cagr END, 6) AS cagr, held FROM (SELECT g.*, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = g.k AND o.o_orderstatus = 'P' AND year(o.o_orderdate) > g.first_fy AND year(o.o_orderdate) <= g.last_fy) AS held FROM growth g) g")
def reported_growth_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth that is null where a correction falls after the window's first year, and whether it was held."""
    last = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("oy")).distinct()
    g = growth(spark, sf_dir)
    hit = g.join(last, "k").where((F.col("oy") > F.col("first_fy")) & (F.col("oy") <= F.col("last_fy"))).select("k", F.lit(True).alias("hit")).distinct()
    held = F.coalesce("hit", F.lit(False))
    return g.join(hit, "k", "left").select("k", rounded(F.when(~held, F.col("cagr")), 6).alias("cagr"), held.alias("held"))


@query(f"WITH {BARS_SQL} SELECT s.k, s.asked, b.d AS priced, round(b.c, 4) AS price FROM (SELECT k, CAST(make_date(y, 12, 31) AS DATE) AS asked FROM (SELECT DISTINCT k FROM bars), generate_series(1995, 2001) AS g(y)) s ASOF LEFT JOIN bars b ON s.k = b.k AND s.asked >= b.d")
def asof_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stock's last close on or before the year's end."""
    bars = bars_daily(spark, sf_dir)
    asked = bars.select("k").distinct().withColumn("asked", F.explode(F.transform(F.sequence(F.lit(1995), F.lit(2001)), lambda y: F.make_date(y, F.lit(12), F.lit(31)))))
    return as_of(asked, bars, "k", "asked", "d", ["c"]).select("k", "asked", F.col("d").alias("priced"), rounded("c").alias("price"))


@query("SELECT c_custkey AS k, o_orderkey AS doc_id, o_totalprice AS forecast FROM customer JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def latest_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return best.join(known, "k", "left_semi").select("k", F.col("o.o_orderkey").alias("doc_id"), F.col("o.o_totalprice").alias("forecast"))


@query("SELECT k, count(*) AS runs FROM (SELECT user_id AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n <= 3 GROUP BY k HAVING count(*) = 3 AND max(value) < 60")
def idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last three runs all stayed under 60."""
    newest = Window.partitionBy("k").orderBy(F.desc("ts"), F.desc("event_id"))
    runs = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("k"), "value", "ts", "event_id").withColumn("n", F.row_number().over(newest)).where("n <= 3")
    return runs.groupBy("k").agg(F.count(F.lit(1)).alias("runs"), F.max("value").alias("most")).where("runs = 3 and most < 60").select("k", "runs")


@query("SELECT r_name AS region, count(*) AS suppliers, CAST(sum(CASE WHEN l.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS covered, min(CASE WHEN l.k IS NULL THEN s_name END) AS first_missing FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.08) l ON l.k = s_suppkey GROUP BY r_name")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    traded = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49 and l_discount > 0.08").select(F.col("l_suppkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    rows = stocks(spark, sf_dir).where("region is not null").join(traded, "k", "left")
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("suppliers"), F.count("hit").alias("covered"), F.min(F.when(F.col("hit").isNull(), F.col("name"))).alias("first_missing"))


@query("SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at, o_orderstatus AS status FROM orders UNION ALL SELECT 'event', event_id, ts, NULL FROM events WHERE event_type = 'signup'")
def union_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"))
    seen = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return filed.unionByName(seen, allowMissingColumns=True)


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 UNION SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_tax = 0.08 AND l_quantity < 3")
def affected_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks that any of three kinds of observations touches, each once."""
    lines = table(spark, sf_dir, "lineitem")
    split = lines.where("l_quantity = 50 and l_discount > 0.09").select(F.col("l_suppkey").alias("k"))
    filed = lines.where("l_returnflag = 'R' and l_tax = 0.08 and l_quantity < 3").select(F.col("l_suppkey").alias("k"))
    return split.union(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("k"))).union(filed).distinct()


@query(f"WITH {STOCKS_SQL} SELECT DISTINCT sector FROM stocks WHERE is_active AND sector IS NOT NULL")
def distinct_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stocks(spark, sf_dir).where("is_active and sector is not null").select("sector").distinct()


@query("WITH a AS (SELECT c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT c_nationkey AS n FROM customer WHERE c_mktsegment = 'MACHINERY') SELECT 'left' AS side, n FROM (SELECT n FROM a EXCEPT ALL SELECT n FROM b) UNION ALL SELECT 'right', n FROM (SELECT n FROM b EXCEPT ALL SELECT n FROM a)")
def snapshot_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two snapshots do not share, as bags."""
    rows = table(spark, sf_dir, "customer")
    of = lambda name: rows.where(F.col("c_mktsegment") == name).select(F.col("c_nationkey").alias("n"))
    return difference(of("BUILDING"), of("MACHINERY"))


@query(f"WITH {BARS_SQL} SELECT k, CAST(day AS DATE) AS missing FROM (SELECT k, unnest(generate_series(CAST(date_trunc('month', max(d)) AS DATE), max(d), INTERVAL 1 DAY)) AS day FROM bars GROUP BY k) WHERE dayofweek(day) NOT IN (0, 6) AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.k = k AND b.d = day)".replace("b.k = k AND", "b.k = c.k AND").replace("GROUP BY k) WHERE", "GROUP BY k) c WHERE"))
def gap_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays of each stock's last month that have no bar."""
    bars = bars_daily(spark, sf_dir).select("k", "d")
    days = bars.groupBy("k").agg(F.max("d").alias("end")).select("k", F.explode(F.sequence(F.trunc("end", "MM"), F.col("end"))).alias("d")).where(~F.dayofweek("d").isin(1, 7))
    return days.join(bars, ["k", "d"], "left_anti").select("k", F.col("d").alias("missing"))


@query(f"WITH {BARS_SQL}, {STOCKS_SQL} SELECT d FROM bars JOIN stocks USING (k) WHERE region = 'ASIA' INTERSECT SELECT d FROM bars JOIN stocks USING (k) WHERE region = 'EUROPE'")
def joint_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir).select("k", "d").join(stocks(spark, sf_dir).select("k", "region"), "k")
    return bars.where("region = 'ASIA'").select("d").intersect(bars.where("region = 'EUROPE'").select("d"))


@query("SELECT p_brand AS brand, CASE count(DISTINCT p_partkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) END AS id FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT p_brand, p_partkey FROM part WHERE p_size = 50 AND p_type = 'PROMO') USING (p_brand) GROUP BY p_brand")
def unique_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that exactly one row answers to; none and many are refused."""
    part = table(spark, sf_dir, "part")
    hits = part.where("p_size = 50 and p_type = 'PROMO'").select(F.col("p_brand").alias("brand"), "p_partkey").distinct().groupBy("brand").agg(F.count("p_partkey").alias("n"), F.min("p_partkey").alias("least"))
    n = F.coalesce("n", F.lit(0))
    return part.select(F.col("p_brand").alias("brand")).distinct().join(hits, "brand", "left").select("brand", F.when(n == 0, "missing").when(n == 1, "ok").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("least")).alias("id"))


@query("SELECT s_name AS name, coalesce(status, 'unknown') AS status FROM (SELECT s_name, CASE WHEN s_acctbal < 0 THEN 'suspended' WHEN o.k IS NULL THEN 'not_traded' ELSE 'ok' END AS status FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-25') o ON o.k = s_suppkey)")
def missing_key_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    traded = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '2001-10-25'").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("hit", F.lit(True))
    rows = table(spark, sf_dir, "supplier").join(traded, "s_suppkey", "left")
    return rows.select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "suspended").when(F.col("hit").isNull(), "not_traded").otherwise("ok").alias("status"))


@query("SELECT coalesce(a.k, b.k) AS k, a.orders, b.views FROM (SELECT o_custkey AS k, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL OUTER JOIN (SELECT user_id AS k, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.k = b.k")
def projection_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    b = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("views"))
    return a.join(b, "k", "full_outer").select("k", "orders", "views")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS doc_id, o_orderdate AS stamp, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS i FROM orders WHERE (o_custkey, o_orderkey) > (20, 300)) SELECT k, doc_id, stamp AS at, (SELECT count(*) FROM p) > 50 AS more FROM p WHERE i <= 50""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty rows behind a key in two parts, and whether there are more: one row more than a page is asked for."""
    behind = (F.col("o_custkey") > 20) | ((F.col("o_custkey") == 20) & (F.col("o_orderkey") > 300))
    asked = table(spark, sf_dir, "orders").where(behind).orderBy("o_custkey", "o_orderkey").limit(51)
    rows = asked.withColumn("i", F.row_number().over(Window.orderBy("o_custkey", "o_orderkey")))  # a bounded page
    more = rows.agg((F.count(F.lit(1)) > 50).alias("more"))
    return rows.where("i <= 50").crossJoin(F.broadcast(more)).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("at"), "more")


@query("SELECT n_name AS sector, s_name AS name, s_acctbal AS score, CAST(n AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) JOIN nation ON n_nationkey = s_nationkey WHERE n <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("sector").orderBy(F.desc("s_acctbal"), "s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "sector")
    return rows.withColumn("place", F.row_number().over(best)).where("place <= 3").select("sector", F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"), "place")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM orders o2 WHERE o2.o_custkey = orders.o_custkey AND (o2.o_orderdate, o2.o_orderkey) > (orders.o_orderdate, orders.o_orderkey))")
def no_later_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer where it is still open: the correlated anti join as one aggregate."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("o")).where("o.o_orderstatus = 'P'")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return last.join(names, "o_custkey").select(F.col("o.o_orderstatus").alias("status"), F.col("o.o_orderpriority").alias("priority"), "name")


@query("SELECT o_custkey AS k, list_sort(list(DISTINCT month(o_orderdate))) AS months, bool_or(o_orderstatus = 'P') AS any_open FROM orders GROUP BY o_custkey".replace("list_sort(list(DISTINCT month(o_orderdate)))", "array_to_string(list_sort(list(DISTINCT month(o_orderdate))), ',')"))
def month_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_set(F.month("o_orderdate"))).alias("m"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_open"))
    return rows.select("k", F.array_join(F.col("m").cast("array<string>"), ",").alias("months"), "any_open")


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag HAVING count(*) > 100")
def having_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n")).where("n > 100")

