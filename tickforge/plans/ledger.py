"""Quality gates, holds, merges, queues, sweeps, observations and extracted facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import ratio, rounded
from tickforge.operators import ledger
from tickforge.plans.registry import query
from tickforge.sources.tables import BARS_SQL, STOCKS_SQL, bars_daily, stocks, table

BROKEN_SQL = "b AS (SELECT k, d, h, CASE WHEN n % 41 = 0 THEN h + 1 ELSE l END AS l, CASE WHEN k % 7 = 0 AND day(d) = 13 THEN -1 WHEN day(d) = 17 THEN c * 30 WHEN day(d) = 5 THEN NULL ELSE c END AS c, CASE WHEN day(d) IN (17, 18) THEN 0 ELSE v END AS v FROM bars)"


@query(f"""WITH RECURSIVE {BARS_SQL}, {BROKEN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM b), w AS (
  SELECT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS d, CAST(NULL AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT k FROM bars)
  UNION ALL SELECT k, i, d, c, CASE WHEN reason IS NULL AND c IS NOT NULL THEN c ELSE last END, reason FROM (
    SELECT r.k, r.i, r.d, r.c, w.last, CASE WHEN r.c <= 0 THEN 'non_positive_close' WHEN r.h < r.l THEN 'high_low_inverted' WHEN coalesce(r.v, 0) = 0 AND (r.c / w.last > 10 OR r.c / w.last < 0.1) THEN 'jump_without_volume' END AS reason FROM w JOIN r ON r.k = w.k AND r.i = w.i + 1))
SELECT k, d, round(c, 4) AS c, reason FROM w WHERE reason IS NOT NULL""")
def refused_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that a sanitiser refuses, each against the last accepted close (some of the bars are broken for it)."""
    day = F.dayofmonth("d")
    rows = bars_daily(spark, sf_dir).select("k", "d", "h", F.when(F.col("n") % 41 == 0, F.col("h") + 1).otherwise(F.col("l")).alias("l"), F.when((F.col("k") % 7 == 0) & (day == 13), -1.0).when(day == 17, F.col("c") * 30).when(day != 5, F.col("c")).alias("c"), F.when(day.isin(17, 18), 0.0).otherwise(F.col("v")).alias("v"))
    return ledger.sanitised(rows).where("reason is not null").select("k", "d", rounded("c").alias("c"), "reason")


@query(f"""WITH {BARS_SQL}, w AS (SELECT k, min(d) AS first, max(d) AS last, count(*) AS n FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) <= 60) GROUP BY k), s AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS at FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R' AND l_discount > 0.09)
SELECT w.k, first, last, n, EXISTS (SELECT 1 FROM s WHERE s.k = w.k AND s.at > w.first AND s.at <= w.last) AS held, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.k = w.k AND s.at > w.first AND s.at <= w.last) THEN NULL ELSE round(m, 4) END AS mean FROM w JOIN (SELECT k, avg(c) AS m FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) <= 60) GROUP BY k) USING (k)""")
def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a stock's last 60 bars, its mean, and null instead where a split falls into it."""
    newest = Window.partitionBy("k").orderBy(F.desc("d"))
    windows = bars_daily(spark, sf_dir).withColumn("i", F.row_number().over(newest)).where("i <= 60").groupBy("k").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n"), F.avg("c").alias("m"))
    splits = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_returnflag = 'R' and l_discount > 0.09").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("at"))
    rows = ledger.held(windows, splits, "k", "first", "last", "at", "held")
    return rows.select("k", "first", "last", "n", "held", rounded(F.when(~F.col("held"), F.col("m"))).alias("mean"))


@query("""WITH o AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderdate AS stamp, CASE WHEN o_orderstatus = 'P' THEN 3 WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS license, year(o_orderdate) >= 2000 AS fresh, o_orderkey AS id FROM orders),
a AS (SELECT k, arg_max(v, {'t': stamp, 'i': id}) AS v, max(stamp) AS stamp, arg_max(license, {'t': stamp, 'i': id}) AS license FROM o WHERE NOT fresh GROUP BY k), b AS (SELECT k, arg_min(v, {'t': stamp, 'i': id}) AS v, min(stamp) AS stamp, arg_min(license, {'t': stamp, 'i': id}) AS license FROM o WHERE fresh GROUP BY k)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL OR b.stamp >= a.stamp THEN b.v ELSE a.v END AS v, CASE WHEN a.k IS NULL OR b.stamp >= a.stamp THEN b.stamp ELSE a.stamp END AS stamp, greatest(a.license, b.license) AS license FROM a FULL OUTER JOIN b ON a.k = b.k""")
def upsert_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows and newer ones by key: the later disclosure wins, the stricter license stays."""
    license_ = F.when(F.col("o_orderstatus") == "P", 3).when(F.col("o_orderstatus") == "F", 2).otherwise(1)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.struct("o_orderdate", "o_orderkey").alias("t"), F.struct(F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("stamp"), license_.alias("license")).alias("row"))
    fresh = F.year("t.o_orderdate") >= 2000
    old = rows.where(~fresh).groupBy("k").agg(F.max_by("row", "t").alias("r")).select("k", "r.*")
    new = rows.where(fresh).groupBy("k").agg(F.min_by("row", "t").alias("r")).select("k", "r.*")
    return ledger.merged(old, new, ["k"], F.col("new.stamp") >= F.col("old.stamp"), "license")


@query("""WITH r AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1), q AS (SELECT d, 'new' AS why FROM r WHERE d > DATE '2024-01-20' AND failed <= 0.25 * n UNION ALL SELECT d, 'again' FROM r WHERE failed > 0.25 * n)
SELECT d, why FROM q ORDER BY d, why LIMIT 60""")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to work on: those since the last one done, and earlier ones of which too much failed; sixty at most."""
    r = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failed"))
    bad = F.col("failed") > 0.25 * F.col("n")
    return r.where(bad | (F.col("d") > F.lit("2024-01-20").cast("date"))).select("d", F.when(bad, "again").otherwise("new").alias("why")).orderBy("d", "why").limit(60)


@query("""WITH m AS (SELECT date_trunc('minute', max(ts)) AS cut, max(ts) AS last FROM events) SELECT CASE WHEN ts >= cut THEN 'deferred' WHEN ts >= last - INTERVAL 10 DAY AND ts <= last - INTERVAL 2 DAY AND value > 290 THEN 'gap' ELSE 'done' END AS state, count(*) AS n, min(event_id) AS first, max(event_id) AS final FROM events, m GROUP BY 1""")
def deferred_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last open minute wait for the next run; in a late window, those that need a child row and lack it are gaps."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    last = rows.agg(F.max("ts").alias("last"))
    back = lambda days: F.col("last") - F.make_dt_interval(days=F.lit(days))
    state = F.when(F.col("ts") >= F.date_trunc("minute", "last"), "deferred").when(F.col("ts").between(back(10), back(2)) & (F.col("value") > 290), "gap").otherwise("done")
    return rows.crossJoin(F.broadcast(last)).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("final"))


@query("""WITH d AS (SELECT user_id AS k, CAST(ts AS DATE) AS d, round(sum(value), 2) AS v FROM events GROUP BY ALL), r AS (SELECT *, round(lag(v) OVER (PARTITION BY k ORDER BY d), 2) AS p FROM d)
SELECT k, arg_max(d, d) AS d, arg_max(v, d) AS v, count(*) AS revision FROM (SELECT * FROM r WHERE p IS NULL OR abs(v - p) > 1) GROUP BY k""")
def current_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last revision of each key's daily figure; a day that moves it by one at most is no revision."""
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("d")).agg(rounded(F.sum("value"), 2).alias("v"))
    r = d.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("d"))).where(F.col("p").isNull() | (F.abs(F.col("v") - F.col("p")) > 1))
    return r.groupBy("k").agg(F.max("d").alias("d"), F.max_by("v", "d").alias("v"), F.count(F.lit(1)).alias("revision"))


@query("""WITH a AS (SELECT user_id AS k, list_sort(list(event_id) FILTER (event_id % 19 <> 0)) AS ids FROM events GROUP BY 1), b AS (SELECT user_id AS k, list_sort(list(event_id) FILTER (event_id % 23 <> 0 OR user_id % 2 = 0)) AS ids FROM events WHERE user_id % 11 <> 0 GROUP BY 1)
SELECT a.k, CASE WHEN b.k IS NULL OR b.ids IS NULL THEN 'vanished' WHEN len(b.ids) < len(a.ids) THEN 'shrunk' WHEN len(list_filter(a.ids, lambda x: NOT list_contains(b.ids, x))) > 0 THEN 'lost' WHEN a.ids = b.ids THEN 'same' ELSE 'grown' END AS verdict FROM a LEFT JOIN b ON a.k = b.k WHERE a.ids IS NOT NULL""")
def no_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new version of each key's set does to the stored one; anything but "same" and "grown" is refused, "same" is not written."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"))
    a = rows.where("id % 19 <> 0").withColumn("old", F.lit(True))
    b = rows.where("k % 11 <> 0 and (id % 23 <> 0 or k % 2 = 0)").withColumn("new", F.lit(True))
    both = a.join(b, ["k", "id"], "full_outer").groupBy("k").agg(F.count("old").alias("old"), F.count("new").alias("new"), F.count(F.when(F.col("new").isNull(), 1)).alias("lost")).where("old > 0")
    verdict = F.when(F.col("new") == 0, "vanished").when(F.col("new") < F.col("old"), "shrunk").when(F.col("lost") > 0, "lost").when(F.col("new") == F.col("old"), "same").otherwise("grown")
    return both.select("k", verdict.alias("verdict"))


@query(f"""WITH {BARS_SQL}, {STOCKS_SQL}, a AS (SELECT k, sector, max(d) AS d, arg_max(c * v, d) AS t FROM stocks LEFT JOIN bars USING (k) WHERE is_active GROUP BY k, sector), g AS (SELECT count(*) FILTER (d >= DATE '2001-08-01') * 1.0 / count(*) AS share FROM a)
SELECT coalesce(sector, 'unclassified') AS sector, count(*) FILTER (d >= DATE '2001-08-01') AS n, round(sum(t) FILTER (d >= DATE '2001-08-01'), 2) AS turnover, round(any_value(share), 4) AS covered FROM a, g WHERE share >= 0.9 GROUP BY 1""")
def sector_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector turnover of the stocks that are up to date; nothing at all unless nine in ten active stocks are."""
    last = bars_daily(spark, sf_dir).groupBy("k").agg(F.max("d").alias("d"), F.max_by(F.col("c") * F.col("v"), "d").alias("t"))
    rows = stocks(spark, sf_dir).where("is_active").select("k", "sector").join(last, "k", "left").withColumn("on", F.coalesce(F.col("d") >= F.lit("2001-08-01").cast("date"), F.lit(False)))
    gate = rows.agg((F.count(F.when(F.col("on"), 1)) / F.count(F.lit(1))).alias("share")).where("share >= 0.9")
    g = rows.groupBy(F.coalesce("sector", F.lit("unclassified")).alias("sector")).agg(F.count(F.when(F.col("on"), 1)).alias("n"), rounded(F.sum(F.when(F.col("on"), F.col("t"))), 2).alias("turnover"))
    return g.crossJoin(F.broadcast(gate)).select("sector", "n", "turnover", rounded("share").alias("covered"))


@query("""WITH t AS (SELECT l_partkey AS k, CAST(floor(l_quantity) AS BIGINT) * 100 AS shares, l_extendedprice / 1000 AS worth FROM lineitem WHERE l_discount > 0.02), m AS (SELECT k, min(shares) AS least FROM t GROUP BY k), v AS (SELECT k, least, sum(worth) AS worth FROM t JOIN m USING (k) WHERE shares <= least GROUP BY k, least)
SELECT k, least, round(CASE WHEN pct > 0 AND pct <= 50 THEN pct END, 1) AS pct FROM (SELECT k, least, worth / (p_retailprice * least) * 100 AS pct FROM v JOIN part ON p_partkey = k)""")
def tiered_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benefits that the least holding earns, in per cent of its price to one place; null at 0 and over 50 %."""
    t = table(spark, sf_dir, "lineitem").where("l_discount > 0.02").groupBy(F.col("l_partkey").alias("k"), (F.floor("l_quantity").cast("long") * 100).alias("shares")).agg(F.sum(F.col("l_extendedprice") / 1000).alias("worth"))
    v = t.groupBy("k").agg(F.min("shares").alias("least"), F.min_by("worth", "shares").alias("worth"))
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_retailprice")
    pct = ratio(F.col("worth"), F.col("p_retailprice") * F.col("least")) * 100
    return v.join(prices, "k").select("k", "least", pct.alias("p")).select("k", "least", rounded(F.when((F.col("p") > 0) & (F.col("p") <= 50), F.col("p")), 1).alias("pct"))


#: Names of a bucket of regions; a name of two buckets (here of a fifth of Asia) counts in none.
REGIONS = {"china": ["NATION_2"]} | {key: [f"NATION_{n}" for n in range(first, 25, 5)] for key, first in {"asia": 2, "europe": 3, "americas": 1}.items()}
OVERSEAS_SQL = "f AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS fy, date_trunc('year', o_orderdate) + CASE WHEN month(o_orderdate) > 6 THEN INTERVAL 6 MONTH ELSE INTERVAL 0 MONTH END AS stamp, CASE o_orderkey % 4 WHEN 0 THEN 'total' WHEN 1 THEN 'overseas_total' ELSE 'overseas' END AS kind, n_name AS region, o_totalprice AS yen FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


@query(f"""WITH {OVERSEAS_SQL}, b AS (SELECT *, list_filter([{", ".join(f"CASE WHEN region IN ({', '.join(repr(x) for x in names)}) THEN '{key}' END" for key, names in REGIONS.items())}], lambda x: x IS NOT NULL) AS keys FROM f), r AS (SELECT * FROM b WHERE kind <> 'overseas' OR len(keys) = 1),
w AS (SELECT * FROM r QUALIFY stamp = max(stamp) OVER (PARTITION BY k, fy)), y AS (SELECT k, fy, max(yen) FILTER (kind = 'overseas_total') AS overseas, max(yen) FILTER (kind = 'total') AS total, sum(yen) FILTER (kind = 'overseas' AND keys[1] = 'europe') AS europe FROM w GROUP BY k, fy),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fy DESC) AS i FROM y WHERE overseas IS NOT NULL OR total IS NOT NULL)
SELECT k, count(*) AS years, max(fy) AS last_fy, round(arg_max(overseas, fy) FILTER (overseas IS NOT NULL), 2) AS overseas, round(sum(europe), 2) AS europe, round(CASE WHEN sum(total) > 0 THEN sum(overseas) / sum(total) END, 6) AS share FROM n WHERE i <= 5 GROUP BY k""")
def overseas_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overseas sales of the last five years that have a total: the rows of a year's last submission (its half-years) by kind, regions only where exactly one bucket takes them."""
    names = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("region"))
    n = F.col("o_orderkey") % 4
    rows = table(spark, sf_dir, "orders").join(names, "o_custkey").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("fy"), (F.month("o_orderdate") > 6).alias("at"), F.when(n == 0, "total").when(n == 1, "overseas_total").otherwise("overseas").alias("kind"), "region", F.col("o_totalprice").alias("yen"))
    keys = F.array_compact(F.array(*(F.when(F.col("region").isin(own), key) for key, own in REGIONS.items())))
    rows = rows.withColumn("keys", keys).where((F.col("kind") != "overseas") | (F.size("keys") == 1))
    latest = rows.groupBy("k", "fy").agg(F.max("at").alias("at"))
    of = lambda how, when: how(F.when(when, F.col("yen")))
    y = rows.join(latest, ["k", "fy", "at"]).groupBy("k", "fy").agg(of(F.max, F.col("kind") == "overseas_total").alias("overseas"), of(F.max, F.col("kind") == "total").alias("total"), of(F.sum, (F.col("kind") == "overseas") & (F.get("keys", F.lit(0)) == "europe")).alias("europe"))
    y = y.where("overseas is not null or total is not null").withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("fy")))).where("i <= 5")
    last = F.max_by("overseas", F.when(F.col("overseas").isNotNull(), F.col("fy")))
    share = F.when(F.sum("total") > 0, ratio(F.sum("overseas"), F.sum("total")))
    return y.groupBy("k").agg(F.count(F.lit(1)).alias("years"), F.max("fy").alias("last_fy"), rounded(last, 2).alias("overseas"), rounded(F.sum("europe"), 2).alias("europe"), rounded(share, 6).alias("share"))


@query("""WITH a AS (SELECT p_partkey AS id, p_name AS name, p_size % 10 AS rank, p_brand AS family FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN p_size % 10 + 1 ELSE p_size % 10 END AS rank, p_brand AS family FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.family, b.family) AS family, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'deprecated' WHEN a.name <> b.name AND a.rank = b.rank THEN 'renamed' WHEN a.name <> b.name OR a.rank <> b.rank THEN 'changed' ELSE 'same' END AS change, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY coalesce(a.family, b.family)), 6) AS share FROM a FULL OUTER JOIN b ON a.id = b.id GROUP BY 1, 2""")
def vocabulary_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a vocabulary term by term, and what changed in each family, by number and as a share of the family's terms."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(n.alias("id"), "p_name", (F.col("p_size") % 10).alias("rank"), F.col("p_brand").alias("family"))
    old = rows.where("id % 9 <> 0").select("id", F.struct(F.col("p_name").alias("name"), "rank", "family").alias("a"))
    new = rows.where("id % 11 <> 0").select("id", F.struct(F.when(F.col("id") % 13 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.when(F.col("id") % 7 == 0, F.col("rank") + 1).otherwise(F.col("rank")).alias("rank"), "family").alias("b"))
    named, ranked = F.col("a.name") != F.col("b.name"), F.col("a.rank") != F.col("b.rank")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deprecated").when(named & ~ranked, "renamed").when(named | ranked, "changed").otherwise("same")
    found = old.join(new, "id", "full_outer").groupBy(F.coalesce("a.family", "b.family").alias("family"), change.alias("change")).agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("family")), 6))


@query("""SELECT bucket, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, CASE WHEN starts_with(m, 'HTTP 4') THEN 'client' WHEN starts_with(m, 'HTTP 5') THEN 'server' WHEN contains(m, 'timeout') THEN 'timeout' WHEN regexp_matches(m, 'row [0-9]+ ') THEN 'row' ELSE 'other' END AS bucket FROM (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'HTTP 503 timeout' WHEN 2 THEN 'read timeout' WHEN 3 THEN 'row ' || user_id || ' broken' WHEN 4 THEN 'row broken' ELSE props END AS m FROM events WHERE event_type = 'error')) GROUP BY bucket""")
def failure_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by the first rule that takes them: prefixes, then parts, then patterns."""
    n = F.col("event_id") % 6
    text = F.when(n == 0, "HTTP 404").when(n == 1, "HTTP 503 timeout").when(n == 2, "read timeout").when(n == 3, F.concat(F.lit("row "), F.col("user_id").cast("string"), F.lit(" broken"))).when(n == 4, "row broken").otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", text.alias("m"))
    m = F.col("m")
    bucket = F.when(m.startswith("HTTP 4"), "client").when(m.startswith("HTTP 5"), "server").when(m.contains("timeout"), "timeout").when(m.rlike("row [0-9]+ "), "row").otherwise("other")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("""WITH w AS (SELECT l_returnflag AS holder, l_linestatus AS contract, strftime(l_shipdate, '%Y-%m') AS month, sum(CASE WHEN l_discount < 0.05 THEN l_quantity END) AS long, sum(CASE WHEN l_discount >= 0.05 THEN l_quantity END) AS short FROM lineitem GROUP BY ALL), u AS (SELECT holder, contract, month, unnest(['long', 'short', 'net', 'balance']) AS indicator, unnest([long * 1000, short * 1000, (long - short) * 1000, short / nullif(short + long, 0)]) AS value FROM w)
SELECT holder, contract, month, indicator, round(value, 4) AS value, round(value - lag(value) OVER (PARTITION BY holder, contract, indicator ORDER BY month), 4) AS change FROM u WHERE value IS NOT NULL""")
def futures_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long, short and net positions and the short side's share per contract, holder and month, as observations with their changes."""
    leg = lambda when: F.sum(F.when(when, F.col("l_quantity")))
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("holder"), F.col("l_linestatus").alias("contract"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(leg(F.col("l_discount") < 0.05).alias("l"), leg(F.col("l_discount") >= 0.05).alias("s"))
    wide = wide.withColumns({"d": F.col("l") - F.col("s"), "b": ratio("s", F.col("s") + F.col("l"))})
    rows = ledger.observations(wide, ["holder", "contract"], {"long": ("l", 1000.0), "short": ("s", 1000.0), "net": ("d", 1000.0), "balance": ("b", 1.0)}, "month")
    return rows.select("holder", "contract", "month", "indicator", rounded("value").alias("value"), rounded("change").alias("change"))


@query("""WITH w AS (SELECT event_type AS category, date_trunc('week', CAST(ts AS DATE)) AS week, sum(value) FILTER (user_id % 2 = 0) AS bought, sum(value) FILTER (user_id % 2 = 1) AS sold FROM events GROUP BY ALL), u AS (SELECT category, CAST(week AS DATE) AS week, unnest(['bought', 'sold', 'flow']) AS indicator, unnest([bought * 1e8, sold * 1e8, (bought - sold) * 1e8]) AS value FROM w),
c AS (SELECT *, value - lag(value) OVER (PARTITION BY category, indicator ORDER BY week) AS change FROM u WHERE value IS NOT NULL), k AS (SELECT *, category || '|' || indicator || '|' || strftime(week, '%Y-%m-%d') || '|' AS key FROM c)
SELECT key, round(value / 1e6, 2) AS millions, round(change / 1e6, 2) AS change, array_to_string(list_filter([CASE WHEN value = 0 THEN 'zero' END, CASE WHEN abs(change) > 5 * abs(value) THEN 'jump' END, CASE WHEN indicator <> 'flow' AND value < 0 THEN 'negative' END], lambda x: x IS NOT NULL), ',') AS problems FROM k""")
def cross_border_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly purchases, sales and net flows as observations by key, with the change against the week before and what a check finds in them."""
    leg = lambda odd: F.sum(F.when(F.col("user_id") % 2 == odd, F.col("value")))
    wide = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category"), F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(leg(0).alias("b"), leg(1).alias("s")).withColumn("f", F.col("b") - F.col("s"))
    rows = ledger.observations(wide, ["category"], {"bought": ("b", 1e8), "sold": ("s", 1e8), "flow": ("f", 1e8)}, "week")
    key = F.concat_ws("|", "category", "indicator", F.col("week").cast("string"), F.lit(""))
    found = ledger.problems({"zero": F.col("value") == 0, "jump": F.abs("change") > 5 * F.abs("value"), "negative": (F.col("indicator") != "flow") & (F.col("value") < 0)})
    return rows.select(key.alias("key"), rounded(F.col("value") / 1e6, 2).alias("millions"), rounded(F.col("change") / 1e6, 2).alias("change"), found.alias("problems"))


@query(f"WITH {BARS_SQL} SELECT k, d, round(o, 4) AS o, round(c, 4) AS c, v FROM bars WHERE d >= DATE '2001-06-01'")
def chart_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columnar chart JSON (one document per stock, an array per column) read back into bars."""
    rows = bars_daily(spark, sf_dir).where("d >= date '2001-06-01'").select("k", F.struct("d", rounded("o").alias("o"), rounded("c").alias("c"), "v").alias("b"))
    packed = rows.groupBy("k").agg(F.sort_array(F.collect_list("b")).alias("b"))
    document = packed.select("k", F.to_json(F.struct(*(F.col("b")[c].alias(c) for c in ("d", "o", "c", "v")))).alias("json"))
    parsed = document.select("k", F.from_json("json", "d array<date>, o array<double>, c array<double>, v array<double>").alias("j"))
    return parsed.select("k", F.inline(F.arrays_zip("j.d", "j.o", "j.c", "j.v"))).select("k", "d", "o", "c", "v")


@query("SELECT CAST(event_id AS VARCHAR) AS \"id\", event_type AS \"event.type\", CAST(json_extract(props, '$.k') AS VARCHAR) AS \"event.props.k\" FROM events")
def flat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as a flat table of text, a column per leaf."""
    props = F.from_json("props", "k bigint")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("type"), props.alias("props")).alias("event"))
    return rows.select(*ledger.flat_columns(rows))


@query("""WITH f AS (SELECT l_orderkey AS doc, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS prio, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS scope, CASE WHEN l_tax > 0.06 THEN NULL ELSE floor(l_quantity / 10) END AS v FROM lineitem),
g AS (SELECT doc, prio, scope, count(DISTINCT v) AS n, max(v) AS v FROM f WHERE v IS NOT NULL GROUP BY ALL) SELECT doc, CASE WHEN n = 1 THEN v END AS value, CASE WHEN n = 1 THEN 'picked' ELSE 'ambiguous' END AS status, prio, scope FROM g QUALIFY row_number() OVER (PARTITION BY doc ORDER BY prio, scope) = 1""")
def fact_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing's value of a field: of the first candidate and scope that has any, the one distinct number, or none if there are several."""
    n, flag = F.col("l_linenumber") % 3, F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("prio"), F.when(flag == "R", 0).when(flag == "A", 1).otherwise(2).alias("scope"), F.when(F.col("l_tax") <= 0.06, F.floor(F.col("l_quantity") / 10).cast("double")).alias("v")).where("v is not null")
    g = rows.groupBy("doc", "prio", "scope").agg(F.min("v").alias("low"), F.max("v").alias("v"))
    best = g.groupBy("doc").agg(F.min_by(F.struct("low", "v", "prio", "scope"), F.struct("prio", "scope")).alias("b"))
    one = F.col("b.low") == F.col("b.v")
    return best.select("doc", F.when(one, F.col("b.v")).alias("value"), F.when(one, "picked").otherwise("ambiguous").alias("status"), "b.prio", "b.scope")
