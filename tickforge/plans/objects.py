"""JSON objects written from the tables and read strictly, charts with events and proof, guards, and series by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.columns import rounded
from tickforge.operators import ledger
from tickforge.plans.registry import query
from tickforge.sources import objects
from tickforge.sources.shared import fresh_path
from tickforge.sources.tables import BARS_SQL, MARKET_SQL, MINUTES_SQL, STOCKS_SQL, bars_daily, bars_minutes, market, stocks, table

CODE = "lpad(CAST(k AS VARCHAR), 4, '0')"


def stored(rows: DataFrame, name: str, body: str) -> DataFrame:
    """rows' documents written in bundles, indented over many lines, and read back; rows that share a name are documents of their own."""
    path = fresh_path(rows.sparkSession)
    objects.bundle(rows.select(F.col(name).alias("name"), F.to_json(body, {"pretty": "true"}).alias("text")), path)
    return objects.documents(rows.sparkSession, path)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily objects by stock; some break a rule: the code inside, a price, the order of days, a split, the proof's symbol."""
    code, kind = F.lpad(F.col("k").cast("string"), 4, "0"), F.col("k") % 10
    bar = F.struct(F.col("d").cast("string").alias("date"), "o", "h", "l", F.when((kind == 2) & (F.dayofmonth("d") == 9), -F.col("c")).otherwise(F.col("c")).alias("c"), "v")
    rows = bars_daily(spark, sf_dir).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("d", bar.alias("b")))).alias("a"))
    bars = F.transform("a", lambda x: x["b"])
    bars = F.when(kind == 1, F.reverse(bars)).otherwise(bars)
    split = F.array(F.struct(F.get(bars, F.lit(0))["date"].alias("date"), F.when(kind == 4, 0.0).otherwise(2.0).alias("ratio")))
    proof = F.struct(F.concat(F.when(kind == 5, F.lit("X")).otherwise(code), F.lit(".T")).alias("symbol"), F.lit("10y").alias("requestedRange"))
    body = F.struct(F.when(kind == 3, F.lit("none")).otherwise(code).alias("code"), F.lit("2024-01-01").alias("updated"), bars.alias("bars"), split.alias("splits"), proof.alias("proof"))
    return rows.select(code.alias("name"), body.alias("body"))


@query(f"""WITH {BARS_SQL} SELECT {CODE} AS code, CASE WHEN k % 10 = 3 THEN 'code' WHEN k % 10 = 2 AND bool_or(day(d) = 9) THEN 'bar' WHEN k % 10 = 1 AND count(*) > 1 THEN 'order' WHEN k % 10 = 4 THEN 'splits' WHEN k % 10 = 5 THEN 'proof' END AS reason, count(*) AS bars FROM bars GROUP BY k""")
def daily_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents of daily bars are taken, and why the others are not."""
    return objects.daily_objects(stored(_daily(spark, sf_dir), "name", "body")).select("code", "reason", F.size("bars").cast("long").alias("bars"))


@query(f"WITH {BARS_SQL}, x AS (SELECT k, bool_or(day(d) = 9) AS nine, count(*) AS many FROM bars GROUP BY k) SELECT {CODE} AS code, d, round(o, 4) AS o, round(h, 4) AS h, round(l, 4) AS l, round(c, 4) AS c, v FROM bars JOIN x USING (k) WHERE k % 10 NOT IN (3, 4, 5) AND NOT (k % 10 = 2 AND nine) AND NOT (k % 10 = 1 AND many > 1)")
def daily_object_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the documents that are taken."""
    rows = objects.daily_objects(stored(_daily(spark, sf_dir), "name", "body")).where("reason is null")
    return rows.select("code", F.inline("bars")).select("code", F.to_date("date").alias("d"), *(rounded(x).alias(x) for x in ("o", "h", "l", "c")), "v")


@query(f"""WITH {MINUTES_SQL}, m AS (SELECT *, CAST(epoch(ts) AS BIGINT) AS t FROM minutes), g AS (SELECT k, count(*) AS n, min(t) AS first, max(t) AS last, list_sort(list(DISTINCT CAST(ts + INTERVAL 9 HOUR AS DATE))) AS days FROM m GROUP BY k)
SELECT CAST(k AS VARCHAR) AS code, CASE WHEN k % 7 = 1 THEN 'twice' WHEN k % 7 = 2 THEN 'bar' END AS reason, n + CASE WHEN k % 7 = 1 THEN 1 ELSE 0 END AS bars, first, last, array_to_string(days, ',') AS sessions FROM g""")
def intra_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of five-minute bars: times twice and bad bars refused, first and last time, and the exchange's days."""
    kind = F.col("k") % 7
    bar = F.struct(F.col("ts").cast("timestamp").cast("long").alias("ts"), "o", "h", "l", "c", F.when(kind == 2, -1.0).otherwise(F.col("v").cast("double")).alias("v"))
    rows = bars_minutes(spark, sf_dir).withColumns({x: F.abs(x) + 1 for x in ("o", "h", "l", "c")}).groupBy("k").agg(F.collect_list(bar).alias("a"))
    bars = F.when(kind == 1, F.concat("a", F.slice("a", 1, 1))).otherwise(F.col("a"))
    docs = stored(rows.select(F.col("k").cast("string").alias("name"), F.struct(F.col("k").cast("string").alias("code"), bars.alias("bars")).alias("body")), "name", "body")
    return objects.intra_objects(docs).select("code", "reason", F.size("bars").cast("long").alias("bars"), "first", "last", F.array_join(F.col("sessions").cast("array<string>"), ",").alias("sessions"))


def _charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart documents by stock, in parallel arrays; some values are missing, some documents are broken."""
    kind, ts = F.col("k") % 12, F.unix_timestamp(F.col("d").cast("timestamp"))
    value = lambda x: F.when(F.dayofmonth("d") != 5, F.col(x))
    row = F.struct(ts.alias("t"), value("o").alias("o"), value("h").alias("h"), F.when((kind == 4) & (F.dayofmonth("d") == 20), F.col("h") + 1).otherwise(value("l")).alias("l"), F.col("c").alias("c"), F.when(kind < 9, F.col("v")).otherwise(0.0).alias("v"))
    rows = bars_daily(spark, sf_dir).groupBy("k").agg(F.sort_array(F.collect_list(row)).alias("a"), F.max_by("c", "d").alias("last"))
    rows = rows.withColumn("a", F.when(kind == 3, F.reverse("a")).otherwise(F.col("a")))
    column = lambda x: F.transform("a", lambda b: b[x])
    quote = F.struct(column("o").alias("open"), column("h").alias("high"), column("l").alias("low"), F.when(kind == 2, F.slice(column("c"), 2, 100_000)).otherwise(column("c")).alias("close"), column("v").alias("volume"))
    dated = lambda day, make: F.map_from_entries(F.transform(F.filter("a", lambda b: F.dayofmonth(F.timestamp_seconds(b["t"])) == day), lambda b: F.struct(b["t"].cast("string"), make(b))))
    events = F.struct(dated(11, lambda b: F.struct(b["t"].alias("date"), F.lit(3.0).alias("numerator"), F.lit(2.0).alias("denominator"))).alias("splits"), dated(12, lambda b: F.struct(b["t"].alias("date"), (b["c"] / 100).alias("amount"))).alias("dividends"))
    code = F.lpad(F.col("k").cast("string"), 4, "0")
    price = F.when(kind == 9, F.col("last") * 25).when(kind == 5, F.col("last") * 25).when(kind != 6, F.col("last") * 1.1)
    meta = F.struct(F.when(kind == 1, F.lit("0.T")).otherwise(F.concat(code, F.lit(".T"))).alias("symbol"), F.when(kind == 7, "1y").otherwise("10y").alias("range"), price.alias("regularMarketPrice"))
    result = F.array(F.struct(meta.alias("meta"), column("t").alias("timestamp"), events.alias("events"), F.struct(F.array(quote).alias("quote")).alias("indicators")))
    return rows.select(code.alias("name"), F.struct(F.struct(result.alias("result")).alias("chart")).alias("body"))


@query(f"""WITH {BARS_SQL}, b AS (SELECT *, day(d) <> 5 OR (k % 12 = 4 AND day(d) = 20) AS whole FROM bars), g AS (SELECT k, count(*) AS n, count(*) FILTER (whole) AS bars, round(sum(round(c, 2)) FILTER (whole), 2) AS closes, min(epoch(d)) AS first, max(epoch(d)) AS last, count(*) FILTER (day(d) = 11) AS splits, round(sum(c / 100) FILTER (day(d) = 12), 4) AS dividends,
  bool_or(day(d) = 20) AS twenty, arg_max(c, d) AS c, arg_max(c, d) FILTER (whole) AS used FROM b GROUP BY k)
SELECT {CODE} AS code, CASE WHEN k % 12 = 1 THEN 'symbol' WHEN k % 12 = 7 THEN 'range' WHEN k % 12 = 2 OR (k % 12 = 3 AND n > 1) THEN 'arrays' WHEN k % 12 = 4 AND twenty THEN 'raw' WHEN bars = 0 THEN 'empty' WHEN k % 12 = 9 AND (used / (c * 25) < 0.1 OR used / (c * 25) > 10) THEN 'incoherent' WHEN k % 12 IN (10, 11) AND (used / (c * 1.1) < 0.1 OR used / (c * 1.1) > 10) THEN 'incoherent' END AS reason,
  CASE WHEN k % 12 <> 2 THEN bars END AS bars, CASE WHEN k % 12 <> 2 THEN closes END AS closes, CAST(CASE WHEN k % 12 = 3 THEN last ELSE first END AS BIGINT) AS first, CAST(CASE WHEN k % 12 = 3 THEN first ELSE last END AS BIGINT) AS last, splits, coalesce(dividends, 0) AS dividends, 64 AS sha FROM g""")
def chart_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart documents as bars, splits and dividends with their proof, or the reason why one is refused."""
    rows = objects.charts(stored(_charts(spark, sf_dir), "name", "body"), F.concat("name", F.lit(".T")), "10y")
    total = lambda xs, make: F.aggregate(xs, F.lit(0.0), lambda s, x: s + make(x))
    closes = F.when(F.col("bars").isNotNull(), rounded(F.when(F.size("bars") > 0, total("bars", lambda b: b["c"])), 2))
    return rows.select(
        F.col("name").alias("code"), "reason", F.when(F.col("bars").isNotNull(), F.size("bars").cast("long")).alias("bars"), closes.alias("closes"), "first", "last", F.size("splits").cast("long").alias("splits"), rounded(total("dividends", lambda e: e["amount"])).alias("dividends"), F.length("sha").alias("sha"),
    )


JUMPS_SQL = "b AS (SELECT k, d, o, h, l, CASE WHEN k % 7 = 0 AND day(d) = 13 THEN -1 WHEN day(d) = 17 THEN c * 30 WHEN day(d) = 5 THEN NULL ELSE c END AS c, CASE WHEN day(d) IN (17, 18) OR k % 2 = 0 THEN 0 ELSE v END AS v, CASE WHEN day(d) = 21 THEN c * 2 END AS adj FROM bars)"


@query(f"""WITH RECURSIVE {BARS_SQL}, {JUMPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM b), w AS (
  SELECT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS d, CAST(NULL AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT k FROM bars)
  UNION ALL SELECT k, i, d, c, CASE WHEN reason IS NULL AND c IS NOT NULL THEN c ELSE last END, reason FROM (
    SELECT r.k, r.i, r.d, r.c, w.last, CASE WHEN r.c <= 0 THEN 'non_positive_close' WHEN r.h < r.l THEN 'high_low_inverted' WHEN coalesce(r.v, 0) = 0 AND (r.c / w.last > 10 OR r.c / w.last < 0.1) THEN 'jump_without_volume' END AS reason FROM w JOIN r ON r.k = w.k AND r.i = w.i + 1)),
a AS (SELECT w.k, count(*) FILTER (reason IS NOT NULL) AS refused, arg_max(coalesce(b.adj, b.c), b.d) FILTER (reason IS NULL AND coalesce(b.adj, b.c) IS NOT NULL) AS used, arg_max(b.v, b.d) FILTER (reason IS NULL AND coalesce(b.adj, b.c) IS NOT NULL) AS v, max(b.d) FILTER (reason IS NULL) AS d, arg_max({{'u': coalesce(b.adj, b.c)}}, b.d) FILTER (reason IS NULL) AS newest FROM w JOIN b ON b.k = w.k AND b.d = w.d GROUP BY w.k),
x AS (SELECT k, bool_or(c <= 0 OR o <= 0 OR h <= 0 OR l <= 0 OR adj <= 0 OR v < 0 OR (c IS NOT NULL AND h < l)) AS raw FROM b GROUP BY k), q AS (SELECT k, CASE WHEN k % 9 = 0 THEN arg_max(c, d) * 25 WHEN k % 13 = 1 THEN -1 WHEN k % 11 <> 0 THEN arg_max(c, d) * 1.1 END AS price FROM bars GROUP BY k)
SELECT k, CASE WHEN raw THEN 'raw' WHEN price <= 0 OR (coalesce(v, 0) = 0 AND (used / price > 10 OR used / price < 0.1)) THEN 'incoherent' ELSE 'ok' END AS verdict, refused, CASE WHEN a.d IS NULL OR a.d <> (SELECT max(d) FROM bars) THEN 'stale_date' WHEN newest.u IS NULL THEN 'missing_fresh_close' END AS freshness FROM a JOIN x USING (k) JOIN q USING (k)""")
def chart_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history's verdict: impossible values anywhere, or, of the bars that the sanitiser accepts, a newest close far off the quoted price without volume; and whether it has the last day's close."""
    day, n = F.dayofmonth("d"), F.col("k")
    bars = bars_daily(spark, sf_dir)
    c = F.when((n % 7 == 0) & (day == 13), -1.0).when(day == 17, F.col("c") * 30).when(day != 5, F.col("c"))
    rows = bars.select("k", "d", "o", "h", "l", c.alias("c"), F.when(day.isin(17, 18) | (n % 2 == 0), 0.0).otherwise(F.col("v")).alias("v"), F.when(day == 21, F.col("c") * 2).alias("adj"))
    last = F.max_by("c", "d")
    quotes = bars.groupBy("k").agg(F.when(n % 9 == 0, last * 25).when(n % 13 == 1, -1.0).when(n % 11 != 0, last * 1.1).alias("price"))
    return ledger.guarded(rows, quotes, table(spark, sf_dir, "lineitem").agg(F.max(F.to_date("l_shipdate")).alias("expected")))


@query(f"""WITH {BARS_SQL}, p AS (SELECT k, d, 'jsf_zandaka' AS series, c AS value FROM bars UNION ALL SELECT k, d, 'jsf_shina', v FROM bars UNION ALL SELECT k, d, 'other', o FROM bars), t AS (SELECT DISTINCT d FROM bars WHERE d BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' AND d <= DATE '2000-06-30' ORDER BY d DESC LIMIT 21)
SELECT {CODE} AS code, series, d, round(value, 4) AS value, (SELECT min(d) FROM t) AS next_cursor FROM p WHERE series <> 'other' AND d > (SELECT min(d) FROM t) AND d <= DATE '2000-06-30'""")
def supply_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of two series on a page of twenty days up to a cursor, from documents with a map of series, and where the next page begins."""
    bars = bars_daily(spark, sf_dir)
    points = lambda x: F.sort_array(F.collect_list(F.struct(F.col("d").cast("string").alias("d"), F.col(x).cast("double").alias("value"))))
    rows = bars.groupBy("k").agg(points("c").alias("jsf_zandaka"), points("v").alias("jsf_shina"), points("o").alias("other"))
    code = F.lpad(F.col("k").cast("string"), 4, "0")
    docs = stored(rows.select(code.alias("name"), F.struct(code.alias("code"), F.struct("jsf_zandaka", "jsf_shina", "other").alias("series")).alias("body")), "name", "body")
    page, following = objects.supply_series(docs, ["jsf_zandaka", "jsf_shina"], bars, None, "1999-01-01", "2000-12-31", "2000-06-30", 20)
    return page.crossJoin(F.broadcast(following)).select("code", "series", "d", rounded("value").alias("value"), "next_cursor")


@query(f"WITH {BARS_SQL}, {MARKET_SQL} SELECT {CODE} AS symbol, d, round(o, 4) AS o, round(h, 4) AS h, round(l, 4) AS l, round(c, 4) AS c, v FROM bars WHERE c IS NOT NULL UNION ALL SELECT '^N225', d, NULL, NULL, NULL, round(c, 4), NULL FROM market WHERE c IS NOT NULL")
def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series by symbol: stocks by code, the index under its own symbol with closes alone."""
    own = bars_daily(spark, sf_dir).where("c is not null").select(F.lpad(F.col("k").cast("string"), 4, "0").alias("symbol"), "d", *(rounded(x).alias(x) for x in ("o", "h", "l", "c")), "v")
    index = market(spark, sf_dir).where("c is not null").select(F.lit("^N225").alias("symbol"), "d", rounded("c").alias("c"))
    return own.unionByName(index, allowMissingColumns=True)


@query(f"""WITH {STOCKS_SQL}, f AS (SELECT l_suppkey AS k, round(avg(l_extendedprice), 2) AS price, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE (l_suppkey % 5 - 1) / 100.0 END AS y FROM lineitem WHERE l_suppkey % 8 <> 0 GROUP BY l_suppkey), a AS (SELECT DISTINCT lpad(CAST(c_custkey % 2000 AS VARCHAR), 4, '0') AS code FROM customer)
SELECT a.code, name, price, round(CASE WHEN y >= 0 THEN y END, 4) AS yield, round(price * CASE WHEN y >= 0 THEN y END, 4) AS dividend, CASE WHEN s.k IS NULL OR f.k IS NULL THEN NULL WHEN y IS NULL OR y < 0 THEN 'unverified' WHEN y > 0 THEN 'paying' ELSE 'non-dividend' END AS status, CASE WHEN s.k IS NULL THEN 'unknown_code' WHEN f.k IS NULL THEN 'no_snapshot' END AS missing FROM a LEFT JOIN stocks s USING (code) LEFT JOIN f ON f.k = s.k""")
def price_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, price, yield and estimated dividend of the codes that are asked for; one that is unknown or has no snapshot says so and has no value."""
    n = F.col("l_suppkey")
    snapshot = table(spark, sf_dir, "lineitem").where("l_suppkey % 8 <> 0").groupBy(n.alias("k")).agg(rounded(F.avg("l_extendedprice"), 2).alias("price")).withColumn("y", F.when(F.col("k") % 6 != 0, (F.col("k") % 5 - 1) / 100)).withColumn("known", F.lit(True))
    asked = table(spark, sf_dir, "customer").select(F.lpad((F.col("c_custkey") % 2000).cast("string"), 4, "0").alias("code")).distinct()
    rows = asked.join(stocks(spark, sf_dir).select("code", "k", "name"), "code", "left").join(snapshot, "k", "left")
    share = F.when(F.col("y") >= 0, F.col("y"))
    status = F.when(F.col("known"), F.when(share.isNull(), "unverified").when(share > 0, "paying").otherwise("non-dividend"))
    missing = F.when(F.col("k").isNull(), "unknown_code").when(F.col("known").isNull(), "no_snapshot")
    return rows.select("code", "name", "price", rounded(share).alias("yield"), rounded(F.col("price") * share).alias("dividend"), status.alias("status"), missing.alias("missing"))
