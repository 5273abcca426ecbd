"""Screens, searches, lookups and publication rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.columns import rounded
from tickforge.operators import screens
from tickforge.operators.series import numbered
from tickforge.plans.filings import GROWTH_SQL, growth
from tickforge.plans.registry import query
from tickforge.plans.technical import RSI_STANDINGS_SQL, rsi_standings
from tickforge.sources.shared import written
from tickforge.sources.tables import BARS_SQL, STOCKS_SQL, bars_daily, stocks, table

def percentile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each active stock: its standings, the day they were computed from, market value, whether it is a blue chip, and the day of its snapshot."""
    about = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("cap"), (F.col("s_acctbal") > 2000).alias("blue"))
    rows = rsi_standings(spark, sf_dir).join(stocks(spark, sf_dir).where("is_active").select("k", "code"), "k").join(about, "k", "left")
    return rows.withColumn("snapshot", F.date_add("d", F.when(F.col("k") % 4 == 0, 1).otherwise(0)))


def percentile_screen(rows: DataFrame, now: Column, period: int | str = 40, most: float = 60.0, days: int = 30, sort: str = "percentile", blue: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of rows (percentile_rows, written: they are read three times) whose percentile of a period, or the least of all ("min"), is `most` at most.

    Rows computed more than `days` before now, or before the snapshot beside them, are left out and counted. sort: percentile, rsi (percentile for "min"), or cap, the largest first.
    """
    pct, rsi = f"pct_{period}" if period == "min" else f"pct{period}", None if period == "min" else f"rsi{period}"
    order = {"percentile": F.asc(pct), "rsi": F.asc(rsi or pct), "cap": F.desc_nulls_last("cap")}[sort]
    rows = rows.where(screens.all_of([screens.within(pct, most=most), F.col("blue") if blue else None])).withColumn("fresh", F.coalesce(screens.fresh("d", now, days, "snapshot"), F.lit(False)))
    left_out = rows.agg(F.count_if(~F.col("fresh")).alias("stale_excluded"))
    page = screens.paged(rows.where("fresh"), [order, F.asc("code")], limit, offset)
    return page.crossJoin(F.broadcast(left_out)).select("code", (F.col(rsi) if rsi else F.lit(None).cast("double")).alias("rsi"), F.col(pct).alias("pct"), "total", "stale_excluded")


#: The screens that are shown: their parameters, and the same in SQL (condition, order).
PERCENTILE_SCREENS = {
    "low": (dict(offset=5), "pct40 <= 60", "pct40", "pct40", "rsi40", 20, 5),
    "least_of_all": (dict(period="min", most=70.0, sort="rsi", limit=15), "pct_min <= 70", "pct_min", "pct_min", "NULL", 15, 0),
    "large": (dict(period=10, most=80.0, sort="cap", blue=True, limit=10, offset=2), "pct10 <= 80 AND blue", "cap DESC NULLS LAST", "pct10", "rsi10", 10, 2),
    "weak": (dict(period=120, most=90.0, sort="rsi", days=10), "pct120 <= 90", "rsi120", "pct120", "rsi120", 20, 0),
}


def _screen_sql(name: str) -> str:
    given, condition, order, pct, rsi, limit, offset = PERCENTILE_SCREENS[name]
    fresh = f"d >= (SELECT max(d) FROM bars) - {given.get('days', 30)} AND d >= snapshot"
    return f"(SELECT '{name}' AS screen, code, CAST({rsi} AS DOUBLE) AS rsi, {pct} AS pct, (SELECT count(*) FROM base WHERE {condition} AND {fresh}) AS total, (SELECT count(*) FROM base WHERE {condition} AND NOT ({fresh})) AS stale_excluded FROM base WHERE {condition} AND {fresh} ORDER BY {order}, code LIMIT {limit} OFFSET {offset})"


@query(f"WITH RECURSIVE {RSI_STANDINGS_SQL}, {STOCKS_SQL}, base AS (SELECT s.*, code, e.d, s_acctbal AS cap, s_acctbal > 2000 AS blue, e.d + CASE WHEN s.k % 4 = 0 THEN 1 ELSE 0 END AS snapshot FROM standings s JOIN (SELECT k, max(d) AS d FROM bars GROUP BY k) e USING (k) JOIN stocks t ON t.k = s.k JOIN supplier ON s_suppkey = s.k WHERE is_active) " + " UNION ALL ".join(map(_screen_sql, PERCENTILE_SCREENS)), name="percentile_screen")
def percentile_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four screens of the same rows: by a period, by the least of all, blue chips by market value, and by relative strength itself."""
    rows, seen = written(percentile_rows(spark, sf_dir))
    now = F.lit(bars_daily(spark, sf_dir).agg(F.max("d")).first()[0]).cast("date")
    out = None
    for name, (given, *_) in PERCENTILE_SCREENS.items():
        one = percentile_screen(rows, now, **given).select(F.lit(name).alias("screen"), "code", "rsi", "pct", "total", "stale_excluded")
        out = one if out is None else out.unionByName(one)
    return out


#: Margin, return on equity and yield of a customer, in per cent; some are not known.
RATES = {"margin": "CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 37 - 5 END", "roe": "(c_custkey * 7) % 40 - 8", "dividend": "CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 60) / 10.0D END"}


def order_screen(spark: SparkSession, sf_dir: str, least_years: int = 3, cagr: float | None = 0.0, yoy: float | None = None, cap: tuple[float | None, float | None] = (None, None), per: float | None = None, segment: str | None = None, margin: float | None = None, roe: float | None = None, dividend: float | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Growth screen: conditions that are given, of growth, size, price (positive and at most `per`), segment, and of margin, return on equity and yield in per cent."""
    about = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("cap"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") / 200).alias("per"), *(F.expr(rate).alias(x) for x, rate in RATES.items()))
    wanted = [screens.within("margin", least=margin), screens.within("roe", least=roe), screens.within("dividend", least=dividend), F.col("n_years") >= least_years, screens.within("cagr", least=cagr), screens.within("yoy", least=yoy), screens.within("cap", *cap), screens.within("per", most=per, over=0.0) if per is not None else None, F.col("segment") == segment if segment else None]
    rows = growth(spark, sf_dir).join(about, "k").where(screens.all_of(wanted))
    return screens.paged(rows.select("k", "name", "cagr", "yoy"), [F.desc_nulls_last("cagr"), F.col("k")], limit, offset).select("k", "name", rounded("cagr", 6).alias("cagr"), rounded("yoy", 6).alias("yoy"), "total")


@query(f"""WITH {GROWTH_SQL}, r AS (SELECT g.k, c_name AS name, g.cagr, g.yoy FROM growth g JOIN customer ON c_custkey = g.k WHERE n_years >= 3 AND g.cagr >= 0 AND c_acctbal >= 1000 AND c_acctbal / 200 > 0 AND c_acctbal / 200 <= 30 AND c_mktsegment = 'BUILDING' AND c_custkey % 9 <> 0 AND c_custkey % 37 - 5 >= 0 AND (c_custkey * 7) % 40 - 8 >= -5 AND c_custkey % 5 <> 0 AND (c_custkey % 60) / 10.0 >= 0.5)
SELECT k, name, round(cagr, 6) AS cagr, round(yoy, 6) AS yoy, (SELECT count(*) FROM r) AS total FROM r ORDER BY r.cagr DESC NULLS LAST, k LIMIT 10 OFFSET 3""", name="order_screen")
def order_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_screen(spark, sf_dir, 3, 0.0, None, (1000.0, None), 30.0, "BUILDING", 0.0, -5.0, 0.5, 10, 3)


@query(f"WITH {STOCKS_SQL} SELECT code, name, CASE WHEN code = '0001' THEN 0 ELSE 1 END AS place FROM stocks WHERE starts_with(code, '0001') OR contains(name, '0001') ORDER BY place, code LIMIT 36")
def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks by the beginning of a code or a part of a name, the exact code first."""
    q = "0001"
    rows = stocks(spark, sf_dir).where(screens.found_by(q)).select("code", "name", F.when(F.col("code") == q, 0).otherwise(1).alias("place"))
    return rows.orderBy("place", "code").limit(36)


LOOKED_UP = ["0001", "0003", "0007", "0007", "zzzz"]


@query(f"WITH {STOCKS_SQL}, q AS (SELECT unnest(['0001', '0003', '0007', 'zzzz']) AS code) SELECT q.code, s.name, s.sector, CASE WHEN s.code IS NULL THEN 'unknown_code' WHEN b.k IS NULL THEN 'not_collected' ELSE 'ok' END AS status FROM q LEFT JOIN stocks s USING (code) LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') b ON b.k = s.k")
def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of codes stands for, and why a code has nothing; the batch is bounded by its check."""
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, screens.checked(LOOKED_UP)))).alias("code"))
    known = stocks(spark, sf_dir).where(F.col("code").isin(screens.checked(LOOKED_UP)))
    traded = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '2001-06-01'").select(F.col("l_suppkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    rows = asked.join(known, "code", "left").join(traded, "k", "left")
    return rows.select("code", "name", "sector", F.when(F.col("k").isNull(), "unknown_code").when(F.col("hit").isNull(), "not_collected").otherwise("ok").alias("status"))


@query("""SELECT k, license, CASE WHEN license = 'commercial-ok' THEN price END AS price, CASE WHEN license IN ('commercial-ok', 'factual-cite') THEN name END AS name, CASE WHEN kind = 'equity' OR (NOT active AND kind IS NULL) THEN true ELSE false END AS taken
FROM (SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'commercial-ok' WHEN 1 THEN 'factual-cite' ELSE 'internal' END AS license, p_retailprice AS price, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'equity' WHEN 1 THEN 'etf' ELSE NULL END AS kind, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 2 = 0 END AS active FROM part) WHERE license <> 'internal'""")
def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by license: full ones, facts that may be cited, none of the rest; and a flag of three-valued logic."""
    size = F.col("p_size")
    license_ = F.element_at(F.array(*map(F.lit, ("commercial-ok", "factual-cite", "internal"))), (size % 3 + 1).cast("int"))
    kind, active = F.when(size % 4 == 0, "equity").when(size % 4 == 1, "etf"), F.when(size % 5 != 0, size % 2 == 0)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), license_.alias("license"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"), kind.alias("kind"), active.alias("active"))
    taken = F.coalesce((F.col("kind") == "equity") | (~F.col("active") & F.col("kind").isNull()), F.lit(False))
    rows = rows.withColumn("taken", taken).drop("kind", "active")
    full, cited = rows.where("license = 'commercial-ok'"), rows.where("license = 'factual-cite'")
    return full.unionByName(screens.redacted(cited, ["price"]))


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN value > 100 THEN event_type END AS tag FROM events), r AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-01' + INTERVAL 10 DAY AND (tag IS NULL OR tag IN ('purchase', 'signup')) AND user_id % 10 = 3)
SELECT user_id AS k, coalesce(tag, '_unclassified') AS tag, count(*) AS n, max(ts) AS last FROM r GROUP BY ALL ORDER BY last DESC, k, tag LIMIT 40""")
def disclosure_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by user and tag since a day, of two tags or none, the newest groups first."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") > 100, F.col("event_type")).alias("tag"))
    rows = rows.where((F.col("ts") >= F.lit("2024-01-11").cast("timestamp")) & (F.col("tag").isNull() | F.col("tag").isin("purchase", "signup")) & (F.col("k") % 10 == 3))
    g = rows.groupBy("k", F.coalesce("tag", F.lit("_unclassified")).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return g.orderBy(F.desc("last"), "k", "tag").limit(40)


@query(f"""WITH {BARS_SQL}, g AS (SELECT k, d, CASE WHEN n % 5 = 0 THEN NULL ELSE c END AS c FROM bars), w AS (SELECT DISTINCT d FROM bars WHERE d >= DATE '2001-01-01'), f AS (SELECT DISTINCT k, d FROM g WHERE c IS NULL AND k % 2 = 0)
SELECT g.k, count(*) AS missing, min(g.d) AS first, max(g.d) AS last FROM g JOIN w USING (d) WHERE c IS NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.k = g.k AND f.d = g.d) GROUP BY g.k""")
def null_close_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a window on which a stock has a bar without a close and that were not corrected yet."""
    bars = bars_daily(spark, sf_dir).withColumn("c", F.when(F.col("n") % 5 != 0, F.col("c"))).select("k", "d", "c")
    stored = bars.select("d").distinct().where("d >= date '2001-01-01'")
    open_ = bars.where("c is null").select("k", "d")
    corrected = open_.where("k % 2 = 0").distinct()
    return open_.join(stored, "d", "left_semi").join(corrected, ["k", "d"], "left_anti").groupBy("k").agg(F.count(F.lit(1)).alias("missing"), F.min("d").alias("first"), F.max("d").alias("last"))


@query("""SELECT o_orderkey AS k, kind IN ('120', '130') AND NOT withdrawn AND code IS NOT NULL AS target, kind = '120' AND form = '030000' AS annual, regexp_matches(coalesce(code, ''), '^[0-9]{3}[0-9A-Z]0$') AND market IN ('プライム', 'スタンダード', 'グロース') AS listed
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '120' WHEN 1 THEN '130' WHEN 2 THEN '140' ELSE '350' END AS kind, o_orderstatus = 'P' AS withdrawn, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN o_custkey % 3 = 0 THEN '5' ELSE '0' END END AS code,
  CASE WHEN o_custkey % 2 = 0 THEN '030000' ELSE '043000' END AS form, CASE o_custkey % 5 WHEN 0 THEN 'プライム' WHEN 1 THEN 'スタンダード' WHEN 2 THEN 'グロース' ELSE 'ETF・ETN' END AS market FROM orders)""")
def filing_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which filings are collected, which are annual reports, and whose code and market are those of a listed share."""
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda at, *items: F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))
    code = F.when(c % 7 != 0, F.concat(F.lpad((c % 10000).cast("string"), 4, "0"), F.when(c % 3 == 0, "5").otherwise("0")))
    rows = table(spark, sf_dir, "orders").select(n.alias("k"), pick(n % 4, "120", "130", "140", "350").alias("kind"), (F.col("o_orderstatus") == "P").alias("withdrawn"), code.alias("code"), F.when(c % 2 == 0, "030000").otherwise("043000").alias("form"), pick(c % 5, "プライム", "スタンダード", "グロース", "ETF・ETN", "ETF・ETN").alias("market"))
    listed = F.coalesce("code", F.lit("")).rlike("^[0-9]{3}[0-9A-Z]0$") & F.col("market").isin("プライム", "スタンダード", "グロース")
    return rows.select("k", (F.col("kind").isin("120", "130") & ~F.col("withdrawn") & F.col("code").isNotNull()).alias("target"), ((F.col("kind") == "120") & (F.col("form") == "030000")).alias("annual"), listed.alias("listed"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2000-06-30' ORDER BY d DESC LIMIT 21), p AS (SELECT d FROM d ORDER BY d DESC LIMIT 20), n AS (SELECT CASE WHEN count(*) > 20 THEN min(d) END AS next_cursor FROM d)
SELECT p.d, count(*) AS n, round(sum(o_totalprice), 2) AS total, any_value(next_cursor) AS next_cursor FROM p JOIN orders ON CAST(o_orderdate AS DATE) = p.d, n GROUP BY p.d""")
def date_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty days up to a cursor, newest first, and the day at which the next page begins."""
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), "o_totalprice")
    page, following = screens.date_page(rows, "d", F.lit("2000-06-30").cast("date"), 20)
    return page.groupBy("d").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total")).crossJoin(F.broadcast(following))


@query(f"WITH {STOCKS_SQL}, r AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS i, count(*) OVER () AS n FROM stocks) SELECT code, CAST((i - CAST(floor(n * ((42 * 0.618033988749895) % 1)) AS BIGINT) + n) % n AS BIGINT) AS turn FROM r WHERE (i - CAST(floor(n * ((42 * 0.618033988749895) % 1)) AS BIGINT) + n) % n < 30")
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty stocks whose turn it is: all in order of code, from a start that moves by the golden ratio each day."""
    rows, seen = numbered(stocks(spark, sf_dir).select("code"), F.col("code"), name="i", observed=[F.count(F.lit(1)).alias("n")])
    n = seen["n"]
    start = int(n * ((42 * 0.618033988749895) % 1))
    return rows.select("code", F.pmod(F.col("i") - 1 - start, F.lit(max(n, 1))).alias("turn")).where("turn < 30")


@query(f"""WITH {STOCKS_SQL}, s AS (SELECT l_suppkey AS k, round(avg(l_discount) * 100, 4) AS score FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1), b AS (SELECT user_id AS k, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS kinds FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT code, score, s_acctbal AS cap, coalesce(kinds, '') AS kinds FROM stocks JOIN supplier ON s_suppkey = k LEFT JOIN s USING (k) LEFT JOIN b USING (k) WHERE is_active ORDER BY score DESC NULLS LAST, code LIMIT 60 OFFSET 10""")
def snapshot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks with their scores and benefits where there are any, missing scores last, by pages."""
    scores = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("k")).agg(rounded(F.avg("l_discount") * 100).alias("score"))
    benefits = table(spark, sf_dir, "events").where("user_id % 2 = 0").groupBy(F.col("user_id").alias("k")).agg(F.array_join(F.sort_array(F.collect_set("event_type")), "|").alias("kinds"))
    caps = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("cap"))
    rows = stocks(spark, sf_dir).where("is_active").select("k", "code").join(caps, "k").join(scores, "k", "left").join(benefits, "k", "left")
    return rows.select("code", "score", "cap", F.coalesce("kinds", F.lit("")).alias("kinds")).orderBy(F.desc_nulls_last("score"), "code").offset(10).limit(60)


@query("""WITH n AS (SELECT c_custkey AS issuer, lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0') AS code FROM customer WHERE c_custkey % 4 <> 0)
SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') END, n.code) AS code, CAST(o_orderdate AS DATE) AS submitted FROM orders LEFT JOIN n ON n.issuer = o_custkey""")
def code_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing's code, or else its issuer's; null where neither is known."""
    issuers = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 4, "0").alias("known"))
    own = F.when(F.col("o_orderkey") % 3 == 0, F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "orders").join(issuers, "o_custkey", "left").select(F.col("o_orderkey").alias("k"), F.coalesce(own, "known").alias("code"), F.to_date("o_orderdate").alias("submitted"))
