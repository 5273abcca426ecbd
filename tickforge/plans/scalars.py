"""Codes, figures, titles, periods and codecs: scalar functions over what the tables hold, written the Japanese way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import japanese as jp
from tickforge.functions import market
from tickforge.functions.columns import rounded
from tickforge.plans.registry import query
from tickforge.sources.tables import BARS_SQL, bars_daily, table

DIGITS = "0123456789"
CODES_SQL = f"c AS (SELECT s_suppkey AS k, '  ' || translate(lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '5' WHEN 3 THEN 'a' ELSE '00' END, '{DIGITS}a', '{jp.WIDE[:10]}ａ') || ' ' AS raw FROM supplier), s AS (SELECT k, upper(translate(trim(raw, ' '), '{jp.WIDE}', '{jp.NARROW}')) AS code FROM c)"


@query(f"""WITH {CODES_SQL}, t AS (SELECT k, code, CASE WHEN len(code) = 5 AND ends_with(code, '0') THEN code[1:4] ELSE code END AS head FROM s)
SELECT k, code, CASE WHEN regexp_matches(code, '{jp.CODE}') THEN code END AS parsed, CASE WHEN regexp_matches(head, '{jp.CODE}') THEN head END AS ticker,
  coalesce(CASE WHEN regexp_matches(head, '{jp.CODE}') THEN head END, CASE WHEN len(code) = 5 AND regexp_matches(code[1:4], '{jp.CODE}') AND regexp_matches(code[5:5], '[1-9]') THEN code END) AS margin_key FROM t""")
def stock_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as sources write them (full width, blanks, a fifth character), normalised, parsed and keyed."""
    n = F.col("s_suppkey")
    tail = F.element_at(F.array(*map(F.lit, ("", "0", "5", "a", "00"))), (n % 5 + 1).cast("int"))
    raw = F.concat(F.lit("  "), F.translate(F.concat(F.lpad(n.cast("string"), 4, "0"), tail), DIGITS + "a", jp.WIDE[:10] + "ａ"), F.lit(" "))
    return table(spark, sf_dir, "supplier").select(n.alias("k"), jp.stock_code(raw).alias("code"), jp.parsed_code(raw).alias("parsed"), jp.ticker(raw).alias("ticker"), jp.margin_key(raw).alias("margin_key"))


FIGURES = [("", ""), ("△", "百万円"), ("▲", "千円"), ("(", ")億円"), ("－", ""), ("約", "兆円")]
RAW_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{a}' || translate(format('{{:,}}', p_size * 137), '{DIGITS},', '{jp.SIGNS[:10]}，') || '{b}'" for i, (a, b) in enumerate(FIGURES)) + " END"


@query(f"""WITH r AS (SELECT p_partkey AS k, {RAW_SQL} AS raw FROM part), n AS (SELECT k, translate(raw, '{jp.SIGNS}', '{jp.PLAIN}') AS norm, regexp_extract(raw, '{jp.UNIT}') AS unit FROM r),
f AS (SELECT k, unit, regexp_replace(norm, '[\\s,]', '', 'g') AS bare, regexp_replace(regexp_replace(regexp_extract(norm, '{jp.FIGURE}'), '[\\s,]', '', 'g'), '^-$', '') AS first FROM n)
SELECT k, unit, CASE WHEN regexp_matches(bare, '^-?[0-9]+(\\.[0-9]+)?$') THEN CAST(bare AS DOUBLE) END AS figure, CASE WHEN regexp_matches(replace(bare, unit, ''), '^\\([0-9]+\\)$') THEN -CAST(regexp_extract(bare, '[0-9]+') AS DOUBLE) WHEN regexp_matches(replace(bare, unit, ''), '^-?[0-9]+$') THEN CAST(replace(bare, unit, '') AS DOUBLE) END AS accounting,
  CASE WHEN first <> '' THEN CAST(first AS DOUBLE) * CASE unit WHEN '' THEN 1 WHEN '円' THEN 1 WHEN '千円' THEN 1e3 WHEN '百万円' THEN 1e6 WHEN '億円' THEN 1e8 ELSE 1e12 END END AS yen FROM f""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with triangles, parentheses, full-width digits and units, read three ways."""
    body = F.translate(F.format_number(F.col("p_size") * 137, 0), DIGITS + ",", jp.SIGNS[:10] + "，")
    raw = F.element_at(F.array(*(F.concat(F.lit(a), body, F.lit(b)) for a, b in FIGURES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    unit = F.regexp_extract(raw, jp.UNIT, 0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), unit.alias("unit"), jp.figure(raw).alias("figure"), jp.accounting_figure(F.replace(raw, unit, F.lit(""))).alias("accounting"), jp.amount(raw).alias("yen"))


def _revision_text() -> F.Column:
    n = F.col("o_orderkey")
    part = lambda key, low, high, unit: F.concat(F.lit(f"{key} 前回発表予想 "), F.format_number(low, 0), F.lit(f"{unit} 今回修正予想 "), F.format_number(high, 0), F.lit(f"{unit}。"))
    price = F.floor("o_totalprice").cast("long")
    pad = F.repeat(F.lit("　"), 200)
    return F.concat(part("売上高", price, price + (n % 3 - 1) * 100, "百万円"), pad, part("営業利益", F.lit(5000), 5000 + (n % 5 - 2) * 10, "百万円"), pad, F.when(n % 7 == 0, part("経常利益", F.lit(10), F.lit(20), "億円")).otherwise(F.lit("経常利益 未定")))


@query("""SELECT o_orderkey AS k, CASE WHEN len(ways) = 0 THEN 'unknown' WHEN list_contains(ways, -ways[1]) THEN 'mixed' WHEN ways[1] > 0 THEN 'positive' ELSE 'negative' END AS sentiment
FROM (SELECT o_orderkey, list_filter([sign(o_orderkey % 5 - 2), CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END, sign(o_orderkey % 3 - 1)], lambda w: w <> 0) AS ways FROM orders)""")
def forecast_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of a forecast revision, read from its text: first and second figure of each metric, by priority."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _revision_text().alias("text"))
    return jp.with_forecast_revision(rows, "text", "sentiment").select("k", "sentiment")


@query("""WITH c AS (SELECT p_brand AS brand, p_partkey % 3 AS m, round(p_retailprice / 7, 1) AS v FROM part), i AS (SELECT brand, CASE m WHEN 0 THEN v WHEN 1 THEN v - 0.05 ELSE v - 0.1 END AS lo, CASE m WHEN 0 THEN v + 0.1 WHEN 1 THEN v + 0.05 ELSE v + 0.1 END AS hi, v FROM c),
s AS (SELECT brand, sum(lo) AS lo, sum(hi) AS hi, sum(v) AS total, count(*) AS n FROM i GROUP BY brand)
SELECT brand, n, round(lo, 2) AS lo, round(hi, 2) AS hi, lo <= total * 1.001 + 0.05 + 1e-9 AND total * 1.001 - 0.05 <= hi + 1e-9 AS consistent FROM s""")
def cell_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What printed cells can stand for, summed, against a printed total (here a thousandth too high)."""
    value = rounded(F.col("p_retailprice") / 7, 1)
    mode = F.element_at(F.array(*map(F.lit, ("truncate", "round", "unknown"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), value.alias("v"), jp.cell_interval(value, F.lit(0.1), mode).alias("i"))
    sums = rows.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.sum("i.lo").alias("lo"), F.sum("i.hi").alias("hi"), F.sum("v").alias("total"))
    total = jp.cell_interval(F.col("total") * 1.001, F.lit(0.1), F.lit("round"))
    return sums.select("brand", "n", rounded("lo", 2).alias("lo"), rounded("hi", 2).alias("hi"), jp.overlapping(F.struct("lo", "hi"), total).alias("consistent"))


KINDS = ["day", "week", "month", "quarter", "year"]


@query("""WITH d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS kind FROM orders)
SELECT k, CAST(CASE kind WHEN 0 THEN d WHEN 1 THEN date_trunc('week', d) WHEN 2 THEN date_trunc('month', d) WHEN 3 THEN date_trunc('quarter', d) ELSE date_trunc('year', d) END AS DATE) AS first,
  CAST(CASE kind WHEN 0 THEN d WHEN 1 THEN date_trunc('week', d) + INTERVAL 6 DAY WHEN 2 THEN last_day(d) WHEN 3 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY ELSE make_date(year(d), 12, 31) END AS DATE) AS last,
  CAST(d - INTERVAL 10 YEAR AS DATE) AS ten_years, CAST(greatest(d - 90, DATE '1995-06-01') AS DATE) AS shown_from, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS expected_month FROM d""")
def period_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, week, month, quarter and year around a date, ten years back, the 90 days shown, and the month whose figures are due."""
    day = F.to_date("o_orderdate")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), day.alias("d"), jp.period(day, kind).alias("p"))
    return rows.select("k", "p.first", "p.last", F.add_months("d", -120).alias("ten_years"), F.greatest(F.date_sub("d", 90), F.lit("1995-06-01").cast("date")).alias("shown_from"), F.add_months(F.trunc("d", "MM"), -1).alias("expected_month"))


@query("""WITH t AS (SELECT event_id AS k, ts, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo' AS DATE) AS tokyo, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny, strftime(ts, '%Y-%m-%d %H:%M:%S') AS written FROM events),
e AS (SELECT *, CAST(ny AS DATE) AS nd, CAST(dayofweek(ny) AS INTEGER) AS w FROM t)
SELECT k, tokyo, CAST(strptime(written, '%Y-%m-%d %H:%M:%S') - INTERVAL 9 HOUR AS TIMESTAMP) AS instant, dayofweek(tokyo) IN (0, 6) OR strftime(tokyo, '%m-%d') IN ('01-01', '01-02', '01-03', '12-31') AS closed,
  CAST(CASE WHEN w = 5 AND strftime(ny, '%H:%M') >= '15:30' OR w = 6 THEN nd - (w - 2) WHEN w = 0 THEN nd - 5 ELSE nd - (w + 5) END AS DATE) AS expected_report FROM e""")
def market_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Tokyo date, a Tokyo time stamp as an instant, whether the market is closed, and the Tuesday whose positions are out (since Friday, 15:30 in New York)."""
    ts = F.col("ts").cast("timestamp")
    tokyo, ny = F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo")), F.from_utc_timestamp(ts, "America/New_York")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), ts.alias("ts"), tokyo.alias("tokyo"), ny.alias("ny"), (F.dayofweek(ny) - 1).alias("w"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("written"))
    closed = F.dayofweek("tokyo").isin(1, 7) | F.date_format("tokyo", "MM-dd").isin("01-01", "01-02", "01-03", "12-31")
    out = ((F.col("w") == 5) & (F.date_format("ny", "HH:mm") >= "15:30")) | (F.col("w") == 6)
    back = F.when(out, F.col("w") - 2).when(F.col("w") == 0, 5).otherwise(F.col("w") + 5)
    return rows.select("k", "tokyo", F.to_utc_timestamp(F.to_timestamp("written"), "Asia/Tokyo").alias("instant"), closed.alias("closed"), F.date_sub(F.to_date("ny"), back).alias("expected_report"))


@query(f"""WITH {BARS_SQL}, a AS (SELECT k, d, CASE WHEN n % 7 = 0 THEN -1 ELSE o END AS o, h, l, c, CASE WHEN n % 5 = 0 THEN NULL ELSE c * (1 - (k % 4) * 0.1) END AS adj FROM bars), f AS (SELECT *, CASE WHEN c > 0 AND adj > 0 THEN adj / c END AS f FROM a)
SELECT k, d, CASE WHEN f IS NOT NULL THEN round(adj, 4) END AS adj_close, CASE WHEN o > 0 THEN round(o * f, 4) END AS adj_open, CASE WHEN h > 0 THEN round(h * f, 4) END AS adj_high, CASE WHEN l > 0 THEN round(l * f, 4) END AS adj_low, coalesce(f <> 1, false) AS adjusted FROM f""")
def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices times adjusted close over close; null where a price is not positive or there is no factor."""
    rows = bars_daily(spark, sf_dir).withColumn("o", F.when(F.col("n") % 7 == 0, -1.0).otherwise(F.col("o"))).withColumn("adj", F.when(F.col("n") % 5 != 0, F.col("c") * (1 - (F.col("k") % 4) * 0.1)))
    rows = rows.withColumn("f", jp.adjustment(F.col("c"), F.col("adj")))
    scaled = lambda x: F.when(F.col(x) > 0, rounded(F.col(x) * F.col("f")))
    return rows.select("k", "d", F.when(F.col("f").isNotNull(), rounded("adj")).alias("adj_close"), scaled("o").alias("adj_open"), scaled("h").alias("adj_high"), scaled("l").alias("adj_low"), F.coalesce(F.col("f") != 1, F.lit(False)).alias("adjusted"))


#: Quotes, benefits and segments made from a part's numbers: what is asked of the functions, in an engine's own words (lists are taken by place).
QUOTED = {
    "percent": "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN -1.5 ELSE (p_size % 6) * 0.75 END", "price": "CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END", "month": "p_partkey % 14", "end": "CAST('2024-01-31' AS DATE) + CAST(p_size * 7 AS INT)",
    "source": (["company", "analyst", None], "p_partkey % 3"), "day": (["2024-09-30", "2024-02-30", None, None, "24-1-1"], "p_size % 5"), "kind": (["本決算", "1Q", "2Q", "3Q"], "p_partkey % 4"), "code": (["1301", "130A", "A130", "13019"], "p_size % 4"),
    "segment": (["プライム（内国株式）", " スタンダード（内国株式） ", "グロース（内国株式）", "プライム（外国株式）", "ETF・ETN", "PRO Market", "REIT・ベンチャーファンド・カントリーファンド・インフラファンド", "出資証券", "ETF", "内国株式"], "p_partkey % 10"),
}


def _quoted(spark_: bool) -> list[str]:
    values = lambda xs: ", ".join("NULL" if x is None else f"'{x}'" for x in xs)
    take = lambda x: x if isinstance(x, str) else (f"element_at(array({values(x[0])}), CAST({x[1]} AS INT) + 1)" if spark_ else f"([{values(x[0])}])[CAST({x[1]} AS INT) + 1]")
    quote = "`" if spark_ else '"'
    return [f"{take(x)} AS {quote}{name}{quote}" for name, x in QUOTED.items()]


@query(f"""WITH q AS (SELECT p_partkey AS k, p_size AS score, {', '.join(_quoted(False))} FROM part), d AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches("day", '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN "day" END AS DATE) AS real FROM q)
SELECT k, round(CASE WHEN percent >= 0 THEN percent / 100 END, 6) AS yield, round(CASE WHEN percent > 0 THEN price * percent / 100 END, 4) AS dividend, CASE WHEN percent IS NULL OR percent < 0 THEN 'unverified' WHEN percent > 0 THEN 'paying' ELSE 'non-dividend' END AS status, round(CASE WHEN source = 'company' THEN price END, 4) AS trusted,
  CASE WHEN "month" > 12 OR ("day" IS NOT NULL AND real IS NULL) OR ("month" = 0 AND "day" IS NOT NULL) THEN NULL ELSE "day" IS NULL AND "month" <> 0 END AS recurring, CASE WHEN kind = '2Q' AND "end" >= DATE '2024-06-30' THEN '中間' ELSE kind END AS interim,
  CASE WHEN regexp_matches(code, '^[0-9]{{3}}[0-9A-Z]$') AND regexp_matches(segment, '(プライム|スタンダード|グロース).*内国株式') THEN 'equity' WHEN segment LIKE '%（外国株式）' THEN 'foreign' WHEN segment = 'PRO Market' THEN 'pro_market' WHEN segment = 'ETF・ETN' THEN 'etf_etn' WHEN segment LIKE 'REIT・%' THEN 'reit_fund' WHEN segment = '出資証券' THEN 'investment_certificate' END AS instrument,
  CASE WHEN score >= 40 THEN 'yes' WHEN score <= 10 THEN 'no' ELSE 'uncertain' END AS band FROM d""")
def dividend_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yields as ratios, their state, estimates of the company alone, benefits that recur, interim reports, kinds of instruments and bands."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size AS score", *_quoted(True))
    percent = F.col("percent").cast("double")
    share = market.dividend_yield(percent)
    return rows.select(
        "k", rounded(share, 6).alias("yield"), rounded(market.estimated_dividend(F.col("price"), share)).alias("dividend"), market.dividend_state(percent).alias("status"), rounded(market.trusted(F.col("price"), F.col("source"))).alias("trusted"),
        market.recurring(F.col("month"), F.col("day")).alias("recurring"), market.interim(F.col("kind"), F.col("end")).alias("interim"), market.instrument(F.col("code"), F.col("segment")).alias("instrument"), market.band(F.col("score"), 40, 10).alias("band"),
    )


@query("""SELECT user_id AS k, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS ids_sha, sha256('{"first":"' || CAST(min(event_id) AS VARCHAR) || '","last":"' || CAST(max(event_id) AS VARCHAR) || '"}') AS json_sha,
  array_to_string(list_sort(list(CAST(event_id AS VARCHAR)) FILTER (event_id % 5 <> 0))[1:3], '|') AS decoded FROM events WHERE event_type = 'signup' GROUP BY user_id""")
def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's digest, canonical JSON (sorted keys) and its digest, and a list read back from text without its bad items."""
    g = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("k")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    pairs = F.create_map(F.lit("last"), F.element_at("ids", -1).cast("string"), F.lit("first"), F.element_at("ids", 1).cast("string"))
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))
    written = F.array_join(F.transform("ids", lambda x: F.when(x % 5 == 0, "bad").otherwise(x.cast("string"))), ",")
    decoded = F.filter(F.transform(F.split(written, ","), lambda x: x.try_cast("long")), lambda x: x > 0)
    # A list without any good item is no list, and not an empty text.
    kept = F.when(F.size(decoded) > 0, F.array_join(F.slice(F.array_sort(decoded.cast("array<string>")), 1, 3), "|"))
    return g.select("k", F.sha2(text, 256).alias("ids_sha"), F.sha2(canonical, 256).alias("json_sha"), kept.alias("decoded"))
