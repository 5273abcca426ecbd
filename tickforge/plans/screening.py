"""Scores, judgements, sizing and data-quality verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import banded, half_up, ratio, rounded, week_label
from tickforge.operators import signals
from tickforge.plans.registry import query
from tickforge.sources.tables import BARS_SQL, FACTS_SQL, MARKET_SQL, bars_daily, facts, market, table

PART_SQL = "p AS (SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS per, p_retailprice / 1000 AS pbr, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 8.0 END AS dy, p_size / 250.0 AS roe, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 10.0 END AS benefit, p_size - 25.0 AS dev, p_size * 2.0 AS rsi, p_size - 30.0 AS macd, CASE WHEN p_size % 11 = 0 THEN NULL ELSE 25.0 - p_size END AS sig FROM part)"


def _band_sql(x: str, steps: list[tuple[str, float, float]], otherwise: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} {op} {b} THEN {s}" for op, b, s in steps) + f" ELSE {otherwise} END"


def _mean_sql(parts: list[tuple[str, float]]) -> str:
    return f"round(({' + '.join(f'coalesce({s} * {w}, 0)' for s, w in parts)}) / nullif({' + '.join(f'CASE WHEN {s} IS NULL THEN 0 ELSE {w} END' for s, w in parts)}, 0), 2)"


FUND_SQL = _mean_sql([("a1", 0.25), ("a2", 0.20), ("a3", 0.25), ("a4", 0.15), ("a5", 0.15)])
TECH_SQL = _mean_sql([("b1", 0.45), ("b2", 0.35), ("b3", 0.20)])


@query(f"""WITH {PART_SQL}, s AS (SELECT k, {_band_sql('per', [('<', 10, 100), ('<', 15, 80), ('<', 20, 60), ('<', 30, 40)], 20)} AS a1, {_band_sql('pbr', [('<', 0.5, 100), ('<', 1, 80), ('<', 1.5, 60), ('<', 2, 40)], 20)} AS a2,
  {_band_sql('dy', [('>', 5, 100), ('>=', 4, 80), ('>=', 3, 60), ('>=', 2, 40), ('>=', 1, 20)], 10)} AS a3, {_band_sql('roe * 100', [('>', 15, 100), ('>=', 10, 80), ('>=', 5, 60), ('>=', 0, 40)], 20)} AS a4, {_band_sql('benefit', [('>', 5, 100), ('>=', 3, 80), ('>=', 2, 60), ('>=', 1, 40)], 20)} AS a5,
  {_band_sql('dev', [('<', -10, 100), ('<', -5, 80), ('<', 0, 60), ('<', 5, 40)], 20)} AS b1, {_band_sql('rsi', [('<', 30, 100), ('<', 40, 80), ('<', 50, 60), ('<', 60, 40), ('<', 70, 20)], 10)} AS b2,
  CASE WHEN macd IS NULL OR sig IS NULL THEN NULL WHEN macd > sig AND macd < 0 THEN 100 WHEN macd > sig THEN 60 ELSE 20 END AS b3 FROM p)
SELECT k, CAST({FUND_SQL} AS DOUBLE) AS fundamental, CAST({TECH_SQL} AS DOUBLE) AS technical, CAST(round(0.6 * {FUND_SQL} + 0.4 * {TECH_SQL}, 3) AS DOUBLE) AS total FROM s""")
def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    unless = lambda n, x: F.when(size % n != 0, x)
    fundamental = signals.fundamental_score(unless(7, size), F.col("p_retailprice") / 1000, unless(5, size / 8.0), size / 250.0, unless(3, size / 10.0))
    technical = signals.technical_score(size - 25.0, size * 2.0, size - 30.0, unless(11, 25.0 - size))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), fundamental.alias("fundamental"), technical.alias("technical"))
    return rows.withColumn("total", rounded(0.6 * F.col("fundamental") + 0.4 * F.col("technical"), 3))


@query("""SELECT k, CASE WHEN vi IS NULL THEN 'HOLD' WHEN vi > 35 THEN 'D' WHEN vix > 20 AND sp <= -1 THEN 'D' WHEN vi >= 30 THEN 'C' WHEN vi > 25 THEN 'B' WHEN vi < 20 THEN 'B' WHEN turnover >= 1.2 AND abs(gap) <= 200 THEN 'A' WHEN turnover IS NOT NULL AND gap IS NOT NULL THEN 'B' ELSE 'HOLD' END AS judgement
FROM (SELECT event_id AS k, CASE WHEN event_type = 'signup' THEN NULL ELSE 15 + value % 25 END AS vi, value % 30 AS vix, (user_id % 5) - 2.0 AS sp, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 0.9 + (user_id % 6) * 0.1 END AS turnover, (user_id % 11) * 50.0 - 250 AS gap FROM events)""")
def macro_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, user = F.col("value"), F.col("user_id")
    verdict = signals.macro_judgement(F.when(F.col("event_type") != "signup", 15 + value % 25), value % 30, (user % 5) - 2.0, F.when(user % 7 != 0, 0.9 + (user % 6) * 0.1), (user % 11) * 50.0 - 250)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), verdict.alias("judgement"))


@query(f"""WITH {FACTS_SQL}, y AS (SELECT k, fy, sum(amount) AS amount FROM facts GROUP BY k, fy), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fy DESC) AS n, amount / lag(amount) OVER (PARTITION BY k ORDER BY fy) AS step, fy - lag(fy) OVER (PARTITION BY k ORDER BY fy) AS years FROM y),
g AS (SELECT k, count(*) AS n, arg_max(amount, fy) / arg_min(amount, fy) - 1 AS change, bool_or(n < 3 AND (step > 2 OR step < 0.5)) AS broken, bool_or(n < 3 AND years <> 1) AS gap, bool_or(n < 3 AND step < 0.95) AS fell, bool_or(n < 3 AND step > 1.05) AS rose FROM l WHERE n <= 3 GROUP BY k)
SELECT k, trend, margin, coalesce(trend = 1 AND margin >= 5, false) AS blue_chip FROM (SELECT k, CASE WHEN n < 3 OR broken OR gap THEN NULL WHEN change > 0.05 AND NOT fell THEN 1 WHEN change < -0.05 AND NOT rose THEN -1 ELSE 0 END AS trend, round(margin, 2) AS margin FROM g LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal / 500 END AS margin FROM customer) USING (k))""")
def blue_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of the last three fiscal years, null unless all three follow each other without a definition break; a blue chip rises at an operating margin of 5 % at least (the balance stands in for it)."""
    years = facts(spark, sf_dir).groupBy("k", "fy").agg(F.sum("amount").alias("amount"))
    order, newest = Window.partitionBy("k").orderBy("fy"), Window.partitionBy("k").orderBy(F.desc("fy"))
    rows = years.select("k", "fy", "amount", F.row_number().over(newest).alias("n"), ratio("amount", F.lag("amount").over(order)).alias("step"), (F.col("fy") - F.lag("fy").over(order)).alias("years")).where("n <= 3")
    any_ = lambda cond: F.bool_or((F.col("n") < 3) & cond)
    step = F.col("step")
    g = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (ratio(F.max_by("amount", "fy"), F.min_by("amount", "fy")) - 1).alias("change"), any_((step > 2) | (step < 0.5)).alias("broken"), any_(F.col("years") != 1).alias("gap"), any_(step < 0.95).alias("fell"), any_(step > 1.05).alias("rose"))
    verdict = F.when((F.col("n") < 3) | F.col("broken") | F.col("gap"), F.lit(None).cast("int")).when((F.col("change") > 0.05) & ~F.col("fell"), 1).when((F.col("change") < -0.05) & ~F.col("rose"), -1).otherwise(0)
    margin = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), rounded(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 500), 2).alias("margin"))
    rows = g.select("k", verdict.alias("trend")).join(margin, "k", "left")
    return rows.select("k", "trend", "margin", F.coalesce((F.col("trend") == 1) & (F.col("margin") >= 5), F.lit(False)).alias("blue_chip"))


@query("""SELECT p_partkey AS k, CAST(lots AS BIGINT) AS shares, round(reward, 4) AS reward, array_to_string(list_filter([CASE WHEN lots = 0 THEN 'too_small' END, CASE WHEN reward < 2 THEN 'low_reward' END, CASE WHEN lots * p_retailprice > 1000000 THEN 'over_account' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM (SELECT *, floor(20000 / nullif(p_retailprice * 0.002 * p_size, 0) / 100) * 100 AS lots, (p_retailprice * 0.05) / nullif(p_retailprice * 0.002 * p_size, 0) AS reward FROM part)""")
def position_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares in lots of 100 that lose 2 % of an account of a million at the stop, with warnings (the last one where they cost more than the account)."""
    price = F.col("p_retailprice")
    risk = price * 0.002 * F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), price.alias("price"), (F.floor(ratio(F.lit(20000.0), risk) / 100) * 100).alias("shares"), ratio(price * 0.05, risk).alias("reward"))
    warnings = F.array_compact(F.array(F.when(F.col("shares") == 0, "too_small"), F.when(F.col("reward") < 2, "low_reward"), F.when(F.col("shares") * F.col("price") > 1_000_000, "over_account")))
    return rows.select("k", "shares", rounded("reward").alias("reward"), F.array_join(warnings, ",").alias("warnings"))


@query(f"WITH {BARS_SQL}, {MARKET_SQL} SELECT d, round(dd, 6) AS drawdown, CASE WHEN dd > -0.05 THEN 'normal' WHEN dd > -0.1 THEN 'watch' WHEN dd > -0.15 THEN 'reduce' WHEN dd > -0.2 THEN 'half' ELSE 'stop' END AS mode FROM (SELECT d, round(c / max(c) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1, 6) AS dd FROM market)")
def drawdown_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawdown of the index from its highest close so far, in five bands; the index has a row per day."""
    run = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = market(spark, sf_dir).select("d", rounded(F.col("c") / F.max("c").over(run) - 1, 6).alias("drawdown"))
    dd = F.col("drawdown")
    return rows.select("d", "drawdown", F.when(dd > -0.05, "normal").when(dd > -0.1, "watch").when(dd > -0.15, "reduce").when(dd > -0.2, "half").otherwise("stop").alias("mode"))


@query("SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(CAST(date_trunc('week', o_orderdate) AS DATE)) AS monday FROM orders GROUP BY 1")
def iso_week_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(week_label("o_orderdate").alias("week")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"), F.min(F.to_date(F.date_trunc("week", "o_orderdate"))).alias("monday"))


@query("""SELECT event_id AS k, round(coalesce((SELECT sum(greatest(0, least(epoch(e), epoch(d) + 15 * 3600) - greatest(epoch(b), epoch(d) + 9 * 3600))) FROM (SELECT unnest(generate_series(date_trunc('day', b), date_trunc('day', e), INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) NOT IN (0, 6)), 0) / 3600, 4) AS hours
FROM (SELECT event_id, ts AS b, ts + INTERVAL 1 HOUR * CAST(round(value) AS INT) AS e FROM events)""")
def business_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of weekday sessions (9 to 15) between an event and round(value) hours later."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("ts").cast("timestamp").alias("b"), (F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.floor(F.col("value") + 0.5).cast("int"))).alias("e"))
    seconds = lambda x: F.unix_micros(x) / 1e6
    days = F.filter(F.sequence(F.date_trunc("day", "b"), F.date_trunc("day", "e"), F.expr("interval 1 day")), lambda d: ~F.dayofweek(d).isin(1, 7))
    inside = F.transform(days, lambda d: F.greatest(F.lit(0.0), F.least(seconds(F.col("e")), seconds(d) + 15 * 3600) - F.greatest(seconds(F.col("b")), seconds(d) + 9 * 3600)))
    return rows.select("k", rounded(F.aggregate(inside, F.lit(0.0), lambda a, x: a + x) / 3600).alias("hours"))


@query("""SELECT k, runs, failed, CASE WHEN runs = 0 THEN 'unknown' WHEN last < TIMESTAMP '2024-01-27' THEN 'not_refreshed' WHEN failed > 0.3 * runs THEN 'red' WHEN failed > 0.2 * runs THEN 'yellow' ELSE 'green' END AS verdict
FROM (SELECT user_id AS k, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, max(ts) AS last FROM events GROUP BY user_id)""")
def slo_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failed"), F.max("ts").alias("last"))
    verdict = F.when(F.col("runs") == 0, "unknown").when(F.col("last") < F.lit("2024-01-27").cast("timestamp"), "not_refreshed").when(F.col("failed") > 0.3 * F.col("runs"), "red").when(F.col("failed") > 0.2 * F.col("runs"), "yellow").otherwise("green")
    return g.select("k", "runs", "failed", verdict.alias("verdict"))


@query("SELECT k, fy, count(*) AS filings, CAST(sum(CAST(floor(amount * 1000 + 0.5) AS BIGINT)) AS BIGINT) AS yen FROM (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS fy, o_totalprice AS amount FROM orders) GROUP BY k, fy")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("k", "fy").agg(F.count(F.lit(1)).alias("filings"), F.sum(half_up(F.col("amount") * 1000)).alias("yen"))


@query(f"WITH {BARS_SQL} SELECT k, d, array_to_string(list_filter([CASE WHEN h / l > 40 THEN 'wide' END, CASE WHEN v < 2 THEN 'thin' END, CASE WHEN c > 1.5 * pc OR c < pc / 1.5 THEN 'jump' END], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY d) AS pc FROM bars) WHERE h / l > 40 OR v < 2 OR c > 1.5 * pc OR c < pc / 1.5")
def invalid_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with what is wrong with each."""
    rows = bars_daily(spark, sf_dir).withColumn("pc", F.lag("c").over(Window.partitionBy("k").orderBy("d")))
    c, pc = F.col("c"), F.col("pc")
    found = F.array_compact(F.array(F.when(F.col("h") / F.col("l") > 40, "wide"), F.when(F.col("v") < 2, "thin"), F.when((c > 1.5 * pc) | (c < pc / 1.5), "jump")))
    return rows.select("k", "d", F.array_join(found, ",").alias("problems")).where("problems <> ''")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CASE WHEN rank_ = 3 THEN 'internal' WHEN rank_ = 2 THEN 'cite' ELSE 'open' END AS license FROM (SELECT *, max(CASE WHEN l_tax > 0.07 THEN 3 WHEN l_tax > 0.03 THEN 2 ELSE 1 END) OVER (PARTITION BY l_returnflag, l_linestatus) AS rank_ FROM lineitem) GROUP BY l_returnflag, l_linestatus, rank_")
def license_strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived row takes the strictest license of its inputs."""
    rank = banded("l_tax", [(">", 0.07, 3), (">", 0.03, 2)], 1)
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("r"))
    return g.select("flag", "status", "n", F.when(F.col("r") == 3, "internal").when(F.col("r") == 2, "cite").otherwise("open").alias("license"))
