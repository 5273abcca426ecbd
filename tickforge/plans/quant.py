"""Statistics over returns, sector aggregates, valuation and risk."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import implied_volatility, option_terms, ratio, rounded
from tickforge.operators.series import by_day, latest, numbered
from tickforge.plans.registry import query
from tickforge.plans.technical import RECENT_SQL, TR_SQL, atr14_wilder, wilder_sql
from tickforge.sources.tables import BARS_SQL, MARKET_SQL, STOCKS_SQL, bars_daily, market, stocks, spread, table

LOGS_SQL = "logs AS (SELECT k, d, c, ln(c / lag(c) OVER (PARTITION BY k ORDER BY d)) AS r FROM bars WHERE c > 0)"
YEAR = math.sqrt(252)


def log_returns(bars: DataFrame) -> DataFrame:
    return bars.where("c > 0").select("k", "d", "c", F.log(F.col("c") / F.lag("c").over(by_day())).alias("r"))


@query(f"WITH {BARS_SQL}, {LOGS_SQL} SELECT k, round(CASE WHEN count(r) >= 20 THEN stddev_samp(r) * sqrt(252) END, 6) AS vol, count(r) AS n FROM logs GROUP BY k")
def hist_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_returns(bars_daily(spark, sf_dir)).groupBy("k").agg(F.stddev_samp("r").alias("s"), F.count("r").alias("n"))
    return rows.select("k", rounded(F.when(F.col("n") >= 20, F.col("s") * YEAR), 6).alias("vol"), "n")


@query(f"""WITH {BARS_SQL}, {MARKET_SQL}, s AS (SELECT k, d, c / lag(c) OVER (PARTITION BY k ORDER BY d) - 1 AS y FROM bars), m AS (SELECT d, c / lag(c) OVER (ORDER BY d) - 1 AS x FROM market)
SELECT k, round(regr_slope(y, x), 6) AS beta, round(regr_intercept(y, x), 6) AS alpha, round(regr_r2(y, x), 6) AS r2, round(corr(y, x), 6) AS corr, round(stddev_pop(y) * sqrt(252), 6) AS vol, round(stddev_pop(x) * sqrt(252), 6) AS market_vol, regr_count(y, x) AS n FROM s JOIN m USING (d) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY k HAVING count(*) >= 30 AND var_pop(x) <> 0""")
def beta_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope, intercept, fit, correlation and yearly volatilities against the index on at least thirty common days on which it moved; the index has one row per day, so its window is over days alone."""
    own = bars_daily(spark, sf_dir).select("k", "d", (ratio("c", F.lag("c").over(by_day())) - 1).alias("y"))
    index = market(spark, sf_dir).select("d", (ratio("c", F.lag("c").over(Window.orderBy("d"))) - 1).alias("x"))
    pairs = own.join(index, "d").where("x is not null and y is not null")
    fit = pairs.groupBy("k").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"), F.corr("y", "x").alias("corr"), (F.stddev_pop("y") * YEAR).alias("vol"), (F.stddev_pop("x") * YEAR).alias("market_vol"), F.count(F.lit(1)).alias("n")).where("n >= 30 and market_vol <> 0")
    return fit.select("k", *(rounded(c, 6).alias(c) for c in ("beta", "alpha", "r2", "corr", "vol", "market_vol")), "n")


@query(f"""WITH {BARS_SQL}, w AS (SELECT *, ln(c / lag(c) OVER (PARTITION BY k ORDER BY d)) AS r FROM (SELECT * FROM bars WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) <= 60)),
s AS (SELECT k, arg_max(c, d) / arg_min(c, d) - 1 AS cum, stddev_samp(r) * sqrt(252) AS vol, count(*) AS n FROM w GROUP BY k)
SELECT k, round(cum, 6) AS cum, round(CASE WHEN vol = 0 THEN 0 ELSE cum / vol END, 6) AS score, CAST(row_number() OVER (ORDER BY CASE WHEN vol = 0 THEN 0 ELSE cum / vol END DESC, k) AS INT) AS place FROM s WHERE n = 60""")
def momentum_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return over the last 60 closes per unit of risk; one row per stock is ranked."""
    rows = log_returns(latest(bars_daily(spark, sf_dir).where("c > 0"), 60))
    s = rows.groupBy("k").agg((F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("cum"), (F.stddev_samp("r") * YEAR).alias("vol"), F.count(F.lit(1)).alias("n")).where("n = 60")
    s = s.withColumn("score", F.when(F.col("vol") == 0, 0.0).otherwise(F.col("cum") / F.col("vol")))
    ranked, _ = numbered(s, F.desc("score"), F.col("k"), name="place")
    return ranked.select("k", rounded("cum", 6).alias("cum"), rounded("score", 6).alias("score"), F.col("place").cast("int").alias("place"))


@query(f"WITH {BARS_SQL}, {RECENT_SQL} SELECT k, round(pct, 4) AS atr_pct FROM (SELECT k, {wilder_sql(TR_SQL, 14)} / rows[-1].c * 100 AS pct FROM recent WHERE len(rows) >= 15) WHERE pct > 0 AND pct < 30")
def low_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks whose average true range is over 0 and under a bound, in per cent of the close (1.5 for daily prices; 30 for the tables' wide bars)."""
    return atr14_wilder(spark, sf_dir).where("atr_pct > 0 and atr_pct < 30").select("k", "atr_pct")


@query(f"WITH {STOCKS_SQL} SELECT code, round(s_acctbal, 2) AS cap FROM stocks JOIN supplier ON s_suppkey = k WHERE s_acctbal > 0 AND s_acctbal < 5000")
def small_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0 and s_acctbal < 5000").select(F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("code"), rounded("s_acctbal", 2).alias("cap"))


LAST_SQL = "last AS (SELECT k, d, c, v, lag(c) OVER o AS pc, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS rn FROM bars WINDOW o AS (PARTITION BY k ORDER BY d))"


@query(f"""WITH {BARS_SQL}, {STOCKS_SQL}, {LAST_SQL}, g AS (SELECT coalesce(sector, 'unclassified') AS sector, avg((c / pc - 1) * 100) AS pct, count(c / pc) AS n FROM last JOIN stocks USING (k) WHERE rn = 1 GROUP BY 1)
SELECT sector, round(pct, 4) AS pct, n, CAST(row_number() OVER (ORDER BY round(pct, 4) DESC NULLS LAST, sector) AS INT) AS place FROM g""")
def sector_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change of each sector's stocks on their last day, ranked; one row per sector is ordered."""
    rows = latest(bars_daily(spark, sf_dir).select("k", "d", "c", F.lag("c").over(by_day()).alias("pc"))).join(stocks(spark, sf_dir), "k")
    pct = (ratio("c", "pc") - 1) * 100
    g = rows.groupBy(F.coalesce("sector", F.lit("unclassified")).alias("sector")).agg(rounded(F.avg(pct)).alias("pct"), F.count(pct).alias("n"))
    return g.select("sector", "pct", "n", F.row_number().over(Window.orderBy(F.desc_nulls_last("pct"), "sector")).alias("place"))


@query(f"""WITH {BARS_SQL}, {STOCKS_SQL}, b AS (SELECT k, d, c * v AS t, c, lag(c) OVER (PARTITION BY k ORDER BY d) AS pc FROM bars),
g AS (SELECT year(d) AS y, coalesce(sector, 'unclassified') AS sector, sum(t) AS turnover, sum(CASE WHEN c > pc THEN t ELSE 0 END) AS up, sum(CASE WHEN c < pc THEN t ELSE 0 END) AS down, count(DISTINCT k) AS stocks FROM b JOIN stocks USING (k) GROUP BY 1, 2)
SELECT CAST(y AS INT) AS y, sector, round(turnover, 2) AS turnover, round(up, 2) AS up, round(down, 2) AS down, stocks, round(turnover / sum(turnover) OVER (PARTITION BY y), 6) AS share FROM g""")
def sector_turnover_updown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars_daily(spark, sf_dir).select("k", "d", (F.col("c") * F.col("v")).alias("t"), "c", F.lag("c").over(by_day()).alias("pc")).join(stocks(spark, sf_dir).select("k", "sector"), "k")
    part = lambda when: F.sum(F.when(when, F.col("t")).otherwise(0.0))
    g = rows.groupBy(F.year("d").alias("y"), F.coalesce("sector", F.lit("unclassified")).alias("sector")).agg(F.sum("t").alias("turnover"), part(F.col("c") > F.col("pc")).alias("up"), part(F.col("c") < F.col("pc")).alias("down"), F.count_distinct("k").alias("stocks"))
    share = F.col("turnover") / F.sum("turnover").over(Window.partitionBy("y"))
    return g.select("y", "sector", *(rounded(c, 2).alias(c) for c in ("turnover", "up", "down")), "stocks", rounded(share, 6).alias("share"))


@query("SELECT l_returnflag AS flag, strftime(l_shipdate, '%Y-%m') AS month, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) AS rate FROM lineitem GROUP BY 1, 2")
def weighted_monthly_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return rows.agg(rounded(ratio(F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.sum("l_extendedprice")), 6).alias("rate"))


@query("SELECT user_id AS k, count(*) AS n, round(CASE WHEN count(*) = count(x) THEN sum(x) END, 2) AS total FROM (SELECT user_id, CASE WHEN value < 1 THEN NULL ELSE value END AS x FROM events) GROUP BY user_id")
def poison_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that are null as soon as one part is."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.when(F.col("value") >= 1, F.col("value")).alias("x"))
    g = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("known"), F.sum("x").alias("s"))
    return g.select("k", "n", rounded(F.when(F.col("n") == F.col("known"), F.col("s")), 2).alias("total"))


@query("SELECT coalesce(r_name, 'all') AS region, coalesce(c_mktsegment, 'all') AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)")
def market_share_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(dim), F.col("c_nationkey") == F.col("n_nationkey"))
    g = rows.rollup("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("c_acctbal"), 2).alias("total"))
    return g.select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n", "total")


@query("SELECT p_partkey AS k, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(CASE WHEN r > g + 1e-9 THEN p_retailprice * 0.03 * (1 + g) / (r - g) END, 4) AS fair FROM (SELECT *, 0.06e0 + (i - 2) * 0.01e0 AS r, 0.02e0 + (j - 2) * 0.02e0 AS g FROM part, generate_series(0, 4) AS a(i), generate_series(0, 4) AS b(j))")
def gordon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant-growth value over a grid of five rates by five growth rates; null where the rate is not above growth."""
    five = F.sequence(F.lit(0), F.lit(4))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_retailprice", F.explode(five).alias("i")).withColumn("j", F.explode(five))
    r, g = 0.06 + (F.col("i") - 2) * 0.01, 0.02 + (F.col("j") - 2) * 0.02
    return rows.select("k", "i", "j", rounded(F.when(r > g + 1e-9, F.try_divide(F.col("p_retailprice") * 0.03 * (1 + g), r - g))).alias("fair"))


@query("SELECT p_partkey AS k, round(list_sum(list_transform(range(1, 11), lambda t: p_retailprice * pow(1.05, t) / pow(1.08, t))) + p_retailprice * pow(1.05, 10) * 1.01 / (0.08 - 0.01) / pow(1.08, 10), 4) AS fair FROM part")
def two_stage_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    flows = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda t: price * F.pow(F.lit(1.05), t) / F.pow(F.lit(1.08), t))
    terminal = price * (1.05**10) * 1.01 / (0.08 - 0.01) / (1.08**10)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), rounded(F.aggregate(flows, F.lit(0.0), lambda a, x: a + x) + terminal).alias("fair"))


def _erf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    return f"(0.5 * (1 + sign({x}) * (1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{x} * {x} / 2))))"


@query(f"""WITH o AS (SELECT p_partkey AS k, p_retailprice AS s, p_retailprice * (0.8 + 0.01 * (p_size % 40)) AS x, 0.25 + p_size / 50.0 AS t, 0.02 AS r, 0.15 + 0.005 * p_size AS v FROM part),
d AS (SELECT *, (ln(s / x) + (r + v * v / 2) * t) / (v * sqrt(t)) AS d1, (ln(s / x) + (r + v * v / 2) * t) / (v * sqrt(t)) - v * sqrt(t) AS d2 FROM o),
n AS (SELECT *, {_erf_sql('d1')} AS n1, {_erf_sql('d2')} AS n2, {_erf_sql('(-d1)')} AS m1, {_erf_sql('(-d2)')} AS m2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS f, x * exp(-r * t) AS paid FROM d)
SELECT k, round(s * n1 - paid * n2, 4) AS call, round(paid * m2 - s * m1, 4) AS put, round(n1, 6) AS delta_call, round(n1 - 1, 6) AS delta_put, round(f / (s * v * sqrt(t)), 6) AS gamma, round(s * f * sqrt(t) * 0.01, 4) AS vega,
  round((-s * f * v / (2 * sqrt(t)) - r * paid * n2) / 365, 4) AS theta_call, round((-s * f * v / (2 * sqrt(t)) + r * paid * m2) / 365, 4) AS theta_put, round(paid * t * n2 * 0.01, 4) AS rho_call, round(-paid * t * m2 * 0.01, 4) AS rho_put FROM n""")
def black_scholes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, size = F.col("p_retailprice"), F.col("p_size")
    terms = option_terms(s, s * (0.8 + 0.01 * (size % 40)), 0.25 + size / 50.0, F.lit(0.02), 0.15 + 0.005 * size)
    places = {"delta_call": 6, "delta_put": 6, "gamma": 6}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *(rounded(x, places.get(n, 4)).alias(n) for n, x in terms.items()))


@query("SELECT p_partkey AS k, floor((0.15 + 0.005 * p_size) * 1000 + 0.5001e0) / 1000 AS sigma, floor((0.15 + 0.005 * p_size) * 1000 + 0.5001e0) / 1000 AS implied FROM part")
def implied_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volatility of each option price above, found again from the price by bisection of [0.001, 5] until 1e-5."""
    s, size = F.col("p_retailprice"), F.col("p_size")
    x, t, sigma = s * (0.8 + 0.01 * (size % 40)), 0.25 + size / 50.0, 0.15 + 0.005 * size
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), "p_partkey")
    rows = part.select(F.col("p_partkey").alias("k"), s.alias("s"), x.alias("x"), t.alias("t"), sigma.alias("sigma"), option_terms(s, x, t, F.lit(0.02), sigma)["call"].alias("price"))
    return rows.select("k", rounded("sigma", 3).alias("sigma"), rounded(implied_volatility(F.col("price"), F.col("s"), F.col("x"), F.col("t"), F.lit(0.02)), 3).alias("implied"))


@query(f"WITH {BARS_SQL}, {MARKET_SQL}, m AS (SELECT d, c, c / lag(c) OVER (ORDER BY d) - 1 AS r FROM market) SELECT CAST(year(d) AS INT) AS y, round(stddev_pop(r) * sqrt(252), 6) AS vol, round(arg_max(c, d) / arg_min(c, d) - 1, 6) AS ret, round(0.01 + 1.2 * (arg_max(c, d) / arg_min(c, d) - 1 - 0.01), 6) AS required FROM m GROUP BY 1")
def capm_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = market(spark, sf_dir).select("d", "c", (ratio("c", F.lag("c").over(Window.orderBy("d"))) - 1).alias("r"))
    g = index.groupBy(F.year("d").alias("y")).agg((F.stddev_pop("r") * YEAR).alias("vol"), (F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("ret"))
    return g.select("y", rounded("vol", 6).alias("vol"), rounded("ret", 6).alias("ret"), rounded(0.01 + 1.2 * (F.col("ret") - 0.01), 6).alias("required"))
