"""Technical indicators, volume profiles and signals over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import ratio, rounded
from tickforge.operators import signals
from tickforge.operators.series import array_mean, by_day, ema_last, ema_values, full_mean, history, last_of, last_rows, latest, macd_last, recent, rsi_last, rsi_values, series_of, sma, standings, true_range, wilder_last
from tickforge.plans.registry import query
from tickforge.sources.tables import BARS_SQL, MINUTES_SQL, STOCKS_SQL, bars_daily, bars_minutes, stocks

RECENT_SQL = "recent AS (SELECT k, list(c ORDER BY d) AS xs, list({'h': h, 'l': l, 'c': c} ORDER BY d) AS rows FROM bars GROUP BY k)"


def ema_sql(xs: str, n: int) -> str:
    return f"CASE WHEN len({xs}) >= {n} THEN list_reduce(list_concat([list_sum({xs}[1:{n}]) / {n}], {xs}[{n + 1}:]), lambda a, x: x * {2 / (n + 1)!r} + a * (1 - {2 / (n + 1)!r})) END"


def wilder_sql(xs: str, n: int) -> str:
    return f"CASE WHEN len({xs}) >= {n} THEN list_reduce(list_concat([list_sum({xs}[1:{n}]) / {n}], {xs}[{n + 1}:]), lambda a, x: (a * {n - 1} + x) / {n}) END"


@query(f"WITH {BARS_SQL} SELECT k, d, round(o, 4) AS o, round(h, 4) AS h, round(l, 4) AS l, round(c, 4) AS c, v, n FROM bars")
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("k", "d", *(rounded(x).alias(x) for x in "ohlc"), "v", "n")


@query(f"WITH {MINUTES_SQL} SELECT k, ts, o, h, l, c, v FROM minutes")
def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_minutes(spark, sf_dir)


SCREEN_SQL = f"""WITH {BARS_SQL}, {STOCKS_SQL}, f AS (
  SELECT k, d, c, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS rn,
    CASE WHEN count(c) OVER w5 = 5 THEN avg(c) OVER w5 END AS sma5, CASE WHEN count(c) OVER w20 = 20 THEN avg(c) OVER w20 END AS sma20,
    CASE WHEN count(c) OVER w60 = 60 THEN avg(c) OVER w60 END AS sma60,
    CASE WHEN count(v) OVER p20 = 20 THEN v / nullif(avg(v) OVER p20, 0) END AS volume_ratio, CASE WHEN count(c * v) OVER w20 = 20 THEN avg(c * v) OVER w20 END AS turnover
  FROM bars WINDOW w5 AS (PARTITION BY k ORDER BY d ROWS 4 PRECEDING), w20 AS (PARTITION BY k ORDER BY d ROWS 19 PRECEDING), w60 AS (PARTITION BY k ORDER BY d ROWS 59 PRECEDING),
    p20 AS (PARTITION BY k ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT code, name, sector, d, round(c, 4) AS close, round(sma5, 4) AS sma5, round(sma20, 4) AS sma20, round(volume_ratio, 4) AS volume_ratio, round(turnover, 2) AS turnover,
  coalesce(sma5 > sma20 AND c > sma5, false) AS trend_long, coalesce(sma5 < sma20 AND c < sma5, false) AS trend_short,
  coalesce(sma5 > sma20 AND sma20 > sma60, false) AS perfect_long, coalesce(sma5 < sma20 AND sma20 < sma60, false) AS perfect_short
FROM f JOIN stocks USING (k) WHERE rn = 1 ORDER BY f.turnover DESC NULLS LAST, code LIMIT 200"""


@query(SCREEN_SQL)
def sma_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The swing screen: moving averages, volume ratio, turnover and trend flags of each stock's last bar, by turnover."""
    rows = latest(bars_daily(spark, sf_dir), 60).select(
        "k", "d", "c", full_mean("c", 5).alias("sma5"), full_mean("c", 20).alias("sma20"), full_mean("c", 60).alias("sma60"), ratio("v", full_mean("v", 20, current=False)).alias("volume_ratio"), full_mean(F.col("c") * F.col("v"), 20).alias("turnover")
    )
    flags = signals.trend_flags("c", "sma5", "sma20", "sma60")
    found = latest(rows).join(stocks(spark, sf_dir), "k").withColumns(flags)
    return found.orderBy(F.desc_nulls_last("turnover"), "code").limit(200).select("code", "name", "sector", "d", rounded("c").alias("close"), rounded("sma5").alias("sma5"), rounded("sma20").alias("sma20"), rounded("volume_ratio").alias("volume_ratio"), rounded("turnover", 2).alias("turnover"), *flags)


@query(f"""WITH {BARS_SQL}, {STOCKS_SQL}, {RECENT_SQL}, f AS (
  SELECT k, d, c, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS rn, CASE WHEN count(*) OVER w5 = 5 THEN avg(c) OVER w5 END AS sma5, CASE WHEN count(*) OVER w20 = 20 THEN avg(c) OVER w20 END AS sma20,
    CASE WHEN count(*) OVER p20 = 20 THEN v / nullif(avg(v) OVER p20, 0) END AS vr, CASE WHEN count(*) OVER w20 = 20 THEN avg(c * v) OVER w20 END AS turnover
  FROM bars WINDOW w5 AS (PARTITION BY k ORDER BY d ROWS 4 PRECEDING), w20 AS (PARTITION BY k ORDER BY d ROWS 19 PRECEDING), p20 AS (PARTITION BY k ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
a AS (SELECT k, {wilder_sql("list_transform(range(1, len(rows) + 1), lambda i: CASE WHEN i = 1 THEN rows[i].h - rows[i].l ELSE greatest(rows[i].h - rows[i].l, abs(rows[i].h - rows[i - 1].c), abs(rows[i].l - rows[i - 1].c)) END)", 14)} / rows[-1].c * 100 AS atr_pct FROM recent WHERE len(rows) >= 15),
g AS (SELECT k, coalesce(turnover >= 35000 OR (vr >= 3 AND turnover >= 17500), false) AS liquid, coalesce(atr_pct >= 2, false) AS volatile, coalesce(sma5 > sma20 AND c > sma5, false) AS up, coalesce(sma5 < sma20 AND c < sma5, false) AS down FROM f LEFT JOIN a USING (k) WHERE rn = 1)
SELECT code, liquid, volatile, up, down, liquid AND volatile AND up AS passed_long, liquid AND volatile AND down AS passed_short FROM g JOIN stocks USING (k) WHERE is_active""")
def five_condition_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity, volatility and trend of each active stock's last bar; a null never passes. Turnover bounds are those of the tables (a 28,571st of the yen bounds)."""
    rows = snapshots(spark, sf_dir).withColumn("turnover", F.col("turnover20"))
    flags = signals.five_conditions("turnover", "vr", ratio("atr", "c") * 100, "c", "sma5", "sma20", primary=35_000.0, secondary=17_500.0)
    active = stocks(spark, sf_dir).where("is_active").select("k", "code")
    return rows.select("k", *(x.alias(n) for n, x in flags.items())).join(active, "k").select("code", *flags)


GAPS_SQL = "gaps AS (SELECT k, d, CASE WHEN n % 5 = 0 THEN NULL ELSE c END AS c, h, l, v FROM bars)"


@query(f"""WITH {BARS_SQL}, {GAPS_SQL}, s AS (SELECT k, d, avg(c) OVER w AS m, count(c) OVER w AS n FROM gaps WHERE c IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY d ROWS 19 PRECEDING))
SELECT g.k, g.d, round(x.m, 4) AS sma20 FROM gaps g ASOF LEFT JOIN (SELECT k, d, CASE WHEN n = 20 THEN m END AS m FROM s) x ON g.k = x.k AND g.d >= x.d""")
def sma_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean of the last 20 closes that exist, at every row (closes of days with 5, 10, ... trades taken out)."""
    gaps = bars_daily(spark, sf_dir).withColumn("c", F.when(F.col("n") % 5 != 0, F.col("c")))
    return sma(gaps.select("k", "d", "c"), "c", 20, "sma20").select("k", "d", rounded("sma20").alias("sma20"))


@query(f"""WITH {BARS_SQL} SELECT k, d, round(hi, 4) AS high20, round(lo, 4) AS low20, round(hi - 0.382 * (hi - lo), 4) AS fib382, round(hi - 0.5 * (hi - lo), 4) AS fib500, round(hi - 0.618 * (hi - lo), 4) AS fib618
FROM (SELECT k, d, max(h) OVER w AS hi, min(l) OVER w AS lo, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY k ORDER BY d ROWS 19 PRECEDING)) WHERE n = 20""")
def range_fib(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = last_rows(20)
    rows = bars_daily(spark, sf_dir).select("k", "d", F.max("h").over(frame).alias("hi"), F.min("l").over(frame).alias("lo"), F.count(F.lit(1)).over(frame).alias("n")).where("n = 20")
    back = lambda share: rounded(F.col("hi") - share * (F.col("hi") - F.col("lo")))
    return rows.select("k", "d", rounded("hi").alias("high20"), rounded("lo").alias("low20"), back(0.382).alias("fib382"), back(0.5).alias("fib500"), back(0.618).alias("fib618"))


@query(f"WITH {BARS_SQL} SELECT k, d, round(CASE WHEN count(v) OVER p = 20 THEN v / nullif(avg(v) OVER p, 0) END, 4) AS volume_ratio FROM bars WINDOW p AS (PARTITION BY k ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def volume_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("k", "d", rounded(ratio("v", full_mean("v", 20, current=False))).alias("volume_ratio"))


@query(f"WITH {BARS_SQL}, {GAPS_SQL} SELECT k, d, round(CASE WHEN count(c * v) OVER w = 20 THEN avg(c * v) OVER w END, 4) AS avg_turnover, round(CASE WHEN count(v) OVER w = 20 THEN avg(v) OVER w END, 4) AS avg_volume FROM gaps WINDOW w AS (PARTITION BY k ORDER BY d ROWS 19 PRECEDING)")
def avg_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = bars_daily(spark, sf_dir).withColumn("c", F.when(F.col("n") % 5 != 0, F.col("c")))
    return gaps.select("k", "d", rounded(full_mean(F.col("c") * F.col("v"), 20)).alias("avg_turnover"), rounded(full_mean("v", 20)).alias("avg_volume"))


@query(f"WITH {BARS_SQL}, {GAPS_SQL} SELECT k, d, round((c / nullif(lag(c) OVER (PARTITION BY k ORDER BY d), 0) - 1) * 100, 4) AS pct FROM gaps WHERE c IS NOT NULL")
def pct_change_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars_daily(spark, sf_dir).where(F.col("n") % 5 != 0)
    return rows.select("k", "d", rounded((ratio("c", F.lag("c").over(by_day())) - 1) * 100).alias("pct"))


@query(f"WITH {BARS_SQL} SELECT k, d, round(greatest(h - l, abs(h - p), abs(l - p)), 4) AS true_range FROM (SELECT *, coalesce(lag(c) OVER (PARTITION BY k ORDER BY d), CASE WHEN true THEN (h + l) / 2 END) AS p FROM bars)", name="true_range")
def true_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars_daily(spark, sf_dir).withColumn("p", F.lag("c").over(by_day()))
    span = F.col("h") - F.col("l")
    wide = F.greatest(span, F.abs(F.col("h") - F.col("p")), F.abs(F.col("l") - F.col("p")))
    return rows.select("k", "d", rounded(F.when(F.col("p").isNull(), span).otherwise(wide)).alias("true_range"))


@query(f"WITH {BARS_SQL}, {RECENT_SQL} SELECT k, round({ema_sql('xs', 12)}, 4) AS ema12, round({ema_sql('xs', 26)}, 4) AS ema26 FROM recent", name="ema_last")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = F.transform("rows", lambda r: r["c"])
    return history(bars_daily(spark, sf_dir), ["c"]).select("k", rounded(ema_last(xs, 12)).alias("ema12"), rounded(ema_last(xs, 26)).alias("ema26"))


MACD_SQL = f"""WITH RECURSIVE {BARS_SQL}, r AS (SELECT k, c AS x, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n FROM bars),
m AS (
  SELECT k, n, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS g FROM (SELECT DISTINCT k, n FROM r)
  UNION ALL
  SELECT k, n, i, f, s, CASE WHEN i < 26 THEN 0 WHEN i < 34 THEN g + f - s WHEN i = 34 THEN (g + f - s) / 9 ELSE (f - s) * 0.2 + g * 0.8 END FROM (
    SELECT m.k, m.n, r.i, CASE WHEN r.i < 12 THEN f + x WHEN r.i = 12 THEN (f + x) / 12 ELSE x * (2.0 / 13) + f * (1 - 2.0 / 13) END AS f,
      CASE WHEN r.i < 26 THEN s + x WHEN r.i = 26 THEN (s + x) / 26 ELSE x * (2.0 / 27) + s * (1 - 2.0 / 27) END AS s, g FROM m JOIN r ON r.k = m.k AND r.i = m.i + 1))
SELECT k, round(CASE WHEN n >= 35 THEN f - s END, 4) AS macd, round(CASE WHEN n >= 35 THEN g END, 4) AS signal, round(CASE WHEN n >= 35 THEN f - s - g END, 4) AS histogram FROM m WHERE i = n"""


@query(MACD_SQL)
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(bars_daily(spark, sf_dir), ["c"]).withColumn("m", macd_last(F.transform("rows", lambda r: r["c"])))
    return rows.select("k", rounded("m.line").alias("macd"), rounded("m.signal").alias("signal"), rounded("m.histogram").alias("histogram"))


MOVES_SQL = "moves AS (SELECT k, list_transform(range(2, len(xs) + 1), lambda i: xs[i] - xs[i - 1]) AS ms FROM recent)"


def rsi_sql(n: int) -> str:
    gain, loss = (wilder_sql(f"list_transform(ms, lambda y: greatest({s}y, 0.0))", n) for s in ("", "-"))
    return f"(SELECT CASE WHEN l = 0 THEN CASE WHEN g = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + g / l) END FROM (SELECT {gain} AS g, {loss} AS l))"


RSI_SQL = f"""{BARS_SQL}, {RECENT_SQL}, {MOVES_SQL}, gl AS (SELECT k, {", ".join(f"{wilder_sql(f'list_transform(ms, lambda y: greatest({s}y, 0.0))', n)} AS {c}{n}" for n in (10, 14, 40, 120) for s, c in (("", "g"), ("-", "l")))} FROM moves),
rsi AS (SELECT k, {", ".join(f"CASE WHEN l{n} = 0 THEN CASE WHEN g{n} = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + g{n} / l{n}) END AS rsi{n}" for n in (10, 14, 40, 120))} FROM gl)"""


def rsi_rows(spark: SparkSession, sf_dir: str, *periods: int) -> DataFrame:
    xs = F.transform("rows", lambda r: r["c"])
    return history(bars_daily(spark, sf_dir), ["c"]).select("k", *(rsi_last(xs, n).alias(f"rsi{n}") for n in periods))


@query(f"WITH {RSI_SQL} SELECT k, round(rsi14, 4) AS rsi14, round(rsi10, 4) AS rsi10, round(rsi40, 4) AS rsi40, round(rsi120, 4) AS rsi120 FROM rsi")
def rsi14_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rsi_rows(spark, sf_dir, 14, 10, 40, 120).select("k", *(rounded(f"rsi{n}").alias(f"rsi{n}") for n in (14, 10, 40, 120)))


RSI_STEPS_SQL = f"""{BARS_SQL}, r AS (SELECT k, d, c AS x, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM bars),
w AS (
  SELECT k, d, i, x, {", ".join(f"CAST(0 AS DOUBLE) AS g{n}, CAST(0 AS DOUBLE) AS l{n}" for n in (10, 40, 120))} FROM r WHERE i = 1
  UNION ALL
  SELECT r.k, r.d, r.i, r.x, {", ".join(f"CASE WHEN r.i <= {n} THEN {s}{n} + greatest({sign}(r.x - w.x), 0) WHEN r.i = {n + 1} THEN ({s}{n} + greatest({sign}(r.x - w.x), 0)) / {n} ELSE ({s}{n} * {n - 1} + greatest({sign}(r.x - w.x), 0)) / {n} END" for n in (10, 40, 120) for s, sign in (("g", ""), ("l", "-")))}
  FROM w JOIN r ON r.k = w.k AND r.i = w.i + 1),
series AS (SELECT k, d, {", ".join(f"CASE WHEN i > {n} THEN CASE WHEN l{n} = 0 THEN CASE WHEN g{n} = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + g{n} / l{n}) END END AS rsi{n}" for n in (10, 40, 120))} FROM w)"""
HORIZONS = (10, 40, 120)


@query(f"WITH RECURSIVE {RSI_STEPS_SQL} SELECT k, d, {', '.join(f'round(rsi{n}, 4) AS rsi{n}' for n in HORIZONS)} FROM series")
def rsi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative strength of three horizons at every bar of every stock."""
    rows = series_of(bars_daily(spark, sf_dir), {f"rsi{n}": (rsi_values, n) for n in HORIZONS})
    return rows.select("k", "d", *(rounded(f"rsi{n}").alias(f"rsi{n}") for n in HORIZONS))


@query(f"""WITH RECURSIVE {BARS_SQL}, r AS (SELECT k, d, c AS x, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM bars), w AS (SELECT k, d, i, x AS f, x AS s FROM r WHERE i = 1
  UNION ALL SELECT r.k, r.d, r.i, {", ".join(f"CASE WHEN r.i < {n} THEN {c} + r.x WHEN r.i = {n} THEN ({c} + r.x) / {n} ELSE r.x * (2.0 / {n + 1}) + {c} * (1 - 2.0 / {n + 1}) END" for n, c in ((12, "f"), (26, "s")))} FROM w JOIN r ON r.k = w.k AND r.i = w.i + 1)
SELECT k, d, round(CASE WHEN i >= 12 THEN f END, 4) AS ema12, round(CASE WHEN i >= 26 THEN s END, 4) AS ema26 FROM w""")
def ema_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series_of(bars_daily(spark, sf_dir), {"ema12": (ema_values, 12), "ema26": (ema_values, 26)})
    return rows.select("k", "d", rounded("ema12").alias("ema12"), rounded("ema26").alias("ema26"))


RSI_STANDINGS_SQL = f"""{RSI_STEPS_SQL}, q AS (SELECT k, d, {", ".join(f"round(rsi{n}, 4) AS rsi{n}" for n in HORIZONS)} FROM series), l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) = 1),
p AS (SELECT l.k, {", ".join(f"any_value(l.rsi{n}) AS rsi{n}, CASE WHEN any_value(l.rsi{n}) IS NOT NULL THEN round((count(*) FILTER (q.rsi{n} < l.rsi{n}) + 0.5 * count(*) FILTER (q.rsi{n} = l.rsi{n})) / nullif(count(q.rsi{n}), 0) * 100, 4) END AS pct{n}, count(q.rsi{n}) AS bars{n}" for n in HORIZONS)} FROM l JOIN q USING (k) GROUP BY l.k), standings AS (SELECT *, CAST(least(pct10, pct40, pct120) AS DOUBLE) AS pct_min FROM p)"""


@query(f"WITH RECURSIVE {RSI_STANDINGS_SQL} SELECT * FROM standings")
def rsi_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stock's last relative strength among its own history, for three horizons: mid-rank percentile, bars it is taken from, and the least of the three."""
    return rsi_standings(spark, sf_dir).drop("d")


def rsi_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rsi_percentile with the last day, one pass over each stock's bars."""
    found = standings(bars_daily(spark, sf_dir), {f"rsi{n}": (rsi_values, n) for n in HORIZONS})
    pct = lambda n: F.when(F.col(f"rsi{n}").isNotNull(), rounded(ratio(f"under_rsi{n}", f"bars_rsi{n}") * 100)).alias(f"pct{n}")
    found = found.select("k", "d", *(x for n in HORIZONS for x in (f"rsi{n}", pct(n), F.col(f"bars_rsi{n}").alias(f"bars{n}"))))
    return found.withColumn("pct_min", F.least(*(f"pct{n}" for n in HORIZONS)))


TR_SQL = "list_transform(range(1, len(rows) + 1), lambda i: CASE WHEN i = 1 THEN rows[i].h - rows[i].l ELSE greatest(rows[i].h - rows[i].l, abs(rows[i].h - rows[i - 1].c), abs(rows[i].l - rows[i - 1].c)) END)"


@query(f"WITH {BARS_SQL}, {RECENT_SQL}, t AS (SELECT k, rows, {TR_SQL} AS trs FROM recent) SELECT k, round(CASE WHEN len(rows) >= 15 THEN {wilder_sql('trs', 14)} END, 4) AS atr14, round(CASE WHEN len(rows) >= 15 THEN {wilder_sql('trs', 14)} / rows[-1].c * 100 END, 4) AS atr_pct FROM t")
def atr14_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(bars_daily(spark, sf_dir), ["h", "l", "c"]).withColumn("atr", F.when(F.size("rows") >= 15, wilder_last(true_range(F.col("rows")), 14)))
    return rows.select("k", rounded("atr").alias("atr14"), rounded(ratio("atr", F.element_at("rows", -1)["c"]) * 100).alias("atr_pct"))


SNAPSHOT_SQL = f"""{BARS_SQL}, {RECENT_SQL}, {MOVES_SQL}, f AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS rn, lag(c) OVER o AS pc, lag(h) OVER o AS ph, lag(l) OVER o AS pl, max(h) OVER w20 AS hi, min(l) OVER w20 AS lo,
    CASE WHEN count(c) OVER w5 = 5 THEN avg(c) OVER w5 END AS sma5, CASE WHEN count(c) OVER w20 = 20 THEN avg(c) OVER w20 END AS sma20, CASE WHEN count(c) OVER w60 = 60 THEN avg(c) OVER w60 END AS sma60,
    CASE WHEN count(v) OVER p20 = 20 THEN v / nullif(avg(v) OVER p20, 0) END AS vr
  FROM bars WINDOW o AS (PARTITION BY k ORDER BY d), w5 AS (PARTITION BY k ORDER BY d ROWS 4 PRECEDING), w20 AS (PARTITION BY k ORDER BY d ROWS 19 PRECEDING), w60 AS (PARTITION BY k ORDER BY d ROWS 59 PRECEDING), p20 AS (PARTITION BY k ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
a AS (SELECT k, {wilder_sql(TR_SQL, 14)} AS atr FROM recent WHERE len(rows) >= 15),
g AS (SELECT k, {wilder_sql("list_transform(ms, lambda y: greatest(y, 0.0))", 14)} AS g, {wilder_sql("list_transform(ms, lambda y: greatest(-y, 0.0))", 14)} AS s FROM moves),
snap AS (SELECT f.*, atr, CASE WHEN s = 0 THEN CASE WHEN g = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + g / s) END AS rsi, (c / pc - 1) * 100 AS pct, (o / pc - 1) * 100 AS gap, hi - lo AS width, hi - 0.382 * (hi - lo) AS f382, hi - 0.618 * (hi - lo) AS f618
  FROM f LEFT JOIN a USING (k) LEFT JOIN g USING (k) WHERE rn = 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stock with what the signals look at: its bars are put in order once, and all else is read from their array."""
    rows = history(bars_daily(spark, sf_dir), ["o", "h", "l", "c", "v"])
    last, prior = F.element_at("rows", -1), F.get("rows", F.size("rows") - 2)
    of = lambda x: (lambda r: r[x])
    month = last_of("rows", 20)
    rows = rows.select(
        "k", *(last[x].alias(x) for x in ("d", *"ohlcv")), *(prior[x].alias(f"p{x}") for x in "chl"), F.array_max(F.transform(month, of("h"))).alias("hi"), F.array_min(F.transform(month, of("l"))).alias("lo"),
        *(array_mean("rows", of("c"), n).alias(f"sma{n}") for n in (5, 20, 60)), ratio(last["v"], array_mean("rows", of("v"), 20, current=False)).alias("vr"), array_mean("rows", lambda r: r["c"] * r["v"], 20).alias("turnover20"),
        F.when(F.size("rows") >= 15, wilder_last(true_range(F.col("rows")), 14)).alias("atr"), rsi_last(F.transform("rows", of("c")), 14).alias("rsi"),
    )
    width = F.col("hi") - F.col("lo")
    return rows.select("*", ((ratio("c", "pc") - 1) * 100).alias("pct"), ((ratio("o", "pc") - 1) * 100).alias("gap"), width.alias("width"), (F.col("hi") - 0.382 * width).alias("f382"), (F.col("hi") - 0.618 * width).alias("f618"))


@query(f"""WITH {SNAPSHOT_SQL}, s AS (
  SELECT k, 'breakout_long' AS pattern, 'long' AS side, c AS entry, hi - 0.5 * width AS stop, c + width AS target, 20 * vr AS strength FROM snap WHERE c >= hi AND vr >= 1.5 AND width > 0
  UNION ALL SELECT k, 'breakout_short', 'short', c, lo + 0.5 * width, c - width, 20 * vr FROM snap WHERE c <= lo AND vr >= 1.5 AND width > 0
  UNION ALL SELECT k, 'pullback_long', 'long', c, f618, hi, 40 + greatest(0, 2 * (50 - rsi)) FROM snap WHERE sma5 > sma20 AND sma20 > sma60 AND c BETWEEN f618 AND f382 AND (rsi < 40 OR (c > o AND o - l > (c - o) * 1.5)) AND rsi IS NOT NULL
  UNION ALL SELECT k, 'pullback_short', 'short', c, f382, lo, 40 + greatest(0, 2 * (rsi - 50)) FROM snap WHERE sma5 < sma20 AND sma20 < sma60 AND c BETWEEN f618 AND f382 AND (rsi > 60 OR (c < o AND h - o > (o - c) * 1.5)) AND rsi IS NOT NULL
  UNION ALL SELECT k, 'volume_surge', CASE WHEN pct > 0 THEN 'long' ELSE 'short' END, c, CASE WHEN pct > 0 THEN pl ELSE ph END, c + sign(pct) * 2 * atr, 15 * vr + 2 * abs(pct) FROM snap WHERE vr >= 3 AND abs(pct) >= 3 AND atr IS NOT NULL
  UNION ALL SELECT k, CASE WHEN follow THEN 'gap_follow' ELSE 'gap_fade' END, CASE WHEN (gap > 0) = follow THEN 'long' ELSE 'short' END, c,
      CASE WHEN follow THEN CASE WHEN gap > 0 THEN hi ELSE lo END ELSE c + sign(gap) * 1.5 * atr END, CASE WHEN follow THEN c + sign(gap) * 2 * atr ELSE pc END, CASE WHEN follow THEN 50 + 10 * vr ELSE 40 END
    FROM (SELECT *, (o > ph OR o < pl) AND vr >= 2 AS follow, o < ph AND o > pl AND vr < 1.3 AS fade FROM snap WHERE abs(gap) >= 1.5 AND atr IS NOT NULL) WHERE follow OR fade
  UNION ALL SELECT k, 'post_earnings', CASE WHEN pct > 0 THEN 'long' ELSE 'short' END, c, c - sign(pct) * 1.5 * atr, c + sign(pct) * 3 * atr, 50 + 10 * vr FROM snap WHERE vr >= 2.5 AND abs(pct) >= 5 AND atr / c * 100 >= 3)
SELECT k, pattern, side, round(entry, 4) AS entry, round(stop, 4) AS stop, round(target, 4) AS target, round(least(strength, 100), 4) AS strength, round(abs(target - entry) / nullif(abs(entry - stop), 0), 4) AS reward FROM s""")
def entry_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).select("k", F.inline(signals.patterns()))
    reward = ratio(F.abs(F.col("target") - F.col("entry")), F.abs(F.col("entry") - F.col("stop")))
    return rows.select("k", "pattern", "side", rounded("entry").alias("entry"), rounded("stop").alias("stop"), rounded("target").alias("target"), rounded(F.least("strength", F.lit(100.0))).alias("strength"), rounded(reward).alias("reward"))


@query(f"WITH {MINUTES_SQL} SELECT k, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo' AS DATE) AS day, round(arg_max(vwap, ts), 4) AS vwap FROM (SELECT k, ts, sum((h + l + c) / 3 * v) OVER w / sum(v) OVER w AS vwap FROM minutes WINDOW w AS (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING)) GROUP BY k, day")
def vwap_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume-weighted price from the first bar on, at the end of each day: days' sums are partial, only days are ordered."""
    typical = (F.col("h") + F.col("l") + F.col("c")) / 3
    day = F.to_date(F.from_utc_timestamp("ts", "Asia/Tokyo"))
    days = bars_minutes(spark, sf_dir).groupBy("k", day.alias("day")).agg(F.sum(typical * F.col("v")).alias("paid"), F.sum("v").alias("v"))
    run = Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("k", "day", rounded(F.sum("paid").over(run) / F.sum("v").over(run)).alias("vwap"))


BINS = 50
PROFILE_SQL = f"""{MINUTES_SQL}, r AS (SELECT k, min(l) AS lo, max(h) AS hi FROM minutes GROUP BY k HAVING max(h) > min(l)),
b AS (SELECT m.k, i, lo, (hi - lo) / {BINS} AS w, CASE WHEN h > l THEN greatest(0, least(h, lo + (i + 1) * ((hi - lo) / {BINS})) - greatest(l, lo + i * ((hi - lo) / {BINS}))) / (h - l) * v ELSE CASE WHEN i = least({BINS - 1}, CAST(floor((l - lo) / ((hi - lo) / {BINS})) AS INT)) THEN v ELSE 0 END END AS v
  FROM minutes m JOIN r USING (k), generate_series(0, {BINS - 1}) AS g(i)),
profile AS (SELECT k, CAST(i AS INT) AS bin, round(min(lo) + (i + 0.5) * min(w), 4) AS price, round(sum(v), 4) AS volume FROM b GROUP BY k, i)"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, bin, price, volume): each bar's volume over the price bins it spans, by overlap; a bar explodes into the bins it touches only."""
    bars = bars_minutes(spark, sf_dir)
    span = bars.groupBy("k").agg(F.min("l").alias("lo"), F.max("h").alias("hi")).where("hi > lo").withColumn("w", (F.col("hi") - F.col("lo")) / BINS)
    low = F.least(F.floor((F.col("l") - F.col("lo")) / F.col("w")).cast("int"), F.lit(BINS - 1))
    high = F.greatest(low, F.least(F.floor((F.col("h") - F.col("lo")) / F.col("w")).cast("int"), F.lit(BINS - 1)))
    rows = bars.join(span, "k").withColumn("bin", F.explode(F.sequence(low, high)))
    begin = F.col("lo") + F.col("bin") * F.col("w")
    overlap = F.greatest(F.lit(0.0), F.least("h", F.col("lo") + (F.col("bin") + 1) * F.col("w")) - F.greatest("l", begin))
    part = F.when(F.col("h") > F.col("l"), F.try_divide(overlap, F.col("h") - F.col("l")) * F.col("v")).otherwise(F.col("v").cast("double"))
    found = rows.withColumn("part", part).groupBy("k", "bin").agg(F.sum("part").alias("volume"))
    grid = span.select("k", "lo", "w", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    return grid.join(found, ["k", "bin"], "left").select("k", "bin", rounded(F.col("lo") + (F.col("bin") + 0.5) * F.col("w")).alias("price"), rounded(F.coalesce("volume", F.lit(0.0))).alias("volume"))


@query(f"WITH {PROFILE_SQL} SELECT k, bin, price, volume FROM profile")
def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, sf_dir)


def decimal_sum(values: str, places: int = 4) -> Column:
    """The sum of rounded values, added as whole units, so that no order of adding shifts it."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.round(x * 10**places).cast("long")) / 10.0**places


@query(f"""WITH RECURSIVE {PROFILE_SQL}, t AS (SELECT k, sum(volume) * 0.7 AS goal FROM profile GROUP BY k), s AS (SELECT k, list(volume ORDER BY bin) AS vs, arg_max(bin, {{'v': volume, 'b': -bin}}) AS poc FROM profile GROUP BY k),
e AS (SELECT k, vs, poc, goal, poc AS a, poc AS b, vs[poc + 1] AS held FROM s JOIN t USING (k)
  UNION ALL SELECT k, vs, poc, goal, CASE WHEN up THEN a ELSE a - 1 END, CASE WHEN up THEN b + 1 ELSE b END, held + CASE WHEN up THEN vs[b + 2] ELSE vs[a] END
  FROM (SELECT *, b < {BINS - 1} AND (a = 0 OR vs[b + 2] >= vs[a]) AS up FROM e WHERE held < goal AND (a > 0 OR b < {BINS - 1})))
SELECT k, poc, CAST(a AS INT) AS value_low, CAST(b AS INT) AS value_high FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b - a DESC) AS rn FROM e) WHERE rn = 1""")
def vwap_value_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest bin and the bins around it that hold 70 % of the volume, grown toward the fuller neighbour, upward on ties."""
    rows = profile(spark, sf_dir).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("bin", "volume"))).alias("bins"))
    rows = rows.select("k", F.transform("bins", lambda b: b["volume"]).alias("vs"))
    goal = decimal_sum("vs") * 0.7
    poc = (F.array_position("vs", F.array_max("vs")) - 1).cast("int")
    rows = rows.select("k", "vs", goal.alias("goal"), poc.alias("poc"))

    def grow(st, _):
        a, b, vs = st["a"], st["b"], F.col("vs")
        go = (st["held"] < F.col("goal")) & ((a > 0) | (b < BINS - 1))
        up = (b < BINS - 1) & ((a == 0) | (F.get(vs, b + 1) >= F.get(vs, a - 1)))
        more = F.when(up, F.get(vs, b + 1)).otherwise(F.get(vs, a - 1))
        return F.struct(F.when(go & ~up, a - 1).otherwise(a).alias("a"), F.when(go & up, b + 1).otherwise(b).alias("b"), F.when(go, st["held"] + more).otherwise(st["held"]).alias("held"))

    start = F.struct(F.col("poc").alias("a"), F.col("poc").alias("b"), F.get("vs", F.col("poc")).alias("held"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), start, grow)
    return rows.select("k", "poc", done["a"].alias("value_low"), done["b"].alias("value_high"))


@query(f"WITH {BARS_SQL} SELECT k, d, round(c, 4) AS c FROM bars QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) <= 90")
def retention_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(bars_daily(spark, sf_dir), 90).select("k", "d", rounded("c").alias("c"))


@query(f"WITH {BARS_SQL} SELECT k, array_to_string(list(round(c, 2) ORDER BY d), ',') AS closes FROM (SELECT * FROM bars WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) <= 90) GROUP BY k")
def momentum_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recent(bars_daily(spark, sf_dir).where("c > 0"), ["c"], 90)
    return rows.select("k", F.array_join(F.transform("rows", lambda r: rounded(r["c"], 2).cast("string")), ",").alias("closes"))
