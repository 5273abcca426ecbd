"""What must hold before a figure is used: windows without splits, comparable days, confirmed sessions, whole weeks, flags that are still right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import rounded
from tickforge.functions.passages import compatible
from tickforge.operators import ledger
from tickforge.operators.series import history, last_of
from tickforge.plans.registry import ORACLE_SQL, query
from tickforge.plans.technical import five_condition_screen
from tickforge.sources.tables import BARS_SQL, STOCKS_SQL, bars_daily, stocks, table

NULLED_SQL = "b AS (SELECT k, d, CASE WHEN n % 17 <> 0 THEN h END AS h, CASE WHEN n % 19 <> 0 THEN l END AS l, CASE WHEN (n + day(d)) % 11 <> 0 THEN c END AS c, CASE WHEN k % 3 = 0 OR n % 13 <> 0 THEN v END AS v FROM bars)"
SPLITS_SQL = "s AS (SELECT DISTINCT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.07)"


def window_holds(rows: str, splits: Column) -> Column:
    """The names of the windows at the end of an array of bars (d, h, l, c, v) that a split crosses: it falls behind the window's first and not behind its last day.

    Windows: true ranges (of the last 130 bars those whole, fifteen at least), volume of 20 and 21 bars and turnover of 20 (if every bar
    has it), highs and lows of 20 (those with one), the last two closes of 130 bars. A window of one bar is crossed by none.
    """
    recent, month, more = last_of(rows, 130), last_of(rows, 20), last_of(rows, 21)
    has = lambda field: lambda b: b[field].isNotNull()
    every = lambda xs, n, test: F.when((F.size(xs) == n) & F.forall(xs, test), xs)
    whole = F.filter(recent, lambda b: b["h"].isNotNull() & b["l"].isNotNull() & b["c"].isNotNull())
    either = F.filter(month, lambda b: b["h"].isNotNull() | b["l"].isNotNull())
    closes = F.filter(recent, has("c"))
    windows = {
        "atr130": F.when(F.size(whole) >= 15, whole), "volume20": every(month, 20, has("v")), "volume21": every(more, 21, has("v")), "turnover20": every(month, 20, lambda b: b["c"].isNotNull() & b["v"].isNotNull()),
        "range20": F.when(F.exists(either, has("h")) & F.exists(either, has("l")), either), "close2": F.slice(closes, F.greatest(F.size(closes) - 1, F.lit(1)), 2),
    }

    def crossed(xs: Column) -> Column:
        first, last = F.get(xs, F.lit(0))["d"], F.try_element_at(xs, F.lit(-1))["d"]
        return F.coalesce((F.size(xs) >= 2) & F.exists(splits, lambda s: (first < s) & (s <= last)), F.lit(False))

    return F.array_compact(F.array(*(F.when(crossed(xs), name) for name, xs in windows.items())))


_HELD = lambda name, xs: f"CASE WHEN len({xs}) >= 2 AND len(list_filter(ss, lambda x: x > {xs}[1].d AND x <= {xs}[-1].d)) > 0 THEN '{name}' END"


@query(f"""WITH {BARS_SQL}, {NULLED_SQL}, {SPLITS_SQL}, g AS (SELECT k, list({{'d': d, 'h': h, 'l': l, 'c': c, 'v': v}} ORDER BY d)[-130:] AS r FROM b GROUP BY k), z AS (SELECT g.k, r, r[-20:] AS m, r[-21:] AS m1, coalesce(ss, []) AS ss FROM g LEFT JOIN (SELECT k, list(d) AS ss FROM s GROUP BY k) x ON x.k = g.k),
w AS (SELECT *, list_filter(r, lambda x: x.h IS NOT NULL AND x.l IS NOT NULL AND x.c IS NOT NULL) AS a0, list_filter(m, lambda x: x.h IS NOT NULL OR x.l IS NOT NULL) AS rr, list_filter(r, lambda x: x.c IS NOT NULL)[-2:] AS cc FROM z),
y AS (SELECT *, CASE WHEN len(a0) >= 15 THEN a0 ELSE [] END AS a, CASE WHEN len(m) = 20 AND len(list_filter(m, lambda x: x.v IS NULL)) = 0 THEN m ELSE [] END AS v20, CASE WHEN len(m1) = 21 AND len(list_filter(m1, lambda x: x.v IS NULL)) = 0 THEN m1 ELSE [] END AS v21, CASE WHEN len(m) = 20 AND len(list_filter(m, lambda x: x.v IS NULL OR x.c IS NULL)) = 0 THEN m ELSE [] END AS t20,
  CASE WHEN len(list_filter(rr, lambda x: x.h IS NOT NULL)) > 0 AND len(list_filter(rr, lambda x: x.l IS NOT NULL)) > 0 THEN rr ELSE [] END AS r20 FROM w)
SELECT k, array_to_string(list_filter([{_HELD('atr130', 'a')}, {_HELD('volume20', 'v20')}, {_HELD('volume21', 'v21')}, {_HELD('turnover20', 't20')}, {_HELD('range20', 'r20')}, {_HELD('close2', 'cc')}], lambda x: x IS NOT NULL), ',') AS holds FROM y""")
def split_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of six windows at the end of a stock's bars a reported split crosses."""
    day = F.dayofmonth("d")
    n = F.col("n")
    bars = bars_daily(spark, sf_dir).select("k", "d", F.when(n % 17 != 0, F.col("h")).alias("h"), F.when(n % 19 != 0, F.col("l")).alias("l"), F.when((n + day) % 11 != 0, F.col("c")).alias("c"), F.when((F.col("k") % 3 == 0) | (n % 13 != 0), F.col("v")).alias("v"))
    splits = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount > 0.07").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(F.to_date("l_shipdate")).alias("splits"))
    rows = history(bars, ["h", "l", "c", "v"]).join(splits, "k", "left").withColumn("splits", F.coalesce("splits", F.array().cast("array<date>")))
    return rows.select("k", F.array_join(window_holds("rows", F.col("splits")), ",").alias("holds"))


@query(f"""WITH n AS ({ORACLE_SQL["five_condition_screen"]}), o AS (SELECT code, CASE WHEN CAST(code AS INT) % 3 = 0 THEN NOT volatile ELSE volatile END AS v, CASE WHEN CAST(code AS INT) % 5 = 0 THEN NULL ELSE passed_long END AS l, CASE WHEN CAST(code AS INT) % 7 = 0 THEN true ELSE passed_short END AS s FROM n WHERE CAST(code AS INT) % 11 <> 0)
SELECT code, volatile, passed_long, passed_short FROM n JOIN o USING (code) WHERE volatile IS DISTINCT FROM v OR passed_long IS DISTINCT FROM l OR passed_short IS DISTINCT FROM s""")
def stale_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved rows of which one of three flags, worked out anew, is another: the flags to be written. A row that is right is not written, one that was never saved neither."""
    flags = ["volatile", "passed_long", "passed_short"]
    now = five_condition_screen(spark, sf_dir).select("code", *flags)
    n = F.col("code").cast("int")
    saved = now.where(n % 11 != 0).select("code", F.when(n % 3 == 0, ~F.col("volatile")).otherwise(F.col("volatile")).alias("s0"), F.when(n % 5 != 0, F.col("passed_long")).alias("s1"), F.when(n % 7 == 0, True).otherwise(F.col("passed_short")).alias("s2"))
    right = F.lit(True)
    for i, flag in enumerate(flags):
        right = right & F.col(flag).eqNullSafe(F.col(f"s{i}"))
    return now.join(saved, "code").where(~right).select("code", *flags)


def comparable(day: Column, latest: Column, close: Column, mean: Column, known: Column) -> Column:
    """(price, reason): the adjusted close that may be set against a mean of the same day, or why none may."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0)
    reason = (
        F.when(~F.coalesce(known, F.lit(False)), "missing_indicator").when(day.isNull() | latest.isNull(), "missing_date").when(day != latest, "date_mismatch").when(close.isNull(), "missing_adjusted_close").when(bad(close), "invalid_adjusted_close").when(mean.isNull(), "missing_ma25").when(bad(mean), "invalid_ma25")
    )
    return F.struct(F.when(reason.isNull(), close).alias("price"), reason.alias("reason"))


@query(f"""WITH {BARS_SQL}, {STOCKS_SQL}, i AS (SELECT k, max(d) AS latest, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 1 THEN -1 ELSE arg_max(c, d) END AS close, CASE WHEN k % 8 = 3 THEN NULL WHEN k % 8 = 5 THEN 0 ELSE avg(c) END AS mean FROM bars WHERE k % 12 <> 0 GROUP BY k), f AS (SELECT k, CASE WHEN k % 7 = 2 THEN NULL WHEN k % 7 = 3 THEN max(d) - 1 ELSE max(d) END AS day FROM bars GROUP BY k)
SELECT k, CASE WHEN i.k IS NULL THEN 'missing_indicator' WHEN day IS NULL THEN 'missing_date' WHEN day <> latest THEN 'date_mismatch' WHEN close IS NULL THEN 'missing_adjusted_close' WHEN close <= 0 THEN 'invalid_adjusted_close' WHEN mean IS NULL THEN 'missing_ma25' WHEN mean <= 0 THEN 'invalid_ma25' END AS reason,
  round(CASE WHEN day = latest AND close > 0 AND mean > 0 THEN (close / mean - 1) * 100 END, 4) AS deviation FROM f LEFT JOIN i USING (k)""")
def mean_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a stock's adjusted close is from its mean, or why the two may not be compared."""
    bars, k = bars_daily(spark, sf_dir), F.col("k")
    last = F.max_by("c", "d")
    indicators = bars.where("k % 12 <> 0").groupBy("k").agg(F.max("d").alias("latest"), F.when(k % 9 == 0, None).when(k % 10 == 1, -1.0).otherwise(last).alias("close"), F.when(k % 8 == 3, None).when(k % 8 == 5, 0.0).otherwise(F.avg("c")).alias("mean")).withColumn("known", F.lit(True))
    days = bars.groupBy("k").agg(F.when(k % 7 == 2, None).when(k % 7 == 3, F.date_sub(F.max("d"), 1)).otherwise(F.max("d")).alias("day"))
    rows = days.join(indicators, "k", "left").withColumn("x", comparable(F.col("day"), F.col("latest"), F.col("close"), F.col("mean"), F.col("known")))
    return rows.select("k", F.col("x.reason").alias("reason"), rounded((F.col("x.price") / F.col("mean") - 1) * 100).alias("deviation"))


@query(f"""WITH {BARS_SQL}, q AS (SELECT k, arg_max(d, d) AS session, k % 3 = 0 AS ended FROM bars GROUP BY k), r AS (SELECT b.k, b.d, CASE WHEN n % 6 = 0 THEN NULL ELSE c END AS c, b.n % 7 <> 0 AS guarded, b.d = session AS now, ended FROM bars b JOIN q USING (k)),
a AS (SELECT k, max(d) FILTER (ended OR NOT now) AS d FROM r GROUP BY k), p AS (SELECT r.k, max(r.d) AS d FROM r JOIN a ON a.k = r.k AND r.d < a.d GROUP BY r.k)
SELECT a.k, a.d, CASE WHEN a.d IS NULL THEN 'no_candidate' WHEN x.c IS NULL THEN 'null' WHEN NOT x.guarded THEN 'removed' ELSE 'ok' END AS reason, round(CASE WHEN x.guarded THEN x.c END, 4) AS value, round(CASE WHEN x.guarded AND y.guarded AND x.c IS NOT NULL THEN y.c END, 4) AS prev FROM a LEFT JOIN r x ON x.k = a.k AND x.d = a.d LEFT JOIN p ON p.k = a.k LEFT JOIN r y ON y.k = p.k AND y.d = p.d""")
def confirmed_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close of the newest session that is over, and that of the one before it; both must be among the bars that a guard let through, and no older one takes the place of one that is not."""
    bars = bars_daily(spark, sf_dir).select("k", "d", F.when(F.col("n") % 6 != 0, F.col("c")).alias("c"), (F.col("n") % 7 != 0).alias("guarded"))
    session = bars.groupBy("k").agg(F.max("d").alias("session"))
    ended = F.col("k") % 3 == 0
    rows = bars.join(session, "k").where(ended | (F.col("d") < F.col("session")))
    found = rows.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("d")))).where("i <= 2")
    own = lambda i, what: F.max(F.when(F.col("i") == i, F.col(what)))
    found = found.groupBy("k").agg(own(1, "d").alias("d"), own(1, "c").alias("c"), own(1, "guarded").alias("ok"), own(2, "c").alias("pc"), own(2, "guarded").alias("pok"))
    rows = session.join(found, "k", "left")
    reason = F.when(F.col("d").isNull(), "no_candidate").when(F.col("c").isNull(), "null").when(~F.col("ok"), "removed").otherwise("ok")
    return rows.select("k", "d", reason.alias("reason"), rounded(F.when(F.col("ok"), F.col("c"))).alias("value"), rounded(F.when((reason == "ok") & F.col("pok"), F.col("pc"))).alias("prev"))


def week_range(label: Column) -> Column:
    """(first, last): Monday and Sunday of a week YYYY-Www; null for other forms and weeks that the year does not have."""
    year, n = F.regexp_extract(label, "^([0-9]{4})-W([0-9]{2})$", 1).try_cast("int"), F.regexp_extract(label, "^([0-9]{4})-W([0-9]{2})$", 2).try_cast("int")
    monday = F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (n - 1) * 7)
    # The week's Thursday lies in its year.
    real = n.between(1, 53) & (F.year(F.date_add(monday, 3)) == year)
    return F.when(real, F.struct(monday.alias("first"), F.date_add(monday, 6).alias("last")))


@query("""WITH l AS (SELECT p_partkey AS k, CASE WHEN p_size % 17 = 0 THEN '2024-W1' ELSE (1990 + p_partkey % 60) || '-W' || lpad(CAST(p_size % 55 AS VARCHAR), 2, '0') END AS label FROM part), d AS (SELECT DISTINCT CAST(x AS DATE) AS day, strftime(CAST(x AS DATE), '%G-W%V') AS label FROM generate_series(DATE '1989-12-01', DATE '2051-01-31', INTERVAL 1 DAY) AS t(x)),
w AS (SELECT label, min(day) AS first, max(day) AS last FROM d GROUP BY label) SELECT k, l.label, first, last FROM l LEFT JOIN w USING (label)""")
def week_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monday and Sunday of labelled weeks."""
    label = F.when(F.col("p_size") % 17 == 0, "2024-W1").otherwise(F.concat((1990 + F.col("p_partkey") % 60).cast("string"), F.lit("-W"), F.lpad((F.col("p_size") % 55).cast("string"), 2, "0")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), label.alias("label"))
    return rows.withColumn("w", week_range(F.col("label"))).select("k", "label", "w.first", "w.last")


@query(f"""WITH {BARS_SQL}, w AS (SELECT DISTINCT k, CAST(date_trunc('week', d) AS DATE) + 4 AS week FROM bars WHERE n % 3 <> 0 AND day(d) < 20), r AS (SELECT k, min(week) AS lo, greatest(max(week), DATE '2001-11-02') AS hi FROM w GROUP BY k), e AS (SELECT k, CAST(unnest(generate_series(lo + 7, hi - 7, INTERVAL 7 DAY)) AS DATE) AS week FROM r WHERE hi - 7 >= lo + 7)
SELECT k, week FROM e WHERE (k, week) NOT IN (SELECT (k, week) FROM w) AND week <> DATE '2001-11-02'""")
def missing_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fridays between a stock's first stored week and the current one that are not stored, also inside."""
    friday = F.date_add(F.trunc("d", "week"), 4)
    weeks = bars_daily(spark, sf_dir).where("n % 3 <> 0 and day(d) < 20").select("k", friday.alias("week")).distinct()
    current = F.lit("2001-11-02").cast("date")
    span = weeks.groupBy("k").agg(F.min("week").alias("lo"), F.greatest(F.max("week"), current).alias("hi")).where(F.date_sub("hi", 7) >= F.date_add("lo", 7))
    expected = span.select("k", F.explode(F.sequence(F.date_add("lo", 7), F.date_sub("hi", 7), F.expr("interval 7 days"))).alias("week")).where(F.col("week") != current)
    return expected.join(weeks, ["k", "week"], "left_anti")


#: Names of companies as written, and as one legal name.
NAMES = [("㈱テスト", "株式会社テスト"), ("テスト（株）", "テスト株式会社"), ("(株) ＡＢＣ　商事", "株式会社ABC商事"), ("ＡＢＣ Co., Ltd.", "ABCCo.,Ltd."), ("有限会社 ｱｲｳ", "有限会社アイウ")]


@query(f"""WITH {STOCKS_SQL} SELECT code, CAST(NULL AS VARCHAR) AS market, CASE WHEN k % 4 <> 0 THEN region END AS sector, ([{', '.join(f"'{p}'" for _, p in NAMES)}])[CAST(k % {len(NAMES)} AS INT) + 1] || code AS legal_name FROM stocks""")
def public_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks as they may be shown: no market, the sector of the filings without falling back on the exchange's, and exact legal names."""
    name = F.element_at(F.array(*(F.lit(w) for w, _ in NAMES)), (F.col("k") % len(NAMES) + 1).cast("int"))
    rows = stocks(spark, sf_dir).select("code", "k", "sector", F.when(F.col("k") % 4 != 0, F.col("region")).alias("filed"), F.concat(name, F.lit(" "), F.col("code")).alias("name"))
    return published(rows.withColumn("market", F.lit("prime")), exchange=False).select("code", "market", "sector", legal_name("name").alias("legal_name"))


def published(rows: DataFrame, exchange: bool) -> DataFrame:
    """rows with the market and sector that may be shown: the exchange's own only where that is allowed, else no market and the sector as filed."""
    return rows.drop("filed") if exchange else rows.withColumn("market", F.lit(None).cast("string")).withColumn("sector", F.col("filed")).drop("filed")


def legal_name(name: str) -> Column:
    """A name in compatibility form without blanks, the short form of a company limited by shares written out; nothing is moved or left out."""
    return F.replace(F.regexp_replace(compatible(name), r"[\s\x{3000}]", ""), F.lit("(株)"), F.lit("株式会社"))


@query(f"WITH {BARS_SQL}, o AS (SELECT k, CASE WHEN k % 6 <> 0 THEN max(d) END AS bar, k % 9 <> 0 AS fetched FROM bars GROUP BY k) SELECT count(*) FILTER (fetched AND bar IS NOT NULL) AS n, count(*) AS codes, max(bar) FILTER (fetched) AS newest, min(bar) FILTER (fetched) AS oldest FROM o")
def source_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fetched outcomes have a bar, and the newest of them; outcomes that were not fetched do not count."""
    o = bars_daily(spark, sf_dir).groupBy("k").agg(F.when(F.col("k") % 6 != 0, F.max("d")).alias("bar")).withColumn("fetched", F.col("k") % 9 != 0)
    bar = F.when(F.col("fetched"), F.col("bar"))
    return o.agg(F.count(bar).alias("n"), F.count(F.lit(1)).alias("codes"), F.max(bar).alias("newest"), F.min(bar).alias("oldest"))


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored and new documents by user: ids of two kinds of events, the first day, who wrote them; new ones lose or change something now and then."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", F.to_date("ts").alias("d"), "event_type")
    ids = lambda kind, where: F.sort_array(F.collect_list(F.when((F.col("event_type") == kind) & where, F.col("event_id"))))
    k, n = F.col("k"), F.col("event_id")
    old = e.where("k % 12 <> 1").groupBy("k").agg(ids("click", n % 2 == 0).alias("clicks"), ids("view", F.lit(True)).alias("views"), F.min("d").alias("first_date"), F.when(k % 10 == 3, "other").when(k % 10 != 4, "self").alias("writer"))
    new = e.groupBy("k").agg(ids("click", (k % 10 != 5) | (n % 4 != 0)).alias("clicks"), ids("view", (k % 10 != 6) | (n % 3 != 0)).alias("views"), F.min(F.when((k % 10 != 7), F.col("d")).otherwise(F.date_add("d", 1))).alias("first_date"), F.when(k % 10 == 2, "other").otherwise("self").alias("writer"))
    return old, new.withColumn("views", F.when(k % 10 != 8, F.col("views")))


@query("""WITH e AS (SELECT user_id AS k, event_id, CAST(ts AS DATE) AS d, event_type FROM events), o AS (SELECT k, coalesce(list(event_id) FILTER (event_type = 'click' AND event_id % 2 = 0), []) AS clicks, coalesce(list(event_id) FILTER (event_type = 'view'), []) AS views, min(d) AS f, CASE WHEN k % 10 = 3 THEN 'other' WHEN k % 10 <> 4 THEN 'self' END AS w FROM e WHERE k % 12 <> 1 GROUP BY k),
n AS (SELECT k, coalesce(list(event_id) FILTER (event_type = 'click' AND (k % 10 <> 5 OR event_id % 4 <> 0)), []) AS clicks, CASE WHEN k % 10 <> 8 THEN coalesce(list(event_id) FILTER (event_type = 'view' AND (k % 10 <> 6 OR event_id % 3 <> 0)), []) END AS views, min(d) + CASE WHEN k % 10 = 7 THEN 1 ELSE 0 END AS f, CASE WHEN k % 10 = 2 THEN 'other' ELSE 'self' END AS w FROM e GROUP BY k)
SELECT n.k, CASE WHEN n.w <> 'self' THEN 'writer' WHEN o.w <> 'self' THEN 'other_writer' WHEN o.k IS NOT NULL AND n.views IS NULL THEN 'vanished' WHEN len(n.clicks) < len(o.clicks) OR len(n.views) < len(o.views) THEN 'shrunk' WHEN NOT list_has_all(n.clicks, o.clicks) OR NOT list_has_all(n.views, o.views) THEN 'lost' WHEN n.f > o.f THEN 'first_date' END AS reason FROM n LEFT JOIN o USING (k)""")
def regression_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a document may not take the place of the stored one."""
    old, new = _documents(spark, sf_dir)
    return ledger.regressions(old, new, "k", ["clicks", "views"], "self")


@query("""SELECT user_id AS k, user_id % 6 NOT IN (1, 2, 3) AND count(*) FILTER (event_id % 50 = 0) = 0 AS skipped FROM events WHERE event_type = 'signup' GROUP BY user_id""")
def skipped_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are stored already, but for the time they were updated: the order of fields does not count, that of an array does, and so does a field that is missing."""
    k, n = F.col("k"), F.col("event_id")
    e = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("k"), "event_id")
    g = e.groupBy("k").agg(F.sort_array(F.collect_list("event_id")).alias("ids"), F.sort_array(F.collect_list(F.when(n % 50 == 0, n + 1).otherwise(n))).alias("now"))
    text = lambda x: x.cast("string")
    fresh = F.to_json(F.struct(text(k).alias("code"), F.lit("t2").alias("updated"), F.col("now").alias("ids"), F.struct(F.lit("a").alias("p")).alias("proof")))
    other_order = F.to_json(F.struct(F.struct(F.lit("a").alias("p")).alias("proof"), F.col("ids").alias("ids"), F.lit("t1").alias("updated"), text(k).alias("code")))
    stored = F.when(k % 6 == 1, F.lit(None)).when(k % 6 == 2, "no json").when(k % 6 == 3, F.to_json(F.struct(text(k).alias("code"), F.lit("t1").alias("updated"), F.col("ids").alias("ids")))).otherwise(other_order)
    return g.select("k", ledger.same_body(stored, fresh, "code string, ids array<bigint>, proof struct<p:string>", ["updated"]).alias("skipped"))


@query(f"""WITH {BARS_SQL}, w AS (SELECT k, CAST(date_trunc('week', d) AS DATE) AS week, arg_max(c, d) AS c FROM bars GROUP BY ALL), x AS (SELECT *, lag(c) OVER o AS p, lag(week) OVER o AS pw FROM w WINDOW o AS (PARTITION BY k ORDER BY week)), t AS (SELECT DISTINCT k FROM w)
SELECT t.k, CASE WHEN x.k IS NULL THEN 'no_bar_in_period' WHEN pw IS NULL THEN 'first' ELSE 'observed' END AS status, pw AS previous_week, round(c, 4) AS close, round(c - p, 4) AS change, round((c - p) / p * 100, 4) AS pct FROM t LEFT JOIN x ON x.k = t.k AND x.week = CASE WHEN t.k % 4 = 0 THEN DATE '1995-01-02' ELSE DATE '2000-03-06' END""")
def weekly_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close of one week against the week with a bar before it; no bar in the week, or none before, is said and not filled."""
    weeks = bars_daily(spark, sf_dir).groupBy("k", F.to_date(F.date_trunc("week", "d")).alias("week")).agg(F.max_by("c", "d").alias("c"))
    order = Window.partitionBy("k").orderBy("week")
    rows = weeks.withColumns({"p": F.lag("c").over(order), "pw": F.lag("week").over(order)})
    asked = weeks.select("k").distinct().withColumn("week", F.when(F.col("k") % 4 == 0, F.lit("1995-01-02")).otherwise(F.lit("2000-03-06")).cast("date"))
    found = asked.join(rows.withColumn("there", F.lit(True)), ["k", "week"], "left")
    status = F.when(F.col("there").isNull(), "no_bar_in_period").when(F.col("pw").isNull(), "first").otherwise("observed")
    return found.select("k", status.alias("status"), F.col("pw").alias("previous_week"), rounded("c").alias("close"), rounded(F.col("c") - F.col("p")).alias("change"), rounded((F.col("c") - F.col("p")) / F.col("p") * 100).alias("pct"))


@query(f"""WITH {BARS_SQL}, a AS (SELECT lpad(CAST(k AS VARCHAR), 4, '0') AS code, 'jsf_zandaka' AS data_type, max(d) AS data_date, round(arg_max(c, d), 4) AS loan_bal, CAST(NULL AS DOUBLE) AS fee, CAST(NULL AS VARCHAR) AS exchange FROM bars GROUP BY k), b AS (SELECT lpad(CAST(k AS VARCHAR), 4, '0') AS code, 'jsf_shina' AS data_type, max(d) AS data_date, NULL AS loan_bal, round(arg_max(v, d), 4) AS fee, CASE WHEN k % 2 = 0 THEN 'T' ELSE 'N' END AS exchange FROM bars WHERE k % 3 = 0 GROUP BY k),
c AS (SELECT lpad(CAST(k AS VARCHAR), 4, '0') AS code, 'jpx_margin' AS data_type, max(d) AS data_date, NULL AS loan_bal, NULL AS fee, NULL AS exchange FROM bars WHERE k % 4 = 0 GROUP BY k) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY code, data_type, coalesce(exchange, '') LIMIT 90""")
def supply_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest figures of three sources with columns of their own, put together by name: the first ninety by code, kind and exchange."""
    bars = bars_daily(spark, sf_dir)
    code = F.lpad(F.col("k").cast("string"), 4, "0").alias("code")
    newest = lambda rows, kind, *extra: rows.groupBy("k").agg(F.max("d").alias("data_date"), *extra).select(code, F.lit(kind).alias("data_type"), "*").drop("k")
    a = newest(bars, "jsf_zandaka", rounded(F.max_by("c", "d")).alias("loan_bal"))
    b = newest(bars.where("k % 3 = 0"), "jsf_shina", rounded(F.max_by("v", "d")).alias("fee"), F.when(F.col("k") % 2 == 0, "T").otherwise("N").alias("exchange"))
    c = newest(bars.where("k % 4 = 0"), "jpx_margin")
    rows = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return rows.orderBy("code", "data_type", F.coalesce("exchange", F.lit(""))).limit(90)
