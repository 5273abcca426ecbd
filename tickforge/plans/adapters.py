"""Published figures as long observations, and what runs keep of filings: complete matrices, latest periods, master overlays, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import ratio, rounded
from tickforge.operators import ledger, screens
from tickforge.plans.ledger import overseas_growth
from tickforge.plans.registry import ORACLE_SQL, query
from tickforge.sources.tables import FACTS_SQL, facts, table


@query(f"""WITH {FACTS_SQL}, y AS (SELECT k, fy, sum(CASE WHEN doc_id % 3 = 0 THEN -amount ELSE amount END) AS v FROM facts GROUP BY k, fy), g AS (SELECT k, arg_min(v, fy) AS a, arg_max(v, fy) AS z, count(*) AS n FROM y WHERE v > 0 GROUP BY k)
SELECT k, n, round(CASE WHEN n >= 2 THEN pow(z / a, 1.0 / (n - 1)) - 1 END, 6) AS cagr FROM g""")
def dividend_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth a year from the first to the last positive yearly amount; years are those that are positive, and two are needed."""
    amount = F.when(F.col("doc_id") % 3 == 0, -F.col("amount")).otherwise(F.col("amount"))
    years = facts(spark, sf_dir).groupBy("k", "fy").agg(F.sum(amount).alias("v")).where("v > 0")
    g = years.groupBy("k").agg(F.min_by("v", "fy").alias("a"), F.max_by("v", "fy").alias("z"), F.count(F.lit(1)).alias("n"))
    return g.select("k", "n", rounded(F.when(F.col("n") >= 2, F.pow(F.col("z") / F.col("a"), 1 / (F.col("n") - 1)) - 1), 6).alias("cagr"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'P') AS pending, bool_and(o_orderkey % 50 <> 0) AS finished, bool_and(o_orderkey % 30 <> 0) AS sealed, max(CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + 3 END) AS checked FROM orders GROUP BY 1),
t AS (SELECT DATE '1998-01-01' AS today)
SELECT coalesce(sum(len(pending)), 0) AS pending, coalesce(sum(len(list_filter(pending, lambda p: p[1:1] = '1'))), 0) AS urgent, count(*) FILTER (NOT finished OR (NOT sealed AND day < today)) AS queued,
  count(*) FILTER (finished AND sealed AND len(pending) > 0 AND (checked IS NULL OR checked < today)) AS due, count(*) FILTER (finished AND sealed AND len(pending) > 0 AND checked >= today) AS waiting FROM d, t""")
def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to do in a work list of days: open documents in all and by reason, days queued, days whose open documents are due or wait."""
    day = F.to_date("o_orderdate")
    days = (
        table(spark, sf_dir, "orders")
        .groupBy(day.alias("day"))
        .agg(
            F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("pending"), F.every(F.col("o_orderkey") % 50 != 0).alias("finished"),
            F.every(F.col("o_orderkey") % 30 != 0).alias("sealed"), F.max(F.when(F.col("o_orderkey") % 4 == 0, F.date_add(day, 3))).alias("checked"),
        )
    )
    today = F.lit("1998-01-01").cast("date")
    settled = F.col("finished") & F.col("sealed") & (F.size("pending") > 0)
    late = F.coalesce(F.col("checked") < today, F.lit(True))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return days.agg(
        total(F.size("pending")).alias("pending"), total(F.size(F.filter("pending", lambda p: F.startswith(p, F.lit("1"))))).alias("urgent"), F.count_if(~F.col("finished") | (~F.col("sealed") & (F.col("day") < today))).alias("queued"),
        F.count_if(settled & late).alias("due"), F.count_if(settled & ~late).alias("waiting"),
    )


def overseas_screen(spark: SparkSession, sf_dir: str, least_years: int = 2, share: tuple[float | None, float | None] = (0.2, 4.0), region: str = "europe", least_region: float | None = 10.0, least_overseas: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Keys with enough years and an overseas share in a range, where a region takes so many per cent of overseas sales or more: a page by share, and the total before it."""
    pct = rounded(F.when(F.col("overseas") > 0, F.col(region) / F.col("overseas") * 100), 1)
    rows = overseas_growth(spark, sf_dir).withColumn("region_pct", pct)
    wanted = [F.col("years") >= least_years, screens.within("share", *share), screens.within("region_pct", least=least_region), screens.within("overseas", least=least_overseas)]
    return screens.paged(rows.where(screens.all_of(wanted)).select("k", "years", "share", "region_pct"), [F.desc("share"), F.asc("k")], limit, offset)


@query(f"""WITH g AS ({ORACLE_SQL["overseas_growth"]}), f AS (SELECT k, years, share, round(CASE WHEN overseas > 0 THEN europe / overseas * 100 END, 1) AS region_pct FROM g WHERE years >= 2 AND share BETWEEN 0.2 AND 4),
s AS (SELECT *, count(*) OVER () AS total FROM f WHERE region_pct >= 10) SELECT * FROM s ORDER BY share DESC, k LIMIT 50 OFFSET 3""", name="overseas_screen")
def overseas_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overseas_screen(spark, sf_dir, limit=50, offset=3)


@query("""WITH m AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code, s_name AS name, 'prime' AS market, s_acctbal > 0 AS active FROM supplier), e AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS code, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'delist' WHEN 1 THEN 'transfer' ELSE 'listing' END AS kind, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS market FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(m.code, e.code) AS code, coalesce(m.name, CASE WHEN kind = 'listing' THEN e.name END) AS name, CASE WHEN m.code IS NOT NULL AND kind = 'transfer' THEN coalesce(e.market, m.market) WHEN m.code IS NULL AND kind = 'listing' THEN e.market ELSE m.market END AS market,
  CASE WHEN m.code IS NULL THEN kind = 'listing' AND e.market IS NOT NULL WHEN kind = 'delist' THEN false ELSE m.active END AS active,
  CASE WHEN kind IS NULL THEN 'kept' WHEN m.code IS NULL THEN CASE WHEN kind <> 'listing' THEN 'unknown' WHEN e.market IS NULL THEN 'held' ELSE 'listed' END WHEN kind = 'listing' THEN 'known' WHEN kind = 'delist' THEN CASE WHEN m.active THEN 'delisted' ELSE 'gone' END WHEN e.market IS NULL THEN 'held' WHEN e.market = m.market THEN 'kept' ELSE 'moved' END AS outcome FROM m FULL JOIN e USING (code)""")
def overlay_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delistings, transfers and listings laid over the master in one full outer join; what lacks a market is held, what the master lacks is unknown."""
    code = lambda key: F.lpad(F.col(key).cast("string"), 5, "0").alias("code")
    master = table(spark, sf_dir, "supplier").select(code("s_suppkey"), F.col("s_name").alias("name"), F.lit("prime").alias("market"), (F.col("s_acctbal") > 0).alias("active"), F.lit(True).alias("known"))
    n = F.col("c_custkey")
    events = table(spark, sf_dir, "customer").where(n % 3 == 0).select(code("c_custkey"), F.col("c_name").alias("new"), F.when(n % 4 == 0, "delist").when(n % 4 == 1, "transfer").otherwise("listing").alias("kind"), F.when(n % 5 != 0, F.col("c_mktsegment")).alias("to"))
    kind, known, to = F.col("kind"), F.col("known").isNotNull(), F.col("to")
    missing = F.when(kind != "listing", "unknown").when(to.isNull(), "held").otherwise("listed")
    moved = F.when(to.isNull(), "held").when(to == F.col("market"), "kept").otherwise("moved")
    outcome = F.when(kind.isNull(), "kept").when(~known, missing).when(kind == "listing", "known").when(kind == "delist", F.when(F.col("active"), "delisted").otherwise("gone")).otherwise(moved)
    market = F.when(known & (kind == "transfer"), F.coalesce("to", "market")).when(~known & (kind == "listing"), to).otherwise(F.col("market"))
    active = F.when(~known, (kind == "listing") & to.isNotNull()).when(kind == "delist", False).otherwise(F.col("active"))
    return master.join(events, "code", "full").select("code", F.coalesce("name", F.when(kind == "listing", F.col("new"))).alias("name"), market.alias("market"), active.alias("active"), outcome.alias("outcome"))


@query("""WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), w AS (SELECT n_name AS country, date_trunc('quarter', l_shipdate) AS q, sum(CASE WHEN l_tax > 0.02 THEN l_extendedprice END) AS claims, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS ultimate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN n ON s_nationkey = n_nationkey WHERE r_name <> 'MIDDLE EAST' GROUP BY ALL),
l AS (SELECT DISTINCT date_trunc('quarter', l_shipdate) AS q FROM lineitem ORDER BY q DESC LIMIT 2)
SELECT country, CAST(q AS DATE) AS quarter, indicator, round(value, 2) AS value FROM (SELECT country, q, unnest(['claims', 'ultimate']) AS indicator, unnest([claims, ultimate]) * 1e6 AS value FROM w WHERE q IN (SELECT q FROM l)) WHERE value IS NOT NULL""")
def bank_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by country in the two latest quarters that any row has, in units; what stands for a group of countries is left out, empty figures too."""
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.to_date(F.date_trunc("quarter", "l_shipdate")))
    latest = rows.select("q").where("q is not null").distinct().orderBy(F.desc("q")).limit(2)
    country = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'MIDDLE EAST'").select("n_nationkey", F.col("n_name").alias("country"))
    banks = table(spark, sf_dir, "supplier").join(F.broadcast(country), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "country")
    leg = lambda when: F.sum(F.when(when, F.col("l_extendedprice")))
    wide = rows.join(F.broadcast(latest), "q", "left_semi").join(banks, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("country", F.col("q").alias("quarter")).agg(leg(F.col("l_tax") > 0.02).alias("claims"), leg(F.col("l_returnflag") == "R").alias("ultimate"))
    return wide.unpivot(["country", "quarter"], ["claims", "ultimate"], "indicator", "value").where("value is not null").withColumn("value", rounded(F.col("value") * 1e6, 2))


PRODUCTS, INVESTORS = ["click", "error", "purchase", "signup", "view"], list(range(6))


@query(f"""WITH e AS (SELECT date_trunc('week', CAST(ts AS DATE)) AS week, event_type AS product, user_id % 7 AS investor, value FROM events), c AS (SELECT week, product, investor, sum(value) FILTER (value >= 50) AS bought, sum(value) FILTER (value < 50) AS sold, count(*) AS n FROM e GROUP BY ALL),
x AS (SELECT week, product, investor FROM (SELECT DISTINCT week FROM e), (SELECT unnest({PRODUCTS}) AS product), (SELECT unnest({INVESTORS}) AS investor)), w AS (SELECT week, count(*) FILTER (c.n IS NULL) AS missing FROM x LEFT JOIN c USING (week, product, investor) GROUP BY week),
u AS (SELECT week, count(*) AS unknown FROM c WHERE investor NOT IN (SELECT unnest({INVESTORS})) OR product NOT IN (SELECT unnest({PRODUCTS})) GROUP BY week)
SELECT CAST(w.week AS DATE) AS week, missing, coalesce(unknown, 0) AS unknown, missing = 0 AND unknown IS NULL AS complete FROM w LEFT JOIN u ON u.week = w.week""")
def weekly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a week has every product of every investor class, and nothing else: cells that miss and cells no list knows, in one pass over the cells there are."""
    cells = table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), F.col("event_type").alias("product"), (F.col("user_id") % 7).alias("investor")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.col("product").isin(PRODUCTS) & F.col("investor").isin(INVESTORS)
    g = cells.groupBy("week").agg((F.lit(len(PRODUCTS) * len(INVESTORS)) - F.count_if(listed)).alias("missing"), F.count_if(~listed).alias("unknown"))
    return g.select("week", "missing", "unknown", ((F.col("missing") == 0) & (F.col("unknown") == 0)).alias("complete"))


@query("""WITH w AS (SELECT p_brand AS sector, strftime(l_shipdate, '%Y-%m') AS month, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS sell, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS buy FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), m AS (SELECT month, count(*) AS sectors FROM w GROUP BY month),
u AS (SELECT sector, month, unnest(['sell', 'buy', 'ratio']) AS indicator, unnest([sell, buy, CASE WHEN coalesce(sell, 0) + coalesce(buy, 0) > 0 THEN coalesce(sell, 0) / (coalesce(sell, 0) + coalesce(buy, 0)) END]) AS value FROM w)
SELECT sector, month, indicator, round(value, 6) AS value, round(value - lag(value) OVER (PARTITION BY sector, indicator ORDER BY month), 6) AS change, sectors = (SELECT count(DISTINCT p_brand) FROM part) AS complete FROM u JOIN m USING (month) WHERE value IS NOT NULL""")
def sector_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin balances by sector and month and the sold share, as observations with their change, and whether the month has all sectors."""
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sector"))
    leg = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    wide = table(spark, sf_dir, "lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey")).groupBy("sector", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(leg("A").alias("s"), leg("R").alias("b"))
    sold, bought = F.coalesce("s", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    rows = ledger.observations(wide.withColumn("r", F.when(sold + bought > 0, sold / (sold + bought))), ["sector"], {"sell": ("s", 1.0), "buy": ("b", 1.0), "ratio": ("r", 1.0)}, "month")
    every = brands.agg(F.countDistinct("sector").alias("every"))
    months = wide.groupBy("month").agg(F.count(F.lit(1)).alias("sectors")).crossJoin(F.broadcast(every)).select("month", (F.col("sectors") == F.col("every")).alias("complete"))
    return rows.join(months, "month").select("sector", "month", "indicator", rounded("value", 6).alias("value"), rounded("change", 6).alias("change"), "complete")


@query("""WITH w AS (SELECT l_returnflag AS product, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN l_discount < 0.05 THEN 'long' ELSE 'short' END AS side, l_suppkey AS member, sum(l_quantity) AS v FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY product, month, side ORDER BY v DESC, member) AS rank FROM w)
SELECT product || '|' || month || '|' || side || '|' || lpad(CAST(rank AS VARCHAR), 2, '0') AS key, member, round(v, 2) AS contracts, round(v / sum(v) OVER (PARTITION BY product, month, side), 6) AS share FROM r WHERE rank <= 10""")
def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest members of a product, month and side by contracts, with their share among the ten; their key is one text."""
    side = F.when(F.col("l_discount") < 0.05, "long").otherwise("short")
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate >= date '1996-01-01'").groupBy(F.col("l_returnflag").alias("product"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), side.alias("side"), F.col("l_suppkey").alias("member")).agg(F.sum("l_quantity").alias("v"))
    group = Window.partitionBy("product", "month", "side")
    top = rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("v"), "member"))).where("rank <= 10")
    key: Column = F.concat_ws("|", "product", "month", "side", F.lpad(F.col("rank").cast("string"), 2, "0"))
    return top.select(key.alias("key"), "member", rounded("v", 2).alias("contracts"), rounded(ratio("v", F.sum("v").over(group)), 6).alias("share"))


@query("""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS file, o_orderpriority AS pair, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT strftime(max(o_orderdate) - INTERVAL 23 MONTH, '%Y-%m') AS first FROM orders)
SELECT file, pair, month, indicator, round(value, 2) AS value FROM (SELECT file, pair, month, unnest(CASE file WHEN 'F' THEN ['volume', 'trades'] WHEN 'O' THEN ['margin'] ELSE ['losscut'] END) AS indicator, unnest(CASE file WHEN 'F' THEN [v * 1e6, CAST(n AS DOUBLE)] WHEN 'O' THEN [v * 1e6] ELSE [CAST(n AS DOUBLE)] END) AS value FROM r, t WHERE month >= first)""")
def otc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files of a market, each with its own figures, as one list of observations over the last 24 months."""
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.date_format(F.add_months(F.max("o_orderdate"), -23), "yyyy-MM").alias("first"))
    rows = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("file"), F.col("o_orderpriority").alias("pair")).agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    rows = rows.crossJoin(F.broadcast(first)).where("month >= first")
    cell = lambda name, value: F.struct(F.lit(name).alias("indicator"), value.alias("value"))
    value = F.col("v") * 1e6
    cells = F.when(F.col("file") == "F", F.array(cell("volume", value), cell("trades", F.col("n")))).when(F.col("file") == "O", F.array(cell("margin", value))).otherwise(F.array(cell("losscut", F.col("n"))))
    return rows.select("file", "pair", "month", F.inline(cells)).withColumn("value", rounded("value", 2))
