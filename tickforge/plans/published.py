"""Published tables as observations: one row for each period, category and indicator, with the days it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions import japanese as jp
from tickforge.functions.columns import rounded
from tickforge.plans.registry import query
from tickforge.sources.tables import table

#: Fixed value: yen in a hundred million.
OKU = 100_000_000


def drafts(wide: DataFrame, category: str, period: str, first: Column, last: Column, flows: dict[str, str], stocks: dict[str, str], factor: float = 1.0) -> DataFrame:
    """(period, period_start, period_end, indicator, category, value) of a table with a column for each figure; nulls are no observation.

    flows: indicators over the whole period, by column; stocks: those as of its last day, which is their first too.
    """
    names = flows | stocks
    rows = wide.select(F.col(period).alias("period"), F.col(category).alias("category"), first.alias("_first"), last.alias("period_end"), *((F.col(c) * factor).alias(n) for n, c in names.items()))
    long = rows.unpivot(["period", "category", "_first", "period_end"], list(names), "indicator", "value").where("value is not null")
    start = F.when(F.col("indicator").isin(list(stocks)), F.col("period_end")).otherwise(F.col("_first"))
    return long.select("period", start.alias("period_start"), "period_end", "indicator", "category", "value")


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))


@query("""WITH q AS (SELECT n_name AS sector, r_name AS region, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS s, sum(CAST(l_quantity AS BIGINT)) AS flow FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
g AS (SELECT sector, period, s, flow, sum(flow) OVER (PARTITION BY sector ORDER BY s) AS stock FROM (SELECT sector, period, s, flow FROM q UNION ALL SELECT region, period, s, sum(flow) FROM q GROUP BY ALL)), r AS (SELECT DISTINCT r_name FROM region)
SELECT period, CASE i WHEN 'flow' THEN s ELSE CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS period_start, CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, i AS indicator, sector AS category, CAST(v AS DOUBLE) * 100000000 AS value, i = 'stock' AS approximate
FROM (SELECT period, s, sector, unnest(['flow', 'stock']) AS i, unnest([flow, stock]) AS v FROM g) WHERE sector NOT IN (SELECT r_name FROM r)""")
def flow_of_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in a quarter and stocks at its end by sector, in yen; rows of aggregates (here the regions) are left out."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = table(spark, sf_dir, "supplier").join(F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("sector"), F.col("r_name").alias("region"))
    start = F.to_date(F.trunc("l_shipdate", "quarter")).alias("s")
    q = table(spark, sf_dir, "lineitem").join(names, "l_suppkey").groupBy("sector", "region", start).agg(F.sum(F.col("l_quantity").cast("long")).alias("flow"))
    published = q.select("sector", "s", "flow").union(q.groupBy("region", "s").agg(F.sum("flow").alias("flow")).select("region", "s", "flow"))
    own = published.join(F.broadcast(region.select(F.col("r_name").alias("sector"))), "sector", "left_anti")
    running = Window.partitionBy("sector").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    wide = own.withColumns({"stock": F.sum("flow").over(running), "period": F.concat(F.year("s").cast("string"), F.lit("-Q"), F.quarter("s").cast("string"))})
    rows = drafts(wide, "sector", "period", F.col("s"), F.last_day(F.add_months("s", 2)), {"flow": "flow"}, {"stock": "stock"}, float(OKU))
    return rows.withColumn("approximate", F.col("indicator") == "stock")


@query("""WITH b AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, l_returnflag || l_linestatus AS type, sum(CAST(l_quantity AS BIGINT)) AS issued, sum(CAST(l_linenumber AS BIGINT)) AS redeemed FROM lineitem GROUP BY ALL), t AS (SELECT period, sum(issued) + CASE WHEN period[6:7] = '07' THEN 1 ELSE 0 END AS issued, sum(redeemed) AS redeemed FROM b GROUP BY period),
ok AS (SELECT b.period FROM b JOIN t USING (period) GROUP BY b.period HAVING sum(b.issued) = max(t.issued) AND sum(b.redeemed) = max(t.redeemed)), a AS (SELECT *, type AS category FROM b UNION ALL SELECT period, 'total', issued, redeemed, 'total' FROM t)
SELECT period, CAST(period || '-01' AS DATE) AS period_start, last_day(CAST(period || '-01' AS DATE)) AS period_end, i AS indicator, category, CAST(v AS DOUBLE) AS value FROM (SELECT period, category, unnest(['issuance', 'redemption']) AS i, unnest([issued, redeemed]) AS v FROM a) WHERE period IN (SELECT period FROM ok)""")
def bond_issuance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues and redemptions by month and type of bond; a month whose types do not add up to the published total (here every July) is refused."""
    b = _months(spark, sf_dir).groupBy(F.col("month").alias("period"), F.concat("l_returnflag", "l_linestatus").alias("category")).agg(F.sum(F.col("l_quantity").cast("long")).alias("issued"), F.sum(F.col("l_linenumber").cast("long")).alias("redeemed"))
    sums = b.groupBy("period").agg(F.sum("issued").alias("i"), F.sum("redeemed").alias("r"))
    total = sums.select("period", F.lit("total").alias("category"), (F.col("i") + F.when(F.substring("period", 6, 2) == "07", 1).otherwise(0)).alias("issued"), F.col("r").alias("redeemed"))
    whole = sums.join(total, "period").where("i = issued and r = redeemed").select("period")
    day = F.to_date(F.concat("period", F.lit("-01")))
    return drafts(b.unionByName(total).join(whole, "period"), "category", "period", day, F.last_day(day), {"issuance": "issued", "redemption": "redeemed"}, {})


@query("""WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS spot, sum(CASE WHEN l_returnflag = 'R' AND day(l_shipdate) > 15 THEN l_quantity END) AS margin, count(DISTINCT l_suppkey) AS accounts FROM lineitem GROUP BY 1), w AS (SELECT period, spot, CASE WHEN period[6:7] = '05' THEN NULL ELSE margin END AS margin, accounts FROM m)
SELECT period, CASE i WHEN 'accounts' THEN last_day(CAST(period || '-01' AS DATE)) ELSE CAST(period || '-01' AS DATE) END AS period_start, last_day(CAST(period || '-01' AS DATE)) AS period_end, i AS indicator, 'all' AS category, CAST(v AS DOUBLE) AS value FROM (SELECT period, unnest(['spot', 'margin', 'accounts']) AS i, unnest([spot, margin, accounts]) AS v FROM w WHERE spot IS NOT NULL AND margin IS NOT NULL)""")
def crypto_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's row as one observation for each metric; a month that lacks one is refused whole."""
    flag = F.col("l_returnflag")
    wide = _months(spark, sf_dir).groupBy(F.col("month").alias("period")).agg(F.sum(F.when(flag == "A", F.col("l_quantity"))).alias("spot"), F.sum(F.when((flag == "R") & (F.dayofmonth("l_shipdate") > 15), F.col("l_quantity"))).alias("margin"), F.count_distinct("l_suppkey").alias("accounts"))
    wide = wide.withColumn("margin", F.when(F.substring("period", 6, 2) != "05", F.col("margin"))).where("spot is not null and margin is not null").withColumn("all", F.lit("all"))
    day = F.to_date(F.concat("period", F.lit("-01")))
    return drafts(wide, "all", "period", day, F.last_day(day), {"spot": "spot", "margin": "margin"}, {"accounts": "accounts"})


_FX_SQL = lambda period, first, last, month: f"""SELECT '{month}' AS "table", {period} AS period, l_returnflag AS category, CAST({first} AS DATE) AS s, CAST({last} AS DATE) AS e, sum(CASE WHEN l_discount > 0.02 THEN l_quantity END) AS turnover, arg_max(l_quantity, {{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey}}) FILTER (l_returnflag <> 'N') AS interest FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY ALL"""


@query(f"""WITH w AS ({_FX_SQL("strftime(l_shipdate, '%Y-%m')", "date_trunc('month', l_shipdate)", "last_day(l_shipdate)", "monthly")} UNION ALL {_FX_SQL("CAST(year(l_shipdate) AS VARCHAR)", "date_trunc('year', l_shipdate)", "date_trunc('year', l_shipdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY", "annual")})
SELECT "table", period, CASE i WHEN 'turnover' THEN s ELSE e END AS period_start, e AS period_end, i AS indicator, category, round(v, 2) AS value FROM (SELECT "table", period, category, s, e, unnest(['turnover', 'open_interest']) AS i, unnest([turnover, interest]) AS v FROM w) WHERE v IS NOT NULL""")
def fx_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly and annual turnover and open interest by instrument, in a window of years; a blank cell is no observation."""
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '2000-01-01'")
    newest = F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    cells = lambda *keys: rows.groupBy(*keys, F.col("l_returnflag").alias("category")).agg(F.sum(F.when(F.col("l_discount") > 0.02, F.col("l_quantity"))).alias("turnover"), newest.alias("interest")).withColumn("interest", F.when(F.col("category") != "N", F.col("interest")))
    monthly = cells(F.date_format("l_shipdate", "yyyy-MM").alias("period"))
    annual = cells(F.year("l_shipdate").cast("string").alias("period"))
    month, year = F.to_date(F.concat("period", F.lit("-01"))), F.to_date(F.concat("period", F.lit("-01-01")))
    legs = ({"turnover": "turnover"}, {"open_interest": "interest"})
    both = drafts(monthly, "category", "period", month, F.last_day(month), *legs).withColumn("table", F.lit("monthly")).unionByName(drafts(annual, "category", "period", year, F.date_sub(F.add_months(year, 12), 1), *legs).withColumn("table", F.lit("annual")))
    return both.withColumn("value", rounded("value", 2))


STATUSES = ["ok_geo_rows", "ok_geo_cols", "no_table", "parse_error"]


@query(f"""SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS fy, unit, raw, CAST(floor(raw * CASE unit WHEN '円' THEN 1 WHEN '千円' THEN 1000 WHEN '百万円' THEN 1000000 ELSE 100000000 END + 0.5) AS DOUBLE) AS yen, CASE o_orderkey % 4 WHEN 0 THEN 'geo_rows' WHEN 1 THEN 'geo_cols' ELSE 'none' END AS pattern
FROM (SELECT *, (['円', '千円', '百万円', '億円'])[CAST(o_custkey % 4 AS INT) + 1] AS unit, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 16 END AS raw FROM orders)""")
def overseas_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of sales abroad as they are saved: the figure as filed, in yen (a half rounds up), and the pattern that a known status stands for."""
    unit = F.element_at(F.array(*map(F.lit, ("円", "千円", "百万円", "億円"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("fy"), unit.alias("unit"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 16).alias("raw"), status.alias("status"))
    pattern = F.when(F.col("status") == "ok_geo_rows", "geo_rows").when(F.col("status") == "ok_geo_cols", "geo_cols").when(F.col("status").isin(STATUSES), "none").otherwise(F.raise_error(F.concat(F.lit("unknown status "), "status")))
    return rows.select("k", "fy", "unit", "raw", F.floor(F.col("raw") * jp.unit_factor(F.col("unit")) + 0.5).cast("double").alias("yen"), pattern.alias("pattern"))
