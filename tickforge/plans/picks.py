"""One of several versions: annual series in the scope of the latest year, newest sections, filings' facts with their dates, strong signals, master batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions import japanese as jp
from tickforge.functions import passages as ps
from tickforge.functions.columns import rounded
from tickforge.operators import facts
from tickforge.plans.registry import query
from tickforge.plans.titles import _HIGH, TAGGED_SQL, _list, titles
from tickforge.sources.shared import fresh_path
from tickforge.sources.tables import STOCKS_SQL, stocks, table
from tickforge.sources.versions import Versions

SCOPES = ["連結", "単体", "不明"]
ROWS_SQL = "r AS (SELECT o_custkey AS k, CAST(last_day(o_orderdate) AS DATE) AS period_end, CASE (o_custkey + year(o_orderdate)) % 4 WHEN 0 THEN '単体' WHEN 1 THEN '不明' ELSE ['連結', '単体', '不明'][CAST(o_orderkey % 3 AS INT) + 1] END AS scope, sum(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END) AS revenue FROM orders GROUP BY ALL)"


def annual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, period_end, scope, revenue): a customer's figures by month and scope; not every scope is there at every end, nor every figure."""
    n = F.col("o_orderkey") % 3
    free = F.element_at(F.array(*map(F.lit, SCOPES)), (n + 1).cast("int"))
    turn = (F.col("o_custkey") + F.year("o_orderdate")) % 4
    scope = F.when(turn == 0, "単体").when(turn == 1, "不明").otherwise(free)
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.last_day("o_orderdate").alias("period_end"), scope.alias("scope"))
    return rows.agg(F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("revenue"))


@query(f"""WITH {ROWS_SQL}, a AS (SELECT *, list_position(['連結', '単体', '不明'], scope) AS p FROM r WHERE period_end <= DATE '2000-12-31'), l AS (SELECT k, max(period_end) AS last FROM a GROUP BY k), s AS (SELECT a.k, min(p) AS p FROM a JOIN l ON l.k = a.k AND l.last = a.period_end GROUP BY a.k)
SELECT a.k, a.period_end, a.scope, CAST(year(a.period_end) AS INT) AS fiscal_year, round(revenue, 2) AS revenue FROM a JOIN s ON s.k = a.k AND s.p = a.p""")
def annual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of one scope, the first of the latest end's by priority; ends behind a day are no actuals. Ends and scopes are never mixed or filled."""
    rows = facts.one_scope(annual_rows(spark, sf_dir), "k", "period_end", "scope", SCOPES, F.lit("2000-12-31").cast("date"))
    return rows.select("k", "period_end", "scope", F.year("period_end").alias("fiscal_year"), rounded("revenue", 2).alias("revenue"))


@query(f"""WITH {ROWS_SQL}, s AS (SELECT k, period_end, scope, lag(period_end) OVER o AS before, lag(scope) OVER o AS was FROM r WINDOW o AS (PARTITION BY k ORDER BY period_end, scope))
SELECT k, period_end, scope, before, coalesce(scope = was AND scope <> '不明' AND year(period_end) = year(before) + 1 AND (strftime(period_end, '%m-%d') = strftime(before, '%m-%d') OR (month(period_end) = month(before) AND day(period_end + 1) = 1 AND day(before + 1) = 1)), false) AS follows FROM s""")
def annual_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an end follows the one before it as a year does: the next year, the same day or both the end of the same month, in one known scope."""
    order = Window.partitionBy("k").orderBy("period_end", "scope")
    rows = annual_rows(spark, sf_dir).select("k", "period_end", "scope", F.lag("period_end").over(order).alias("before"), F.lag("scope").over(order).alias("was"))
    return rows.select("k", "period_end", "scope", "before", F.coalesce((F.col("scope") == F.col("was")) & (F.col("scope") != "不明") & next_annual_end(F.col("before"), F.col("period_end")), F.lit(False)).alias("follows"))


def next_annual_end(before: Column, end: Column) -> Column:
    """Whether a fiscal end is one year on: the same day, or in the same month the last day on both sides (leap years)."""
    same_month = F.month(before) == F.month(end)
    return (F.year(end) == F.year(before) + 1) & same_month & ((F.dayofmonth(before) == F.dayofmonth(end)) | ((before == F.last_day(before)) & (end == F.last_day(end))))


@query("""SELECT k, section, fy, doc_id, chars, text_md5 FROM (SELECT source AS k, lang AS section, 2000 + n_chars % 7 AS fy, doc_id, length(text) AS chars, md5(text) AS text_md5, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars % 7 DESC, doc_id % 1000 DESC, doc_id DESC) AS i FROM documents) WHERE i = 1""")
def latest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every section of a source the newest text: by year, then by submission. Texts are joined to the picks; none is shuffled to be compared."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("k"), F.col("lang").alias("section"), (2000 + F.col("n_chars") % 7).alias("fy"), "doc_id", (F.col("doc_id") % 1000).alias("submitted"))
    newest = docs.groupBy("k", "section").agg(F.max(F.struct("fy", "submitted", "doc_id")).alias("m")).select("k", "section", "m.fy", "m.doc_id")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return texts.join(newest, "doc_id").select("k", "section", "fy", "doc_id", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@query(f"""WITH {TAGGED_SQL}, {STOCKS_SQL}, d AS (SELECT tagged.k, title, primary_tag, DATE '2024-01-01' + CAST((p_partkey * 7) % 365 AS INT) AS published FROM tagged JOIN part ON p_partkey = tagged.k)
SELECT s.code, s.name, d.k AS id, d.title, d.primary_tag, d.published FROM d JOIN stocks s ON s.k = d.k % (SELECT count(*) FROM stocks) WHERE primary_tag IN ({_list(_HIGH)}) ORDER BY published DESC, id DESC LIMIT 30""")
def high_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty newest disclosures with a tag of high signal."""
    strong = [tag for tag, high, *_ in jp.TAGS if high]
    known = stocks(spark, sf_dir).select(F.col("k").alias("stock"), "code", "name")
    n = known.agg(F.count(F.lit(1)).alias("n"))
    rows = titles(spark, sf_dir).withColumn("primary_tag", jp.primary_tag(jp.title_tags(ps.compatible("title")))).where(F.col("primary_tag").isin(strong))
    rows = rows.crossJoin(F.broadcast(n)).withColumn("stock", F.col("k") % F.col("n")).withColumn("published", F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("k") * 7) % 365).cast("int")))
    return rows.join(known, "stock").select("code", "name", F.col("k").alias("id"), "title", "primary_tag", "published").orderBy(F.desc("published"), F.desc("id")).limit(30)


@query("""WITH f AS (SELECT o_custkey AS k, year(l_shipdate) AS fy, l_returnflag AS segment, l_quantity AS amount, CAST(o_orderdate AS DATE) AS submitted, l_orderkey AS doc, l_linenumber AS line, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT k, CAST(fy AS INT) AS fy, segment, arg_max(amount, {'a': submitted, 'b': doc, 'c': line, 'd': part}) AS amount, max(submitted) AS submitted, count(DISTINCT doc) AS filings FROM f GROUP BY k, fy, segment""")
def order_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's figures by year and segment as last filed, each fact joined to its filing for the day it was submitted."""
    filings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("submitted"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.year("l_shipdate").alias("fy"), F.col("l_returnflag").alias("segment"), F.col("l_quantity").alias("amount"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    rows = rows.join(filings, "doc")
    return rows.groupBy("k", "fy", "segment").agg(F.max_by("amount", F.struct("submitted", "doc", "line", "part")).alias("amount"), F.max("submitted").alias("submitted"), F.count_distinct("doc").alias("filings"))


@query("""WITH m AS (SELECT s_suppkey AS k, s_name AS name, 'prime' AS market, s_acctbal > 0 AS active FROM supplier), e AS (SELECT c_custkey AS k, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'delist' WHEN 1 THEN 'transfer' ELSE 'listing' END AS kind, c_mktsegment AS market FROM customer WHERE c_custkey % 5 = 0)
SELECT k, coalesce(m.name, e.name) AS name, CASE WHEN kind = 'transfer' OR m.k IS NULL THEN e.market ELSE m.market END AS market, CASE WHEN m.k IS NULL THEN true WHEN kind = 'delist' THEN false ELSE active END AS active, kind AS last_event FROM m FULL JOIN e USING (k) WHERE m.k IS NOT NULL OR kind = 'listing'""")
def overlay_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master after a batch of events, committed with the log of events as one version; a batch that breaks a rule commits neither."""
    master = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("prime").alias("market"), (F.col("s_acctbal") > 0).alias("active"), F.lit(None).cast("string").alias("last_event"))
    n = F.col("c_custkey")
    events = table(spark, sf_dir, "customer").where(n % 5 == 0).select(n.alias("k"), F.col("c_name").alias("new"), F.when(n % 3 == 0, "delist").when(n % 3 == 1, "transfer").otherwise("listing").alias("kind"), F.col("c_mktsegment").alias("to"))
    store = Versions(spark, fresh_path(spark))
    store.publish({"master": master})
    twice = facts.checked_once(events.union(events.limit(1)), "k")
    facts.overlay(store, "master", facts.checked_once(events, "k"))
    try:
        facts.overlay(store, "master", twice)
    except Exception as refused:
        if "k is there twice" not in str(refused):
            raise
    return store.read("master")
