"""State that outlives a run: an index that is searched, versions that are swapped, tails that wait, and what stored ranges cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.columns import rounded
from tickforge.operators import coverage
from tickforge.operators.search import TextIndex
from tickforge.plans.registry import query
from tickforge.sources.shared import fresh_path, written
from tickforge.sources.tables import BARS_SQL, STOCKS_SQL, bars_daily, stocks, table
from tickforge.sources.versions import Versions
from tickforge.streaming import deferred

PAGE = 20


@query(f"""WITH s AS (SELECT item_id AS q, lower(text[4:16]) AS low FROM benchmark UNION ALL SELECT item_id + 1000000, lower(split_part(text, ' ', 2)) FROM benchmark UNION ALL SELECT item_id + 2000000, lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)) FROM benchmark)
SELECT q, doc_id, CAST(n AS BIGINT) AS hits FROM (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY q) AS n FROM s JOIN documents ON low <> '' AND contains(lower(text), low)) WHERE i <= {PAGE}""")
def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty documents that hold a string, and how many do: of each benchmark item a piece, its second word, and its first three words."""
    word = lambda i: F.coalesce(F.get(F.split("text", " "), F.lit(i)), F.lit(""))
    kinds = F.array(F.substring("text", 4, 13), word(1), F.concat(word(0), F.lit(" "), word(1), F.lit(" "), word(2)))
    strings = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(kinds).alias("i", "string")).select((F.col("item_id") + F.col("i") * 1_000_000).alias("q"), "string")
    index = TextIndex(spark, fresh_path(spark)).build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    hits = written(index.found(strings))[0]
    return _first(hits, PAGE)


def _first(hits: DataFrame, most: int) -> DataFrame:
    """The `most` smallest ids of each string and its number of hits; ids are cut range by range first."""
    part = F.floor(F.col("id") / 100_000)
    own = hits.groupBy("q", part.alias("part")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, most).alias("ids"), F.count(F.lit(1)).alias("n"))
    all_ = own.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"), F.sum("n").alias("hits"))
    return all_.select("q", F.explode("ids").alias("doc_id"), "hits")


MOVED_SQL = f"""{BARS_SQL}, {STOCKS_SQL}, r1 AS (SELECT k, max(d) AS as_of, count(*) AS bars, sum(c) AS total FROM bars WHERE d < DATE '2000-01-01' AND k % 5 <> 0 GROUP BY k),
r2 AS (SELECT k, max(d) AS as_of, count(*) AS bars, sum(c) AS total FROM bars JOIN stocks USING (k) WHERE is_active AND k % 7 <> 0 GROUP BY k)"""


def _projected(spark: SparkSession, sf_dir: str) -> tuple[Versions, DataFrame, dict]:
    """Two runs of a projection: the first before 2000 without every fifth stock, the second of active stocks without every seventh."""
    bars = bars_daily(spark, sf_dir)
    made = lambda rows, run: rows.groupBy("k").agg(F.max("d").alias("as_of"), F.count(F.lit(1)).alias("bars"), F.sum("c").alias("total")).withColumns({"computed_at": F.lit(run).cast("long"), "source_max_date": F.lit(None).cast("date")})
    store, newest = Versions(spark, fresh_path(spark)), F.lit(bars.agg(F.max("d")).first()[0]).cast("date")
    store.refresh("momentum", made(bars.where("d < '2000-01-01' and k % 5 <> 0"), 100), "k", "computed_at", F.lit(100), ("source_max_date", newest))
    before = store.read("momentum")
    done = store.refresh("momentum", made(bars.join(stocks(spark, sf_dir).where("is_active and k % 7 <> 0").select("k"), "k"), 200), "k", "computed_at", F.lit(200), ("source_max_date", newest))
    store.refresh("momentum", made(bars, 50), "k", "computed_at", F.lit(300))  # a run without fresh rows changes nothing
    return store, before, done


@query(f"WITH {MOVED_SQL} SELECT k, as_of, bars, round(total, 4) AS total, CAST(200 AS BIGINT) AS computed_at, (SELECT max(d) FROM bars) AS source_max_date, (SELECT count(*) FROM r1 WHERE k NOT IN (SELECT k FROM r2)) AS removed FROM r2")
def projection_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection after two runs: rows of the last run, marked with the source's last day; those that it did not touch are gone."""
    store, _, done = _projected(spark, sf_dir)
    return store.read("momentum").select("k", "as_of", "bars", rounded("total").alias("total"), "computed_at", "source_max_date", F.lit(done["removed"]).cast("long").alias("removed"))


@query(f"WITH {MOVED_SQL} SELECT k, as_of, bars FROM r1 WHERE k NOT IN (SELECT k FROM r2)")
def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second run swept: rows of the version before whose key the newest version lacks."""
    store, before, _ = _projected(spark, sf_dir)
    return before.join(store.read("momentum").select("k"), "k", "left_anti").select("k", "as_of", "bars")


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS line, l_quantity AS amount FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT o_orderkey AS doc FROM orders WHERE o_orderstatus = 'P')
SELECT doc, line, amount FROM l WHERE doc NOT IN (SELECT doc FROM b) UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 1000 FROM lineitem JOIN b ON doc = l_orderkey WHERE l_linestatus = 'F'""")
def replace_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents after a batch replaced some documents' rows (some of them now have none); the batch is run twice."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("amount"), "l_returnflag", "l_linestatus")
    documents = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc"))
    rows = lines.where("l_linestatus = 'F'").select("doc", "line", (F.col("amount") * 1000).alias("amount"))
    store = Versions(spark, fresh_path(spark))
    old = lines.where("l_returnflag <> 'R'").select("doc", "line", "amount")
    store.replace_documents("orders", old, old.select("doc"), "doc")
    for _ in range(2):
        store.replace_documents("orders", rows, documents, "doc")
    return store.read("orders")


#: The tables that one snapshot of a stock's bars fills, each with its keys.
FANNED = {"stocks": ["k"], "closes": ["k", "d"], "extremes": ["k"], "volumes": ["k", "d"], "months": ["k", "m"], "signals": ["k", "d"], "projection": ["k"]}


@query(f"""WITH {BARS_SQL}, b1 AS (SELECT * FROM bars WHERE d < DATE '2000-06-01'), b2 AS (SELECT * FROM bars WHERE d >= DATE '2000-01-01' AND k % 3 <> 0),
k1 AS (SELECT k, max(d) AS d, max(h) AS h, min(l) AS l, count(*) AS n, sum(c) AS s FROM b1 GROUP BY k), k2 AS (SELECT k, max(d) AS d, max(h) AS h, min(l) AS l, count(*) AS n, sum(c) AS s FROM b2 GROUP BY k), kk AS (SELECT * FROM k2 UNION ALL SELECT * FROM k1 WHERE k NOT IN (SELECT k FROM k2)),
d AS (SELECT * FROM b2 UNION ALL SELECT * FROM b1 WHERE (k, d) NOT IN (SELECT (k, d) FROM b2)), m1 AS (SELECT k, date_trunc('month', d) AS m, sum(v) AS v FROM b1 GROUP BY ALL), m2 AS (SELECT k, date_trunc('month', d) AS m, sum(v) AS v FROM b2 GROUP BY ALL), mm AS (SELECT * FROM m2 UNION ALL SELECT * FROM m1 WHERE (k, m) NOT IN (SELECT (k, m) FROM m2))
SELECT 'stocks' AS name, count(*) AS n, round(sum(date_diff('day', DATE '1990-01-01', d)), 2) AS total FROM kk UNION ALL SELECT 'closes', count(*), round(sum(c), 2) FROM d UNION ALL SELECT 'extremes', count(*), round(sum(h - l), 2) FROM kk UNION ALL SELECT 'volumes', count(*), round(sum(v), 2) FROM d
UNION ALL SELECT 'months', count(*), round(sum(v), 2) FROM mm UNION ALL SELECT 'signals', count(*), round(sum(c), 2) FROM d WHERE c > o UNION ALL SELECT 'projection', count(*), round(sum(s / n), 2) FROM kk""")
def snapshot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tables after two snapshots, each read once and committed as one version: rows and a total of each."""
    store = Versions(spark, fresh_path(spark))
    bars = bars_daily(spark, sf_dir)
    for rows in (bars.where("d < '2000-06-01'"), bars.where("d >= '2000-01-01' and k % 3 <> 0")):
        snapshot = written(rows)[0]
        store.upsert({name: (made, FANNED[name]) for name, made in _fanned(snapshot).items()})
    total = {"stocks": F.datediff("d", F.lit("1990-01-01").cast("date")), "closes": F.col("c"), "extremes": F.col("h") - F.col("l"), "volumes": F.col("v"), "months": F.col("v"), "signals": F.col("c"), "projection": F.col("mean")}
    out = None
    for name, x in total.items():
        one = store.read(name).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(x).cast("double"), 2).alias("total")).select(F.lit(name).alias("name"), "n", "total")
        out = one if out is None else out.union(one)
    return out


def _fanned(bars: DataFrame) -> dict[str, DataFrame]:
    own = lambda *columns: bars.groupBy("k").agg(*columns)
    return {
        "stocks": own(F.max("d").alias("d")),
        "closes": bars.select("k", "d", "c"),
        "extremes": own(F.max("h").alias("h"), F.min("l").alias("l")),
        "volumes": bars.select("k", "d", "v"),
        "months": bars.groupBy("k", F.trunc("d", "MM").alias("m")).agg(F.sum("v").alias("v")),
        "signals": bars.where("c > o").select("k", "d", "c"),
        "projection": own((F.sum("c") / F.count(F.lit(1))).alias("mean")),
    }


@query("""WITH e AS (SELECT event_id, ts, event_id < (SELECT count(*) / 2 FROM events) AS early FROM events), c AS (SELECT date_trunc('minute', max(ts) FILTER (early)) AS a, date_trunc('minute', max(ts)) AS b FROM e)
SELECT event_id, CAST(CASE WHEN early AND ts < a THEN 0 WHEN ts < b THEN 1 ELSE 2 END AS BIGINT) AS run FROM e, c""")
def deferred_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that settles each event: the events come in two files, a run each, and what the second leaves is settled at the close."""
    path = fresh_path(spark)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    half = rows.count() / 2
    for early in (True, False):
        rows.where((F.col("event_id") < half) == early).write.mode("append").parquet(f"{path}/in")
        deferred.run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/runs", "event_id", "ts")
    return deferred.closed(spark, rows.schema, f"{path}/runs").select("event_id", F.col("batch").alias("run"))


@query("""WITH a AS (SELECT event_id, ts, CAST(ts AS DATE) AS day FROM events WHERE event_id % 997 <> 5), b AS (SELECT event_id, ts, CAST(ts AS DATE) AS day FROM events WHERE event_id % 499 <> 7), c AS (SELECT day, date_trunc('minute', max(ts)) AS cutoff FROM b GROUP BY day),
x AS (SELECT coalesce(a.day, b.day) AS day, a.ts AS ats, b.ts AS bts FROM a FULL OUTER JOIN b USING (event_id)), y AS (SELECT day, cutoff, coalesce(ats < cutoff, false) AS ina, coalesce(bts < cutoff, false) AS inb, coalesce(bts >= cutoff, false) AS late FROM x JOIN c USING (day))
SELECT day, CAST(cutoff AS TIMESTAMP) AS cutoff, count(*) FILTER (inb) AS expected, count(*) FILTER (ina) AS official_n, count(*) FILTER (late) AS deferred, count(*) FILTER (ina AND NOT inb) AS only_official, count(*) FILTER (inb AND NOT ina) AS only_other, CASE WHEN count(*) FILTER (ina <> inb) = 0 THEN 'match' ELSE 'count_mismatch' END AS status FROM y GROUP BY day, cutoff""")
def source_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of each day's events (each lacks some), compared before the minute of the second one's newest."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return deferred.compared(rows.where("event_id % 997 <> 5"), rows.where("event_id % 499 <> 7"), "event_id", "ts", F.to_date("ts"))


@query(f"""WITH {BARS_SQL}, r AS (SELECT k, d AS first, CAST(d + INTERVAL (CAST(v AS INTEGER) % 9) DAY AS DATE) AS last FROM bars WHERE k % 10 <> 3), w AS (SELECT DISTINCT k, CAST(date_trunc('month', d) AS DATE) AS first, CAST(date_trunc('month', d) + INTERVAL 9 DAY AS DATE) AS last FROM bars)
SELECT k, first, last, (SELECT count(DISTINCT x.day) FROM (SELECT unnest(generate_series(greatest(r.first, w.first), least(r.last, w.last), INTERVAL 1 DAY)) AS day FROM r WHERE r.k = w.k AND r.first <= w.last AND r.last >= w.first) x) = 10 AS covered FROM w""")
def range_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stock's stored ranges cover the first ten days of a month, of every month with a bar."""
    bars = bars_daily(spark, sf_dir)
    ranges = bars.where("k % 10 <> 3").select("k", F.col("d").alias("first"), F.date_add("d", (F.col("v").cast("int") % 9)).alias("last"))
    month = F.trunc("d", "MM")
    windows = bars.select("k", month.alias("first"), F.date_add(month, 9).alias("last")).distinct()
    return coverage.contained(windows, ranges, "k", "first", "last", "covered")


@query("""WITH e AS (SELECT user_id AS k, CAST(ts AS DATE) AS d, event_type, value, event_id FROM events), b AS (SELECT DISTINCT k, d FROM e WHERE event_type <> 'error' OR k % 4 = 0), s AS (SELECT DISTINCT k, d FROM e WHERE d >= DATE '2024-01-20'), z AS (SELECT k, d, max(2 + event_id % 3) AS ratio FROM e WHERE event_type = 'purchase' AND value > 100 AND k % 3 = 0 GROUP BY k, d),
y AS (SELECT k, d, ratio FROM z WHERE NOT (k % 6 = 0 AND day(d) = 11)), p AS (SELECT k, min(d) AS first, CASE WHEN k % 13 = 0 THEN max(d) + 1 ELSE max(d) END AS last, CASE WHEN k % 5 = 0 THEN '1y' ELSE '10y' END AS asked FROM b GROUP BY k),
g AS (SELECT k, min(d) AS bf, max(d) AS bl FROM b GROUP BY k), f AS (SELECT k, min(d) AS sf FROM s GROUP BY k)
SELECT p.k, CASE WHEN first <> bf OR last <> bl THEN 'span-mismatch' WHEN EXISTS (SELECT 1 FROM s WHERE s.k = p.k AND NOT EXISTS (SELECT 1 FROM b WHERE b.k = s.k AND b.d = s.d)) THEN 'sessions-uncovered'
  WHEN EXISTS (SELECT 1 FROM z WHERE z.k = p.k AND z.d >= bf AND NOT EXISTS (SELECT 1 FROM y WHERE y.k = z.k AND y.d = z.d AND y.ratio = z.ratio)) THEN 'splits-mismatch' WHEN EXISTS (SELECT 1 FROM z WHERE z.k = p.k AND z.d >= sf AND z.d <= bl) THEN 'in-window-split' WHEN asked <> '10y' THEN 'range-not-10y' END AS reason
FROM p JOIN g USING (k) LEFT JOIN f USING (k)""")
def zero_split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a stock's intraday sessions are not surely on the daily bars' share basis; null where they are."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("d"), "event_type", "value", "event_id")
    bars = e.where("event_type <> 'error' or k % 4 = 0").select("k", "d").distinct()
    splits = e.where("event_type = 'purchase' and value > 100 and k % 3 = 0").groupBy("k", "d").agg(F.max(2 + F.col("event_id") % 3).alias("ratio"))
    proven = splits.where(~((F.col("k") % 6 == 0) & (F.dayofmonth("d") == 11))).groupBy("k").agg(F.collect_list(F.struct("d", "ratio")).alias("splits"))
    span = bars.groupBy("k").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    proofs = span.withColumn("last", F.when(F.col("k") % 13 == 0, F.date_add("last", 1)).otherwise(F.col("last"))).join(proven, "k", "left").withColumn("asked", F.when(F.col("k") % 5 == 0, "1y").otherwise("10y"))
    return coverage.zero_split_coverage(proofs, e.where("d >= '2024-01-20'").select("k", "d"), bars, splits)
