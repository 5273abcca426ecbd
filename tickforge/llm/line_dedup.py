"""Line dedup by site-relative frequency.

Within each host, the pages that contain a line are divided by the host's pages; lines over `ratio` are
boilerplate and dropped. Only hosts of at least `least_pages` pages are judged,
and a line must be in `least_found` pages of the host. Frequencies are partial counts
of 64-bit line hashes, so a host with a third of all pages is no hot group; what is dropped per host is at most
(lines per page) / ratio hashes. Where all hosts' drop lists together are under BROADCAST hashes (counted first), they are
sent to the pages; else pages meet them by host and salt, a salt for every PER_SALT pages of a host. The hosts that
need more than one salt are fewer than pages / PER_SALT.

A passage of many words does not repeat by chance: with `long_words`, a line of more words than that is also
boilerplate if it is in `least_found` different texts of the host, whatever their share and the host's size.
Copies of one text count once for this. As such lines have no bound per host, they are matched by (host, text).

Defined results: null text stays null; lines are compared without the ASCII white space around them, blank ones are
kept and never counted; pages with a null host are left as they are; a line repeated in a page counts once;
repeated rows count as pages each; an empty table gives an empty result; further columns stay, whatever their names,
but n_lines and n_dropped are replaced where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import drop_table, read, written

RATIO = 0.1
LEAST_PAGES = 5
#: Line hashes that are broadcast at most (16 MB).
BROADCAST = 2_000_000
#: Pages of a host that meet its drop list in one task.
PER_SALT = 20_000
WHITE = " \t\r\x0b\x0c"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BLOCK = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|article|section|header|footer|nav|title|table|tr|td|th|head|body|html|main|aside|form|hr|blockquote|pre)\b[^>]*>"
TAG = r"<[^>]*>"
# The entities that are resolved, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def page_text(html: Column) -> Column:
    """A page's text, a line per block element."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, "")
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def page_host(url: Column) -> Column:
    """The host of an http(s) address, lower-cased; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(host != "", host)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(WHITE))


def _keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(_bare(x)))


def with_lists(rows: DataFrame, common: DataFrame, sizes: DataFrame, per_salt: int, broadcast: int) -> DataFrame:
    """rows (host, ...) with the host's `common` lines, null if there are none."""
    lists, seen = written(common, F.coalesce(F.sum(F.size("common")), F.lit(0)).alias("n"))
    if seen["n"] <= broadcast:
        return rows.join(F.broadcast(lists), "host", "left")
    salts = F.ceil(F.col("pages") / per_salt).cast("int")
    hot = sizes.where(F.col("pages") > per_salt).select("host", salts.alias("salts"))
    salted = lists.join(sizes, "host").select("host", "common", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rows = rows.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("text"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return rows.join(salted, ["host", "salt"], "left").drop("salt")


def without_boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_found: int = 2, long_words: int | None = None, counts: bool = True, per_salt: int = PER_SALT, broadcast: int = BROADCAST
) -> DataFrame:
    """pages with the host's boilerplate lines taken out of `text`, and with n_lines and n_dropped (lines that are not blank) if `counts`."""
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    lines = F.split("text", "\n", -1)
    full = F.filter(lines, lambda x: _bare(x) != "")
    counted = rows.where("host is not null").select("host", "text")
    sizes = counted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = counted.select("host", F.explode(F.array_distinct(_keys(full))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("found"))
    common = seen.join(sizes.where(F.col("pages") >= least_pages), "host").where((F.col("found") > ratio * F.col("pages")) & (F.col("found") >= least_found))
    joined = with_lists(rows, common.groupBy("host").agg(F.collect_list("line").alias("common")), sizes, per_salt, broadcast)
    none = F.array().cast("array<bigint>")
    bad = F.coalesce("common", none)
    if long_words is not None:
        passages = F.filter(full, lambda x: F.size(F.split(_bare(x), r"\s+", -1)) > long_words)
        held = counted.select("host", F.xxhash64("text").alias("key"), F.explode(F.array_distinct(_keys(passages))).alias("line")).distinct()
        often = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= least_found).select("host", "line")
        own = held.join(often, ["host", "line"]).groupBy("host", "key").agg(F.collect_list("line").alias("passages"))
        own, _ = written(own)
        joined = joined.withColumn("key", F.xxhash64("text")).join(own, ["host", "key"], "left")
        bad = F.concat(bad, F.coalesce("passages", none))
    kept = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(bad, F.xxhash64(_bare(x))))
    dropped = F.size(lines) - F.size(kept)
    cleaned = F.when(dropped == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    number = lambda x: F.coalesce(F.when(F.col("text").isNotNull(), x), F.lit(0)).cast("long")
    joined = joined.select("row", cleaned.alias("cleaned"), F.struct(number(F.size(full)).alias("n_lines"), number(dropped).alias("n_dropped")).alias("counts"))
    own = ["n_lines", "n_dropped"] if counts else []
    stay = [(F.col("cleaned") if c == text else F.col("row")[c]).alias(c) for c in pages.columns if c not in own]
    return joined.select(*stay, *(F.col("counts")[c].alias(c) for c in own))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", page_host(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    pages, texts = written(pages)
    out, _ = written(without_boilerplate(pages, "host", "text").select("page_id", "host", "n_lines", "n_dropped", F.md5("text").alias("text_md5")))
    drop_table(spark, texts["path"])
    return out


def _sql_text() -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g')"
    for name, char in ENTITIES.items():
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''")) if name != "&#39;" else f"replace({text}, '&#39;', '''')"
    return text


OP8_SQL = rf"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '') AS host, string_split({_sql_text()}, chr(10)) AS lines FROM pages
), size AS (SELECT host, count(*) AS n FROM p WHERE host IS NOT NULL GROUP BY host),
each_line AS (SELECT page_id, host, i, lines[i] AS raw, trim(lines[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM p, unnest(generate_series(1, len(lines))) AS g(i)),
bad AS (
  SELECT s.host, l.line FROM (SELECT host, line, count(DISTINCT page_id) AS c FROM each_line WHERE line <> '' AND host IS NOT NULL GROUP BY host, line) l
  JOIN size s ON s.host = l.host WHERE s.n >= {LEAST_PAGES} AND l.c > {RATIO} * s.n AND l.c >= 2
)
SELECT e.page_id, e.host, CAST(count(*) FILTER (e.line <> '') AS BIGINT) AS n_lines, CAST(count(b.line) AS BIGINT) AS n_dropped,
  md5(string_agg(e.raw, chr(10) ORDER BY i) FILTER (b.line IS NULL)) AS text_md5
FROM each_line e LEFT JOIN bad b ON b.host = e.host AND b.line = e.line GROUP BY e.page_id, e.host
"""
