"""Titles, tags, sentiment, keyword search, similarity and page markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import ratio, rounded
from tickforge.operators import prose
from tickforge.plans.registry import query
from tickforge.sources.tables import table

TITLE_SQL = "t AS (SELECT conv_id, turn, role, text AS title FROM conversations)"
TAGS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(title), '{p}') THEN '{t}' END" for t, p, _ in prose.RULES) + "], lambda x: x IS NOT NULL)"
POLARITY_SQL = "CASE WHEN tag IS NULL THEN 'unclassified' " + " ".join(f"WHEN tag = '{t}' THEN '{w}'" for t, _, w in prose.RULES) + " ELSE 'neutral' END"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("title"))


@query(f"WITH {TITLE_SQL} SELECT conv_id, turn, array_to_string({TAGS_SQL}, ',') AS tags, {TAGS_SQL}[1] AS primary_tag FROM t")
def classify_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titles(spark, sf_dir).withColumn("tags", prose.tags(F.col("title")))
    return rows.select("conv_id", "turn", F.array_join("tags", ",").alias("tags"), F.get("tags", F.lit(0)).alias("primary_tag"))


@query(f"WITH {TITLE_SQL}, x AS (SELECT role, {TAGS_SQL}[1] AS tag FROM t) SELECT role, coalesce(tag, '_unclassified') AS tag, {POLARITY_SQL} AS sentiment, count(*) AS n FROM x GROUP BY role, tag")
def tag_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titles(spark, sf_dir).select("role", F.get(prose.tags(F.col("title")), F.lit(0)).alias("t"))
    g = rows.groupBy("role", "t").agg(F.count(F.lit(1)).alias("n"))
    return g.select("role", F.coalesce("t", F.lit("_unclassified")).alias("tag"), prose.polarity(F.col("t")).alias("sentiment"), "n")


# The stand-in dictionary.
POSITIVE, NEGATIVE, NEGATION = ["the", "les", "die", "que"], ["of", "de", "der", "en"], ["not", "pas", "nicht", "no", "and", "et"]


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS ws FROM conversations), k AS (SELECT conv_id, turn, i, ws[i] AS token, list_has_any(ws[i + 1:i + 3], {NEGATION!r}) AS flip FROM w, unnest(range(1, len(ws) + 1)) AS g(i)),
h AS (SELECT conv_id, turn, CASE WHEN (token IN {_in(POSITIVE)}) <> flip THEN 1 ELSE -1 END AS v FROM k WHERE token IN {_in(POSITIVE + NEGATIVE)}), s AS (SELECT conv_id, turn, count(*) FILTER (v > 0) AS pos, count(*) FILTER (v < 0) AS neg FROM h GROUP BY conv_id, turn)
SELECT conv_id, turn, pos, neg, round((pos - neg) / (pos + neg), 4) AS score, CASE WHEN pos + neg < 6 OR abs((pos - neg) / (pos + neg)) < 0.15 THEN 'unknown' WHEN pos > neg THEN 'positive' ELSE 'negative' END AS polarity FROM s""")
def dict_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary hits per turn; a negation within three tokens flips one."""
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc"), F.posexplode(prose.words(F.col("text"))).alias("position", "token"))
    hits = prose.flipped_hits(rows, "doc", POSITIVE, NEGATIVE, NEGATION)
    score = ratio(F.col("pos") - F.col("neg"), F.col("pos") + F.col("neg"))
    verdict = F.when((F.col("pos") + F.col("neg") < 6) | (F.abs(score) < 0.15), "unknown").when(F.col("pos") > F.col("neg"), "positive").otherwise("negative")
    return hits.select("doc.conv_id", "doc.turn", "pos", "neg", rounded(score).alias("score"), verdict.alias("polarity"))


SENTENCES_SQL = "s AS (SELECT conv_id, turn, trim(s, ' ') AS sentence FROM (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?])', '\\1' || chr(10), 'g'), chr(10))) AS s FROM conversations) WHERE trim(s, ' ') <> '')"


@query(f"WITH {SENTENCES_SQL} SELECT conv_id, turn, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars, max(length(sentence)) AS longest FROM s GROUP BY conv_id, turn")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prose.sentences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")
    size = F.char_length("sentence")
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("sentences"), F.sum(size).alias("chars"), F.max(size).cast("long").alias("longest"))


TERMS = {"alpha": (["then", "that"], ["this"]), "beta": (["pour"], []), "gamma": (["keit"], ["heit"])}


@query(f"WITH {SENTENCES_SQL} " + " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) AS hits, count(DISTINCT conv_id) AS conversations FROM s WHERE ({' OR '.join(f'contains(lower(sentence), {w!r})' for w in words)})" + "".join(f" AND NOT contains(lower(sentence), {w!r})" for w in not_) for t, (words, not_) in TERMS.items()))
def keyword_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that hold one of a term's words and none of its exclusions: one pass, a row per term hit, zeros for a term without hits."""
    rows = prose.sentences(table(spark, sf_dir, "conversations").select("conv_id", "text"), "text").withColumn("low", F.lower("sentence"))
    has = lambda ws: F.array_contains(F.array(*(F.contains(F.col("low"), F.lit(w)) for w in ws)), True) if ws else F.lit(False)
    hits = F.array_compact(F.array(*(F.when(has(words) & ~has(not_), t) for t, (words, not_) in TERMS.items())))
    found = rows.select("conv_id", F.explode(hits).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("conv_id").alias("conversations"))
    terms = spark.range(1).select(F.explode(F.array(*map(F.lit, TERMS))).alias("term"))
    return terms.join(found, "term", "left").na.fill(0)


@query("""WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS term FROM benchmark), n AS (SELECT count(DISTINCT item_id) AS n FROM w), c AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
x AS (SELECT item_id, term, df, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM c JOIN f USING (term), n), l AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY item_id), u AS (SELECT item_id, term, w / norm AS w FROM x JOIN l USING (item_id)),
s AS (SELECT a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.term = b.term AND a.item_id <> b.item_id WHERE a.item_id % 100 = 0 GROUP BY ALL)
SELECT a, b, score, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INT) AS place FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5""")
def tfidf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar items of every hundredth one, over all terms and all items."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.explode(prose.words(F.col("text"))).alias("term"))
    weights = prose.term_weights(terms, "item_id")
    return prose.similar(weights, "item_id", 5, F.col("item_id") % 100 == 0).select("a", "b", "score", "place")


@query("""SELECT q, v, score, CAST(place AS INT) AS place FROM (SELECT a.vec_id AS q, b.vec_id AS v, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE place <= 3""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of the same label for every hundredth one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "label", F.col("e").alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = rounded(F.try_divide(dot("x", "e"), F.sqrt(dot("x", "x") * dot("e", "e"))))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    found = prose.in_blocks(rows, asked, "label", "vec_id").where("q <> vec_id").select("q", F.col("vec_id").alias("v"), score.alias("score"))
    return found.withColumn("place", F.row_number().over(best)).where("place <= 3")


@query("""WITH p AS (SELECT d.lang, l.quality = 1 AS truth, d.n_chars > 1500 AS said FROM labels l JOIN documents d USING (doc_id)), m AS (SELECT coalesce(lang, 'all') AS lang, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM p GROUP BY ROLLUP (lang))
SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM m""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1500).alias("said"))
    n = lambda said, truth: F.count(F.when((F.col("said") == said) & (F.col("truth") == truth), 1))
    m = rows.rollup("lang").agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    return m.select(F.coalesce("lang", F.lit("all")).alias("lang"), "tp", "fp", "fn", "tn", rounded(ratio("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), rounded(ratio("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


STRIP = [(r"<script[^>]*>[^<]*(?:</p>[^<]*)?</script>", " "), (r"<style[^>]*>[^<]*</style>", " "), (r"<!--[^>]*-->", " "), (r"<[^>]*>", " "), (r"&(?:nbsp|copy|middot|quot|#39);", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&amp;", "&"), (r"[ \t\n\r]+", " ")]


def _strip_sql() -> str:
    out = "html"
    for pattern, by in STRIP:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out}, ' ')"


@query(f"SELECT page_id, md5({_strip_sql()}) AS text_md5, length({_strip_sql()}) AS chars FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("html")
    for pattern, by in STRIP:
        text = F.regexp_replace(text, pattern, by)
    rows = table(spark, sf_dir, "pages").select("page_id", F.trim(text).alias("text"))
    return rows.select("page_id", F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("chars"))


@query("SELECT page_id, CAST(i - 1 AS INT) AS position, links[i] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS links FROM pages), unnest(range(1, len(links) + 1)) AS g(i)")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("position", "href"))
