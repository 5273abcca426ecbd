"""Passages of text and what is read from them: normal forms, words, sentences, paragraphs, evidence, candidates by likeness, disclosures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions import passages as ps
from tickforge.functions.columns import rounded
from tickforge.operators import excerpts
from tickforge.plans.registry import query
from tickforge.sources.tables import table


@query("""WITH t AS (SELECT item_id, lower(text) AS t FROM benchmark), g AS (SELECT item_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 2 THEN [t] ELSE list_transform(range(1, len(t)), lambda i: t[i:i+1]) END) AS gram FROM t)
SELECT gram, count(*) AS n, count(DISTINCT item_id) AS items FROM g GROUP BY gram""")
def text_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character bigrams of the items: mentions and items of each."""
    grams = table(spark, sf_dir, "benchmark").select("item_id", F.explode(ps.ngrams(F.lower("text"))).alias("gram"))
    each = grams.groupBy("gram", "item_id").agg(F.count(F.lit(1)).alias("m"))
    return each.groupBy("gram").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("items"))


@query()
def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of whole documents, by place, with start, end and the text between; tests check them against a plain loop over characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(ps.paragraphs(F.col("text"))).alias("place", "p"))
    return rows.select("doc_id", "place", F.col("p.start").alias("start"), F.col("p.end").alias("stop"), F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("paragraph"))


EVIDENCE = ["an", "is", "ta"]
MARK_SQL = "(CASE " + " ".join(f"WHEN regexp_matches(lower(s), '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN '{w}'" for w in EVIDENCE) + " END)"


@query(f"""WITH s AS (SELECT conv_id, turn, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?\\r\\n]*[。！？!?]+|[^。！？!?\\r\\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p FROM conversations)),
h AS (SELECT *, {MARK_SQL} AS word FROM s), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i, s) AS place FROM h WHERE word IS NOT NULL), p AS (SELECT *, len(s) AS n, strpos(s, word) AS a, len(word) AS w, CAST(floor((300 - len(word)) / 2) AS BIGINT) AS half FROM d WHERE place <= 3),
c AS (SELECT *, CASE WHEN a > 0 THEN greatest(least(a - 1 - half, n - w - 2 * half), 0) ELSE CAST(floor((n - 300) / 2) AS BIGINT) END AS b, CASE WHEN a > 0 THEN w + 2 * half ELSE 300 END AS l FROM p)
SELECT conv_id, place, word, CASE WHEN n <= 300 THEN s ELSE (CASE WHEN b > 0 OR a = 0 THEN '…' ELSE '' END) || substr(s, b + 1, l) || (CASE WHEN b + l < n OR a = 0 THEN '…' ELSE '' END) END AS evidence FROM c""")
def evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences of a conversation that have a word, clipped around it; at most three rows of a turn are numbered at all."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(ps.sentences(F.col("text")), lambda s, i: F.struct(i.alias("i"), s.alias("s"), F.get(ps.words_in(F.lower(s), EVIDENCE), F.lit(0)).alias("word"))).alias("all"))
    hits = turns.select("conv_id", "turn", F.explode(F.slice(F.filter("all", lambda h: h["word"].isNotNull()), 1, 3)).alias("h")).select("conv_id", "turn", "h.*")
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i", "s"))).where("place <= 3")
    return placed.select("conv_id", "place", "word", ps.clipped(F.col("s"), F.col("word")).alias("evidence"))


#: Weights of likeness by tags, sector and text; the longest lists of a tag and of an n-gram whose pairs are scored.
WEIGHTS = {"tag": 0.55, "sector": 0.15, "text": 0.3}
LONGEST = {"tag": 60, "text": 120}
CANDIDATES = 18


def candidates(tags: DataFrame, grams: DataFrame, sectors: DataFrame, longest: dict[str, int] = LONGEST, top: int = CANDIDATES) -> DataFrame:
    """(item, place, other, score): of every item the `top` others most like it by weighted cosines of tags and n-grams, and one more weight for one sector.

    tags (item, term), grams (item, term, n), sectors (item, sector), an item in each at most once. A term in more than `longest` items weighs in the
    norms but starts no pair: `longest` is the operator's own setting, and bounds the pairs by it times the terms of the items.
    """
    total = F.broadcast(sectors.agg(F.count(F.lit(1)).alias("total")))

    def pairs(terms: DataFrame, idf: F.Column, kind: str) -> DataFrame:
        spread = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weighed = terms.join(spread, "term").crossJoin(total).withColumn("w", F.col("n") * idf).where("w > 0")
        norms = weighed.groupBy("item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        unit = weighed.where(F.col("df").between(2, longest[kind])).join(norms, "item").select("term", "item", (F.col("w") / F.col("norm")).alias("u"))
        other = unit.select("term", F.col("item").alias("other"), F.col("u").alias("v"))
        return unit.join(other, "term").where("item <> other").select("item", "other", (F.col("u") * F.col("v") * WEIGHTS[kind]).alias("s"))

    by_tag = pairs(tags.withColumn("n", F.lit(1)), F.log(F.col("total") / F.col("df")), "tag")
    by_text = pairs(grams, F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1, "text")
    found = by_tag.unionByName(by_text).groupBy("item", "other").agg(F.sum("s").alias("s"))
    found = found.join(sectors, "item", "left").join(sectors.select(F.col("item").alias("other"), F.col("sector").alias("theirs")), "other", "left")
    scored = found.select("item", "other", rounded(F.col("s") + F.when(F.col("sector") == F.col("theirs"), WEIGHTS["sector"]).otherwise(0.0), 6).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "other"))).where(F.col("place") <= top)


@query(f"""WITH b AS (SELECT item_id AS item, lower(text) AS t, item_id % 5 AS sector FROM benchmark), n AS (SELECT count(*) AS total FROM b),
tg AS (SELECT DISTINCT item, unnest(list_filter(regexp_split_to_array(t, '[^a-z]+'), lambda x: len(x) >= 7)) AS term FROM b), tw AS (SELECT item, term, df, ln(total / df) AS w FROM tg JOIN (SELECT term, count(*) AS df FROM tg GROUP BY term) USING (term), n WHERE df < total),
gg AS (SELECT item, term, count(*) AS n FROM (SELECT item, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 2 THEN [t] ELSE list_transform(range(1, len(t)), lambda i: t[i:i+1]) END) AS term FROM b) GROUP BY ALL), gw AS (SELECT item, term, df, gg.n * (ln((total + 1) / (df + 1)) + 1) AS w FROM gg JOIN (SELECT term, count(*) AS df FROM gg GROUP BY term) USING (term), n),
tu AS (SELECT item, term, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS u, df FROM tw), gu AS (SELECT item, term, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS u, df FROM gw),
p AS (SELECT a.item, c.item AS other, {WEIGHTS['tag']} * a.u * c.u AS s FROM tu a JOIN tu c USING (term) WHERE a.item <> c.item AND a.df <= {LONGEST['tag']} UNION ALL SELECT a.item, c.item, {WEIGHTS['text']} * a.u * c.u FROM gu a JOIN gu c USING (term) WHERE a.item <> c.item AND a.df <= {LONGEST['text']}),
s AS (SELECT item, other, round(sum(s) + CASE WHEN item % 5 = other % 5 THEN {WEIGHTS['sector']} ELSE 0 END, 6) AS score FROM p GROUP BY item, other)
SELECT item, other, score, place FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, other) AS place FROM s) WHERE place <= {CANDIDATES}""")
def competitor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items most like each item: long words as tags, bigrams as text, a fifth of the items as a sector."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.lower("text").alias("t"))
    tags = items.select("item", F.explode(F.array_distinct(F.filter(F.split("t", "[^a-z]+"), lambda x: F.char_length(x) >= 7))).alias("term"))
    grams = items.select("item", F.explode(ps.ngrams(F.col("t"))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("n"))
    return candidates(tags, grams, items.select("item", (F.col("item") % 5).alias("sector"))).select("item", "other", "score", "place")


#: Terms by their words and exclusions, for the tables' invented languages.
VOCABULARY = {"alpha": (["then", "tion"], ["this"]), "beta": (["pour", "les"], []), "gamma": (["heit", "und"], ["keit"]), "delta": (["el", "que"], []), "none": (["半導体"], [])}


@query()
def judge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is given of each document: its text around the hits, and of three turns of a conversation the paragraphs with hits; tests check it against plain loops."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "source", "lang")
    header = F.concat(F.lit("銘柄コード: "), "source", F.lit("\n書類ID: "), F.col("doc").cast("string"), F.lit("\n書類種別: "), "lang")
    turn = F.element_at(F.array(*map(F.lit, excerpts.SUPPORT)), (F.col("turn") + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").where("turn < 3").select(F.col("conv_id").alias("doc"), turn.alias("section"), "text")
    sections = docs.select("doc", F.lit(excerpts.MAIN).alias("section"), "text").union(turns)
    return excerpts.judge_inputs(docs.select("doc", header.alias("header")), sections, VOCABULARY)
