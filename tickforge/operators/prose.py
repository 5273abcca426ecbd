"""Titles, sentences, terms and their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import rounded

#: What the stand-in corpus's titles are tagged by: (tag, pattern, polarity); the first that matches is primary.
RULES = [("license", "licen[sc]e", "neutral"), ("tion", "tion[ ,.]", "positive"), ("heit", "heit[ ,.]", "positive"), ("ción", "ción", "positive"), ("eau", "eau", "negative"), ("ing", "ing[ ,.]", "negative")]


def tags(title: Column) -> Column:
    """The tags of a title in the rules' order."""
    return F.array_compact(F.array(*(F.when(F.lower(title).rlike(pattern), tag) for tag, pattern, _ in RULES)))


def polarity(tag: Column) -> Column:
    out = F.when(tag.isNull(), "unclassified")
    for name, _, word in RULES:
        out = out.when(tag == name, word)
    return out.otherwise("neutral")


def words(text: Column) -> Column:
    """Lower-case words of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+", -1), lambda w: w != "")


def sentences(df: DataFrame, text: str) -> DataFrame:
    """df's rows per sentence (position, sentence): cut behind . ! ? or at line feeds, trimmed, blank ones dropped."""
    parts = F.filter(F.transform(F.split(F.col(text), r"(?<=[.!?])(?!\n)|\n", -1), lambda s: F.trim(s)), lambda s: s != "")
    return df.select(*(c for c in df.columns if c != text), F.posexplode(parts).alias("position", "sentence"))


def term_weights(terms: DataFrame, document: str) -> DataFrame:
    """(document, term, w): counts times ln((n + 1) / (df + 1)) + 1 at unit length, n the number of documents."""
    counts = terms.groupBy(document, "term").agg(F.count(F.lit(1)).alias("tf"))
    known = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = counts.agg(F.count_distinct(document).alias("n"))  # one row
    weights = counts.join(known, "term").crossJoin(F.broadcast(size)).withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    lengths = weights.groupBy(document).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(lengths, document).select(document, "term", (F.col("w") / F.col("norm")).alias("w"))


#: Rows of a join key that meet the asked ones in one task.
BLOCK = 50_000


def in_blocks(rows: DataFrame, asked: DataFrame, key: str, id_: str, block: int = BLOCK) -> DataFrame:
    """rows joined with the asked ones on key; a key with more than `block` rows is dealt over blocks by id_, and its asked rows go to each.

    The keys that need it are at most one for `block` rows.
    """
    hot = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")).where("_blocks > 1")
    many = F.coalesce("_blocks", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_block", F.pmod(F.xxhash64(id_), many).cast("int")).drop("_blocks")
    copied = asked.join(hot, key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), many - 1))).drop("_blocks")
    return dealt.join(copied, [key, "_block"]).drop("_block")


def similar(weights: DataFrame, document: str, k: int, asked: Column) -> DataFrame:
    """(a, b, score, place): the k most similar documents of each asked one by the product over shared terms; ties by b.

    A stated query set against all documents, in blocks: a term's list meets the asked documents that hold it, not itself.
    """
    left = weights.where(asked).select(F.col(document).alias("a"), "term", F.col("w").alias("x"))
    right = weights.select(F.col(document).alias("b"), "term", F.col("w").alias("y"))
    scores = in_blocks(right, left, "term", "b").where("a <> b").groupBy("a", "b").agg(rounded(F.sum(F.col("x") * F.col("y")), 6).alias("score"))
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return scores.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def flipped_hits(tokens: DataFrame, document: str, positive: list[str], negative: list[str], negation: list[str], reach: int = 3) -> DataFrame:
    """(document, pos, neg) of tokens (document, position, token): a negation within the next `reach` tokens flips a hit."""
    ahead = Window.partitionBy(document).orderBy("position").rowsBetween(1, reach)
    side = F.when(F.col("token").isin(positive), 1).when(F.col("token").isin(negative), -1)
    rows = tokens.withColumn("_side", side).withColumn("_not", F.max(F.col("token").isin(negation)).over(ahead)).where("_side is not null")
    value = F.when(F.coalesce("_not", F.lit(False)), -F.col("_side")).otherwise(F.col("_side"))
    return rows.groupBy(document).agg(F.count(F.when(value > 0, 1)).alias("pos"), F.count(F.when(value < 0, 1)).alias("neg"))
