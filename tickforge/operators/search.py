"""Full-text search for whatever holds a string, by an inverted index.

An index is three tables in a folder. `terms` (term, docs): the words of the lower-cased texts; a run of an unspaced script (CJK) has its pairs of
characters instead. `postings` (bucket, term, part, ids): the ids of a term's texts, a row for each range of `span` ids, so a term of very
many texts has many rows and none outgrows a range; in folders by bucket of the term's hash. `texts` (part, id, text): in folders by range.

A string is searched by what it needs: a word inside it must be a term; one at its start (end) may go on before (behind) it, so a term
that ends (begins) with it will do, which the dictionary answers; every pair of an unspaced run must be there. The postings of the rarest
needs are fetched and intersected, and what is left is verified by the text itself. A string that is one word (or one character of an unspaced
script) stands in a text if and only if a term of the text holds it: its postings are the answer. Only a string without any letter or figure, or whose rarest need is met by a
large share of the texts (a letter, an article), reads all texts, as its answer is of that size.

Defined results: a null or empty string finds nothing; a null text is found by nothing; texts that share an id are found under it; ids are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.sources.shared import written

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
TOKEN = rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"
#: No unspaced script has a character before this range; telling scripts apart is slow, and texts without any of it are spared that.
UNSPACED_FROM = r"[\x{2E80}-\x{10FFFF}]"
#: Ids of a range, buckets of terms, needs of a string whose postings are fetched, and the share of all texts up to which a need is rare enough for that.
SPAN, BUCKETS, NEEDS, RARE = 1_000_000, 64, 3, 0.2
#: Postings for each text up to which a string of one word is answered by them; above, most texts hold it early on and are read.
DIRECT = 2.0


def _tokens(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def _unspaced(token: Column) -> Column:
    return token.rlike(f"^[{CJK}]")


def _pairs(token: Column) -> Column:
    """The pairs of an unspaced run; one character alone is itself."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(token) - 1, F.lit(1))), lambda i: F.substring(token, i, F.lit(2)))


def terms_of(low: Column) -> Column:
    """The distinct terms of a lower-cased text."""
    mixed = F.flatten(F.transform(_tokens(low), lambda t: F.when(_unspaced(t), _pairs(t)).otherwise(F.array(t))))
    return F.array_distinct(F.when(low.rlike(UNSPACED_FROM), mixed).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TextIndex:
    """An index in a folder. build() writes it, found() searches it."""

    def __init__(self, spark: SparkSession, path: str, span: int = SPAN, buckets: int = BUCKETS):
        self.spark, self.path, self.span, self.buckets = spark, path, span, buckets

    def build(self, texts: DataFrame) -> TextIndex:
        """Indexes texts (id, text)."""
        part = F.floor(F.col("id") / self.span).cast("long").alias("part")
        rows = texts.where("text is not null").select(part, F.col("id").cast("long").alias("id"), "text")
        rows.repartition("part", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("part").parquet(f"{self.path}/texts")
        posted = rows.select("part", "id", F.lower("text").alias("low")).select("part", "id", F.explode(terms_of(F.col("low"))).alias("term"))
        lists = posted.groupBy("term", "part").agg(F.sort_array(F.array_distinct(F.collect_list("id"))).alias("ids")).withColumn("bucket", _bucket("term", self.buckets))
        lists.repartition("bucket", "part").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        docs = self.table("postings").groupBy("term").agg(F.sum(F.size("ids")).alias("docs"))
        docs.write.parquet(f"{self.path}/terms")
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def needs(self, strings: DataFrame) -> DataFrame:
        """(q, low, need, term, how) of strings (q, string): what a text that holds the string must have; how: exact, end, start or inside."""
        low = strings.select("q", F.lower("string").alias("low")).where("low <> ''")
        each = low.withColumn("all", _tokens(F.col("low"))).select("q", "low", F.size("all").alias("n"), F.posexplode("all").alias("i", "token"))
        first = (F.col("i") == 0) & F.startswith("low", "token")
        last = (F.col("i") == F.col("n") - 1) & F.endswith("low", "token")
        spaced = F.when(first & last, "inside").when(first, "end").when(last, "start").otherwise("exact")
        single = F.char_length("token") == 1
        parts = F.when(_unspaced(F.col("token")) & ~single, F.transform(_pairs(F.col("token")), lambda t: F.struct(t.alias("term"), F.lit("exact").alias("how"))))
        parts = parts.otherwise(F.array(F.struct(F.col("token").alias("term"), F.when(_unspaced(F.col("token")), "inside").otherwise(spaced).alias("how"))))
        rows = each.select("q", "low", F.explode(parts).alias("p")).select("q", "low", "p.term", "p.how").distinct()
        return rows.withColumn("need", F.concat_ws(":", "how", "term"))

    def found(self, strings: DataFrame) -> DataFrame:
        """(q, id): the texts that hold each string of (q, string), in any case. strings is a stated set: it is sent to every task."""
        strings = written(strings.select("q", "string"))[0]
        needs = written(self.needs(strings))[0]
        terms, total = self.table("terms"), self.table("texts").count()
        # What each need costs, whatever the strings that have it: the texts of the terms that it is met by.
        kinds = needs.select("need", "term", "how").distinct()
        exact = kinds.where("how = 'exact'").join(terms, "term").select("need", "docs")
        wide = kinds.where("how <> 'exact'").withColumnRenamed("term", "piece")
        cost = exact.union(_met(terms, wide).select("need", "docs")).groupBy("need").agg(F.sum("docs").alias("docs"))
        whole = (F.col("how") == "inside") & (F.col("term") == F.col("low"))
        cost = written(needs.select("q", "need", whole.alias("whole")).join(cost, "need", "left").na.fill(0, ["docs"]).withColumn("most", F.when(F.col("whole"), DIRECT).otherwise(RARE) * total))[0]
        # A need that no term meets has no text; of the others the rarest count, if they are rare at all.
        best = cost.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("docs", "need"))).where(F.col("place") <= NEEDS)
        least = best.groupBy("q").agg(F.min("docs").alias("least"), F.min("most").alias("most"))
        rare = best.join(least.where(F.col("least") > 0).select("q"), "q").where(F.col("docs") <= F.col("most")).select("q", "need", "whole")
        size = rare.groupBy("q").agg(F.count(F.lit(1)).alias("wanted"))
        chosen = written(rare.join(needs.select("q", "need", "term", "how"), ["q", "need"]).join(size, "q"))[0]
        met = chosen.where("how = 'exact'").select("q", "need", "wanted", "whole", "term")
        met = met.union(_met(terms, chosen.where("how <> 'exact'").withColumnRenamed("term", "piece")).select("q", "need", "wanted", "whole", "term"))
        asked = written(met.withColumn("bucket", _bucket("term", self.buckets)))[0]
        posted = lambda which: self.table("postings").join(asked.where(which), ["bucket", "term"])
        direct = posted("whole").select("q", F.explode("ids").alias("id"))
        hits = posted("not whole").select("q", "need", "wanted", "part", F.explode("ids").alias("id")).distinct()
        left = hits.groupBy("q", "part", "id").agg(F.count(F.lit(1)).alias("got"), F.first("wanted").alias("wanted")).where("got = wanted").select("q", "part", "id")
        low = needs.select("q", "low").distinct()
        checked = self.table("texts").join(left.join(F.broadcast(low), "q"), ["part", "id"]).where(F.contains(F.lower("text"), F.col("low"))).select("q", "id").union(direct)
        # Strings without a need, and those whose rarest one most texts have, are looked for in all texts.
        common = least.where(F.col("least") > F.col("most")).select("q")
        bare = strings.select("q", F.lower("string").alias("low")).where("low <> ''").join(needs.select("q").distinct().join(common, "q", "left_anti"), "q", "left_anti")
        if bare.isEmpty():
            return checked.distinct()
        texts = self.table("texts").select("id", F.lower("text").alias("lowered"))
        scanned = texts.join(F.broadcast(bare.select("low").distinct()), F.contains("lowered", F.col("low"))).select("id", "low").join(F.broadcast(bare), "low").select("q", "id")
        return checked.union(scanned).distinct()


def _met(terms: DataFrame, needs: DataFrame) -> DataFrame:
    """Terms beside each need (need, piece, how) that they meet, once. needs is a stated set: it is sent to every task.

    A need at a term's start (end) is only compared with terms that have its first (last) character there.
    """
    edge = lambda how, of: terms.withColumn("edge", of(F.col("term"))).join(F.broadcast(needs.where(F.col("how") == how).withColumn("edge", of(F.col("piece")))), "edge")
    first, last = (lambda c: F.substring(c, 1, 1)), (lambda c: F.substring(c, -1, 1))
    inside = terms.join(F.broadcast(needs.where("how = 'inside'")), F.contains("term", F.col("piece")))
    starts, ends = edge("start", first).where(F.startswith("term", "piece")), edge("end", last).where(F.endswith("term", "piece"))
    return inside.union(starts.select(*inside.columns)).union(ends.select(*inside.columns))
