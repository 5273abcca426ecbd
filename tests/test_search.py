"""Search: strings of one word, and how needs meet terms."""

import os

from pyspark.sql import functions as F

from tickforge.operators import search
from tickforge.operators.search import TextIndex


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_string_of_one_word_is_answered_by_postings_alone(spark, tmp_path):
    texts = [(i, f"pre{'word' if i % 3 else 'other'}s, w{i} 日本{'語' if i % 2 else '人'}" + " word" * (i % 5)) for i in range(60)]
    index = TextIndex(spark, str(tmp_path / "i"), span=25, buckets=4).build(spark.createDataFrame(texts, "id long, text string"))
    index.table("texts").withColumn("text", F.lit("")).write.partitionBy("part").parquet(str(tmp_path / "blank"))
    os.rename(tmp_path / "i" / "texts", tmp_path / "read")
    os.rename(tmp_path / "blank", tmp_path / "i" / "texts")
    asked = {0: "word", 1: "W1", 2: "語", 3: "nowhere", 4: "rewor"}
    got = rows(index.found(spark.createDataFrame(list(asked.items()), "q long, string string")))
    assert got == sorted(((q, i) for q, s in asked.items() for i, t in texts if s.lower() in t.lower()), key=repr)


def test_needs_are_met_by_terms_of_any_length(spark):
    terms = ["a", "aa", "abcab", "日本", "x" * 70 + "ab", "ab" + "y" * 100, "éz"]
    needs = [(how, piece) for how in ("start", "end", "inside") for piece in ("a", "ab", "b", "本", "x" * 66, "z", "nothing")]
    frame = spark.createDataFrame([(f"{how}:{piece}", piece, how) for how, piece in needs], "need string, piece string, how string")
    meets = {"start": str.startswith, "end": str.endswith, "inside": str.__contains__}
    got = rows(search._met(spark.createDataFrame([(t,) for t in terms], "term string"), frame).select("term", "need"))
    assert got == sorted(((t, f"{how}:{piece}") for t in terms for how, piece in needs if meets[how](t, piece)), key=repr)
    assert search._met(spark.createDataFrame([("a",)], "term string"), frame.limit(0)).count() == 0


def test_terms_are_the_same_with_and_without_unspaced_scripts(spark):
    texts = ["ab c1-é_x ünder", "ab 日本語 c", "カナー名 x", "②Ⅳ áb", "ﾊﾝ ｶｸ", "😀 a", "𠮟る", "", "⺀々〇", "한글 ก", "⹿ a"]
    frame = spark.createDataFrame([(t,) for t in texts], "low string")
    tokens = F.transform(search._tokens(F.col("low")), lambda t: F.when(search._unspaced(t), search._pairs(t)).otherwise(F.array(t)))
    for got in frame.select(search.terms_of(F.col("low")).alias("terms"), F.array_distinct(F.flatten(tokens)).alias("plain")).collect():
        assert got.terms == got.plain
