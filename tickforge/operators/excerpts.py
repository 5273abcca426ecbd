"""Excerpts of filings for a judge: the main section around its hits, and of the others the paragraphs with hits, under a budget of characters.

Nothing is written anew: an excerpt is made of stretches of the text in its order, and says what was left out. Lengths are code points.
A document's sections, sentences and hits meet in one row at the end; they are bounded by its own length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tickforge.functions import passages as ps

# The sections in order with their names, what stands for a gap, and the budgets in characters.
SECTIONS = {"business": ("事業の内容", "事業の内容"), "segment_info": ("セグメント情報", "セグメント"), "mda": ("経営者による財政状態、経営成績及びキャッシュ・フローの状況の分析", "MD&A"), "rnd": ("研究開発活動", "研究開発")}
MAIN, SUPPORT = "business", ["segment_info", "mda", "rnd"]
GAP = "（中略）"
WHOLE, LEAD, AROUND, SUPPORTED = 12_000, 3_000, 400, 8_000
HITS = "array<struct<start:int,end:int,terms:array<string>>>"


def _merged(intervals: Iterable[dict] | None) -> list[dict] | None:
    if intervals is None:
        return None
    out: list[dict] = []
    for start, end in sorted((x["start"], x["end"]) for x in intervals):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


@F.pandas_udf(ps.SPANS)
def merged(intervals: pd.Series) -> pd.Series:
    """Intervals (start, end) as few as they can be: those that overlap or touch become one, in order. A fold of built-in functions copies the list at each step."""
    return intervals.map(_merged)


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, stretches: pd.Series) -> pd.Series:
    # A built-in function would walk the text from its start for each stretch.
    return pd.Series([None if t is None else GAP.join(t[x["start"] : x["end"]] for x in xs) for t, xs in zip(texts, stretches, strict=True)], dtype=object)


def around(text: Column, hits: Column, whole: int = WHOLE, lead: int = LEAD, window: int = AROUND) -> Column:
    """A text of at most `whole` characters as it is; of a longer one its first `lead` and `window` on both sides of each hit (start, end), gaps marked."""
    size = F.char_length(text)
    # Stretches may reach over the end: a length taken for each hit would read the text again for each.
    wide = F.transform(hits, lambda h: F.struct(F.greatest(h["start"] - window, F.lit(0)).alias("start"), (h["end"] + window).alias("end")))
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(lead).alias("end")))
    return F.when(size <= whole, text).otherwise(_cut(F.when(size > whole, text), merged(F.when(size > whole, F.concat(first, wide)))))


def _with_hits(text: str, found: Iterable[dict]) -> list[dict]:
    spans, out = ps.paragraph_spans(text), []
    starts = [a for a, _ in spans]
    for h in found:
        i = bisect_right(starts, h["start"]) - 1
        if i < 0 or h["start"] >= spans[i][1]:
            continue
        if not out or out[-1]["i"] != i:
            out.append({"i": i, "text": text[slice(*spans[i])], "terms": []})
        out[-1]["terms"] += [t for t in h["terms"] if t not in out[-1]["terms"]]
    return out


@F.pandas_udf(ArrayType(StructType([StructField("i", IntegerType()), StructField("text", StringType()), StructField("terms", ArrayType(StringType()))])))
def with_hits(texts: pd.Series, found: pd.Series) -> pd.Series:
    """The paragraphs of a text that the sentences of hits (in order) begin in, by place, with the terms of each."""
    return pd.Series([[] if t is None else _with_hits(t, hs) for t, hs in zip(texts, found, strict=True)], dtype=object)


def _chosen(lengths: list[int], terms: list[list[str]], order: list[str], most: int) -> list[dict]:
    """Which paragraphs are taken, and how much of each (-1: whole): one for each term in any case, cut if need be, then what still fits, in order."""
    taken: dict[int, int] = {}
    used = 0
    for term in order:
        own = [i for i, ts in enumerate(terms) if term in ts]
        if not own or any(i in taken for i in own):
            continue
        left = max(0, most - used)
        if left and lengths[own[0]] <= left:
            taken[own[0]], used = -1, used + lengths[own[0]]
        else:
            taken[own[0]] = max(0, left - 1)
            used += min(lengths[own[0]], taken[own[0]]) + 1
    for i, n in enumerate(lengths):
        if i not in taken and 0 < most - used >= n:
            taken[i], used = -1, used + n
    return [{"i": i, "kept": taken[i]} for i in sorted(taken)]


def _choice(order: list[str], most: int):
    @F.pandas_udf("array<struct<i int, kept int>>")
    def choose(lengths: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([_chosen(list(n), [list(t) for t in ts], order, most) for n, ts in zip(lengths, terms, strict=True)])

    return choose


def hits(text: Column, vocabulary: dict[str, tuple[list[str], list[str]]]) -> Column:
    """The sentences of a text (start, end, terms) that have a word of a term and none of its exclusions; none for null."""

    def has(sentence: Column, term: str) -> Column:
        words, bars = vocabulary[term]
        out = F.lit(False)
        for w in words:
            out = out | (F.contains(sentence, F.lit(w)) & sentence.rlike(ps.word_pattern(w)))
        for w in bars:
            out = out & ~F.contains(sentence, F.lit(w))
        return F.when(out, term)

    terms = F.transform(ps.normal_sentences(text), lambda s: F.struct(s["start"], s["end"], F.array_compact(F.array(*(has(s["text"], t) for t in vocabulary))).alias("terms")))
    return F.coalesce(F.filter(terms, lambda s: F.size(s["terms"]) > 0), F.array().cast(HITS))


def judge_inputs(about: DataFrame, sections: DataFrame, vocabulary: dict[str, tuple[list[str], list[str]]], whole: int = WHOLE, lead: int = LEAD, window: int = AROUND, most: int = SUPPORTED) -> DataFrame:
    """(doc, state, summary, chars, truncated, used, omitted) of documents (doc, header) and their sections (doc, section, text).

    vocabulary: words and exclusions, in normal form, of each term, in order. A missing main section is an empty one.
    """
    found = sections.withColumn("hits", hits(F.col("text"), vocabulary))
    main = found.where(F.col("section") == MAIN).select("doc", F.coalesce("text", F.lit("")).alias("main"), "hits")
    place = F.array_position(F.array(*map(F.lit, SUPPORT)), F.col("section")).cast("int")
    support = found.where(F.col("section").isin(SUPPORT)).select("doc", place.alias("place"), with_hits("text", "hits").alias("p"))
    support = support.select("doc", F.transform("p", lambda p: F.struct(F.col("place"), p["i"].alias("i"), p["text"].alias("text"), p["terms"].alias("terms"))).alias("p"))
    support = support.groupBy("doc").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
    rows = about.select("doc", "header").join(main, "doc", "left").join(support, "doc", "left").withColumn("main", F.coalesce("main", F.lit("")))
    rows = rows.withColumns({"hits": F.coalesce("hits", F.array().cast(HITS)), "p": F.coalesce("p", F.array().cast("array<struct<place:int,i:int,text:string,terms:array<string>>>"))})
    rows = rows.withColumn("c", _choice(list(vocabulary), most)(F.transform("p", lambda p: F.char_length(p["text"])), F.transform("p", lambda p: p["terms"])))

    def piece(c: Column) -> Column:
        p = F.get("p", c["i"])
        text = F.when(c["kept"] < 0, p["text"]).otherwise(F.concat(F.substring(p["text"], F.lit(1), c["kept"]), F.lit("…")))
        return F.struct(p["place"].alias("place"), p["i"].alias("i"), text.alias("text"))

    rows = rows.withColumn("taken", F.transform("c", piece))
    truncated, long = F.char_length("main") > whole, lambda n: F.format_number(n.cast("long"), 0)

    def own_of(place: int) -> Column:
        return F.filter("taken", lambda t: t["place"] == place)

    def block(name: str, mine: Column) -> Column:
        # Beside each paragraph the one before it; the list of those is one longer, and the null at its end is not joined.
        before = F.concat(F.array(F.lit(None).cast("int")), F.transform(mine, lambda t: t["i"]))
        joined = F.array_join(F.zip_with(mine, before, lambda t, i: F.concat(F.when(t["i"] > i + 1, GAP).otherwise(""), t["text"])), "")
        return F.when(F.size(mine) > 0, F.concat(F.lit(f"【{SECTIONS[name][0]}（該当段落）】\n"), joined))

    rows = rows.withColumns({f"s{n}": own_of(n) for n in range(1, len(SUPPORT) + 1)})
    blocks = [block(name, F.col(f"s{n}")) for n, name in enumerate(SUPPORT, 1)]
    counts = [F.when(F.size(f"s{n}") > 0, F.concat(F.lit(SECTIONS[name][1]), long(F.size(f"s{n}")))) for n, name in enumerate(SUPPORT, 1)]
    excerpt = F.concat(F.lit(f"【{SECTIONS[MAIN][0]}】\n"), around(F.col("main"), F.col("hits"), whole, lead, window))
    state = F.concat_ws("\n\n", "header", excerpt, *blocks)
    places = F.when(truncated, F.size("hits")).otherwise(0)
    of_main = F.when(truncated, F.concat(F.lit("事業の内容 抜粋 冒頭"), long(F.lit(lead)), F.lit("字+該当"), long(places), F.lit("箇所（原文"), long(F.char_length("main")), F.lit("字）"))).otherwise(F.concat(F.lit("事業の内容 全文 "), long(F.char_length("main")), F.lit("字")))
    used, matched = F.size("taken"), F.size("p")
    left_out = F.when(matched > used, F.concat(F.lit("（該当"), long(matched), F.lit("段落中"), long(matched - used), F.lit("段落省略）"))).otherwise("")
    spent = F.aggregate("taken", F.lit(0), lambda s, t: s + F.char_length(t["text"]))
    of_support = F.when(used == 0, "補足 該当なし").otherwise(F.concat(F.lit("補足 "), F.concat_ws("・", *counts), F.lit("段落 "), long(spent), F.lit("字"), left_out))
    return rows.select("doc", state.alias("state"), F.concat_ws("／", of_main, of_support).alias("summary"), F.char_length("main").alias("chars"), truncated.alias("truncated"), used.alias("used"), (matched - used).alias("omitted"))
