"""Passages against plain loops over characters."""

import random
import unicodedata

from pyspark.sql import functions as F

from tickforge.functions import passages as ps

TEXTS = [None, "", " ", "a", "。", "一文。二文！？三文", "行\r\n二\r三\n\n四", "前文 ・項目 ●別", "x" * 1000 + "。" + "y" * 30, "(1) 項 (23)項", " 　末 　", "ー―ー", "カ―‐b―カ"]


def some_texts(n=200):
    rng = random.Random(7)
    return TEXTS + ["".join(rng.choice("ab 。！?\n・①カリー―-～ｰ　Ａ(1)") for _ in range(rng.randrange(60))) for _ in range(n)] + ["".join(rng.choice("あいう。 ・") for _ in range(3000))]


def cut(text):
    ends, blanks, out, start, i = "。！？!?", " \t\n\r　", [], 0, 0
    heads = "・●■" + "".join(map(chr, range(ord("①"), ord("⑳") + 1)))
    while i < len(text):
        if i > start and text[i - 1] in blanks:
            inside = text[i + 1 : i + 5]
            close = min((inside.index(c) for c in ")）" if c in inside), default=0)
            if text[i] in heads or text[i] in "(（" and 1 <= close <= 3 and all(c in "0123456789０１２３４５６７８９" for c in inside[:close]):
                out.append((start, i))
                start = i
        if text[i] in "\r\n" or text[i] in ends and text[i + 1 : i + 2] not in [*ends]:
            out.append((start, i + 1))
            start = i + 1
        i += 1
    out.append((start, len(text)))
    return trimmed(text, out)


def trimmed(text, spans):
    out = []
    for a, b in spans:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def paragraphs(text, most=400):
    if "\n" in text or "\r" in text:
        spans, start = [], 0
        for i, c in enumerate(text + "\n"):
            if c in "\r\n":
                spans.append((start, i))
                start = i + 1
        return trimmed(text, spans)
    out = []
    for a, b in cut(text):
        if out and b - out[-1][0] <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def normal(text):
    text, out = unicodedata.normalize("NFKC", text.replace("™", "").replace("℠", "")), ""
    kana = lambda c: c != "" and ("゠" <= c <= "ヿ" or "ㇰ" <= c <= "ㇿ")
    for i, c in enumerate(text):
        out += ("ー" if kana(out[-1:]) or kana(text[i + 1 : i + 2]) else "-") if c in ps.DASHES else c
    words = []
    for c in out:
        blank = c.isspace() or c == "﻿"
        if not (blank and words and words[-1] == " "):
            words.append(" " if blank else c.lower() if c.isascii() else c)
    return "".join(words)


def test_sentences_paragraphs_and_normal_forms(spark):
    texts = some_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", ps.sentences(F.col("text")).alias("s"), ps.paragraphs(F.col("text")).alias("p"), ps.normal(F.col("text")).alias("n"), ps.ngrams(F.col("text")).alias("g")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.i]
        if text is None:
            assert (r.s, r.p, r.n) == (None, None, None)
            continue
        assert r.s == [text[a:b] for a, b in cut(text)], text
        assert [tuple(x) for x in r.p] == paragraphs(text), text
        assert r.n == normal(text), text
        assert r.g == ([text[i : i + 2] for i in range(max(len(text) - 1, 1))] if text else [])


def test_words_stand_for_themselves(spark):
    cases = [("ec site", "ec", True), ("tech", "ec", False), ("ec2", "ec", False), ("oec ec", "ec", True), ("リソース", "ソース", False), ("新ソース", "ソース", True), ("リース", "リー", False), ("半導体装置", "半導体", True), ("オートリースカー", "オートリース", True)]
    for text, word, there in cases:
        got = spark.range(1).select(ps.words_in(F.lit(text), [word]).alias("w")).first().w
        assert got == ([word] if there else []), (text, word)


def test_clippings(spark):
    rows = [("short", "or"), ("x" * 500, "zz"), ("a" * 10 + "KEY" + "b" * 500, "KEY"), ("a" * 500 + "KEY", "KEY"), ("a" * 400 + "KEY" + "b" * 400, "KEY")]
    got = [r.c for r in spark.createDataFrame(rows, "t string, w string").select(ps.clipped(F.col("t"), F.col("w")).alias("c")).collect()]
    assert got[0] == "short" and got[1] == "…" + "x" * 300 + "…"
    assert got[2].startswith("a" * 10 + "KEY") and got[2].endswith("b…") and got[3].endswith("aKEY") and got[3].startswith("…a")
    assert got[4] == "…" + "a" * 148 + "KEY" + "b" * 148 + "…"
