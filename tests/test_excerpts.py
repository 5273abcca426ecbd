"""Excerpts for a judge against plain loops: made texts under small budgets, and whole documents of the tables."""

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tickforge.functions import passages as ps
from tickforge.operators import excerpts

END = "。！？!?"


def spans(text):
    """Sentences by walking the characters."""
    out, start = [], 0
    for i in range(1, len(text) + 1):
        last = i == len(text)
        cut = last or (text[i - 1] in END and text[i] not in END) or text[i - 1] in "\r\n" or ((text[i - 1].isspace() or text[i - 1] == "　") and re.match(ps.ITEM, text[i:]))
        if cut:
            piece = text[start:i]
            if piece.strip():
                out.append((start + len(piece) - len(piece.lstrip()), start + len(piece.rstrip())))
            start = i
    return out


def lines(text):
    if "\n" in text or "\r" in text:
        pieces = [(m.start(), m.group()) for m in re.finditer(r"[^\r\n]+", text)]
        return [(a + len(p) - len(p.lstrip()), a + len(p.rstrip())) for a, p in pieces if p.strip()]
    out = []
    for a, b in spans(text):
        if out and b - out[-1][0] <= 400:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def has(sentence, words, bars):
    s = " ".join(unicodedata.normalize("NFKC", sentence).lower().split())
    whole = lambda w: re.search((r"(?<![a-z0-9])" if w[0].isascii() else "") + re.escape(w) + (r"(?![a-z0-9])" if w[-1].isascii() else ""), s)
    return any(whole(w) for w in words) and not any(b in s for b in bars)


def plain(header, sections, vocabulary, whole, lead, window, most):
    hits = {k: [(a, b, [t for t, (ws, bs) in vocabulary.items() if has(x[a:b], ws, bs)]) for a, b in spans(x)] for k, x in sections.items() if x}
    hits = {k: [h for h in v if h[2]] for k, v in hits.items()}
    main = sections.get("business") or ""
    found = hits.get("business", [])
    if len(main) <= whole:
        excerpt, short = main, False
    else:
        keep = [i < lead for i in range(len(main))]
        for a, b, _ in found:
            for i in range(max(0, a - window), min(len(main), b + window)):
                keep[i] = True
        excerpt, short = "", True
        for i, c in enumerate(main):
            if keep[i]:
                excerpt += ("（中略）" if i and not keep[i - 1] and excerpt else "") + c
    paragraphs = []
    for k in excerpts.SUPPORT:
        for i, (a, b) in enumerate(lines(sections.get(k) or "")):
            terms = {t for s, _, ts in hits.get(k, []) if a <= s < b for t in ts}
            if terms:
                paragraphs.append((k, i, sections[k][a:b], terms))
    taken, used = {}, 0
    for term in vocabulary:
        if any(term in paragraphs[j][3] for j in taken):
            continue
        first = next((j for j, p in enumerate(paragraphs) if term in p[3]), None)
        if first is not None:
            text, left = paragraphs[first][2], most - used
            taken[first] = text if 0 < left >= len(text) else text[: max(0, max(0, left) - 1)] + "…"
            used += len(taken[first])
    for j, p in enumerate(paragraphs):
        if j not in taken and most - used > 0 and len(p[2]) <= most - used:
            taken[j] = p[2]
            used += len(p[2])
    blocks = [header, "【事業の内容】\n" + excerpt]
    counts = []
    for k in excerpts.SUPPORT:
        own = [j for j in sorted(taken) if paragraphs[j][0] == k]
        if own:
            text = "".join(("（中略）" if n and paragraphs[j][1] > paragraphs[own[n - 1]][1] + 1 else "") + taken[j] for n, j in enumerate(own))
            blocks.append(f"【{excerpts.SECTIONS[k][0]}（該当段落）】\n{text}")
            counts.append(f"{excerpts.SECTIONS[k][1]}{len(own):,}")
    of_main = f"事業の内容 抜粋 冒頭{lead:,}字+該当{len(found):,}箇所（原文{len(main):,}字）" if short else f"事業の内容 全文 {len(main):,}字"
    left = len(paragraphs) - len(taken)
    of_support = "補足 該当なし" if not taken else f"補足 {'・'.join(counts)}段落 {used:,}字" + (f"（該当{len(paragraphs):,}段落中{left:,}段落省略）" if left else "")
    return "\n\n".join(blocks), f"{of_main}／{of_support}", len(main), short, len(taken), left


VOCABULARY = {"a": (["alpha", "半導体"], ["not"]), "b": (["beta"], []), "c": (["gamma", "ec"], []), "none": (["nowhere"], [])}
BUDGETS = {"whole": 120, "lead": 30, "window": 12, "most": 60}


def test_excerpts_equal_plain_loops(spark):
    draw = random.Random(4)
    words = ["alpha", "ＡＬＰＨＡ", "beta", "gamma", "x", "yy", "not", "EC", "ecx", "半導体", "日本。", "end.", "stop!", "\n", "。", "・項目", "  "]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    made = [(d, k, text(draw.randrange(0, 70))) for d in range(60) for k in excerpts.SECTIONS if draw.random() < 0.8] + [(60, "business", None), (61, "mda", "beta。" + "y" * 90 + "。alpha")]
    about = [(d, f"書類{d}") for d in range(63)]
    got = excerpts.judge_inputs(spark.createDataFrame(about, "doc long, header string"), spark.createDataFrame(made, "doc long, section string, text string").repartition(3), VOCABULARY, **BUDGETS).collect()
    assert len(got) == 63
    of = {}
    for d, k, t in made:
        of.setdefault(d, {})[k] = t
    for r in got:
        assert tuple(r)[1:] == plain(f"書類{r.doc}", of.get(r.doc, {}), VOCABULARY, **BUDGETS), r.doc


def test_whole_documents_of_the_tables(spark, sf):
    from tickforge.plans.passages import VOCABULARY as terms
    from tickforge.plans.passages import judge_inputs

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").where("turn < 3").collect():
        turns.setdefault(r.conv_id, {})[excerpts.SUPPORT[r.turn]] = r.text
    got = judge_inputs(spark, sf).collect()
    assert sorted(r.doc for r in got) == sorted(docs)
    long = 0
    for r in got:
        d = docs[r.doc]
        want = plain(f"銘柄コード: {d.source}\n書類ID: {r.doc}\n書類種別: {d.lang}", {"business": d.text, **turns.get(r.doc, {})}, terms, excerpts.WHOLE, excerpts.LEAD, excerpts.AROUND, excerpts.SUPPORTED)
        assert tuple(r)[1:] == want, r.doc
        long += r.truncated
    assert long


def test_a_long_document_takes_no_time_that_grows_with_its_square(spark):
    n = 2500
    of = {"business": ("x" * 990 + "。alpha gamma。") * n, "mda": "beta\nxx\n" * n, "rnd": "not alpha\ngamma\n" * n}
    frames = spark.createDataFrame([(1, "h")], "doc long, header string"), spark.createDataFrame([(1, k, t) for k, t in of.items()], "doc long, section string, text string")
    began = time.time()
    got = excerpts.judge_inputs(*frames, VOCABULARY).first()
    assert time.time() - began < 40
    assert tuple(got)[1:] == plain("h", of, VOCABULARY, excerpts.WHOLE, excerpts.LEAD, excerpts.AROUND, excerpts.SUPPORTED)


def test_sentences_are_made_once_and_stay_with_their_text(spark, sf):
    from tickforge.plans.passages import judge_inputs

    plan = judge_inputs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    # Once for documents, and for turns that are a main section (there are none) or another one.
    assert plan.count("normal_sentences(") == 3


@pytest.mark.parametrize("text", ["", "。", "a!?b", "x\r\ny。・z (12)q ①", "　(３)「・", "Ａ ・。！\n●", "no end", "é。\u3000（1）é", "\n\n・"])
def test_breaks_are_those_of_one_pattern(text):
    assert sorted(set(ps._breaks(text))) == [m.start() for m in ps.BREAK.finditer(text)]


@pytest.mark.parametrize("given, want", [([(0, 3), (3, 5), (7, 9)], [(0, 5), (7, 9)]), ([(4, 6), (0, 9)], [(0, 9)]), ([], []), ([(2, 2), (1, 1)], [(1, 1), (2, 2)])])
def test_merged_intervals(spark, given, want):
    frame = spark.createDataFrame([(given,)], "x array<struct<start:int,end:int>>")
    assert [tuple(x) for x in frame.select(excerpts.merged(F.col("x")).alias("m")).first().m] == want
