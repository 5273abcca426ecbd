"""Language ID, quality rules, PII, SentencePiece, packing, line dedup, token counts and toxicity."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.llm import language_id, line_dedup, packing, pii, quality_rules, sentencepiece_codec, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


ODD = [None, "", " \n\t ", "é☃你​", "x" * 100_000, "a b c " * 5000, "<|endoftext|> Hi", "A\r\nB\x0bC\x00"]


def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(ODD)] + [(None, "null id here", "x", 1.0)], "doc_id long, text string, lang string, score double")


# Language ID


def brute_phrases(text, corpus):
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in corpus:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


@pytest.mark.parametrize("width", [8, 1000])
def test_parse_equals_brute_force(width):
    """Dense and hashed automata, texts of less than a window, of a window's length and of many windows."""
    draw = np.random.default_rng(1)
    letter = "".join(map(chr, range(0x4E00, 0x4E00 + width - 2)))
    steps = language_id.Steps(language_id.automaton(corpus := draw.integers(2, width, 3000).tolist()), width)
    joined = "".join(letter[c - 2] for c in corpus)
    stretch = lambda n: "".join(joined[i : i + int(draw.integers(1, 400))] + letter[int(draw.integers(0, width - 2))] for i in draw.integers(0, 2900, n))
    texts = ["", joined[5:60], joined[:256], stretch(3), stretch(40), joined * 2, "z" * 300 + stretch(9)]
    cut = language_id.Windows(texts)
    symbols = np.array([ord(c) for c in letter])
    got = cut.phrases(cut.board(language_id.classes(symbols)), steps)
    assert got.tolist() == [brute_phrases(t, joined) for t in texts]


@pytest.mark.parametrize("width", [8, 1000])
def test_texts_without_letters_are_parsed_in_order(width):
    """Figures are a cycle that windows never fall in step with: exact against brute force, and 200,000 of them in under a second."""
    draw = np.random.default_rng(5)
    letter = "".join(map(chr, range(0x4E00, 0x4E00 + width - 2)))
    corpus = [s for run in (7, 11, 3) for s in (*draw.integers(2, width, 40).tolist(), *[language_id.OTHER] * run)]
    joined = "".join("1" if c == language_id.OTHER else letter[c - 2] for c in corpus)
    steps = language_id.Steps(language_id.automaton(corpus), width)
    table = language_id.classes(np.array([ord(c) for c in letter]))
    texts = ["1" * 9000, "1234 " * 900 + joined[:50] + "1" * 3000, joined * 3, "1" * 65 + joined[3:30], "", "12 " + letter[0]]
    cut = language_id.Windows(texts)
    assert cut.phrases(cut.board(table), steps).tolist() == [brute_phrases("".join("1" if c not in letter else c for c in t), joined) for t in texts]
    assert [language_id.phrases_of(table[language_id.points(t)], steps) for t in texts] == cut.phrases(cut.board(table), steps).tolist()
    began = time.time()
    cut = language_id.Windows(["1234 " * 40_000, "7" * 200_000])
    cut.phrases(cut.board(table), steps)
    assert time.time() - began < 2


def test_languages_of_many_letters_and_text_behind_a_long_head(spark):
    draw = np.random.default_rng(2)
    scripts = {"aa": [chr(0x4E00 + i) for i in range(600)], "bb": [chr(0x4E00 + i) for i in range(300, 900)], "cc": list("abcdefghij")}
    words = {lang: ["".join(draw.choice(own, int(draw.integers(1, 4)))) for _ in range(400)] for lang, own in scripts.items()}
    text = lambda lang, n: "".join(draw.choice(words[lang], n))
    # Every text begins alike; what tells its language comes after 5,000 characters.
    rows = [(i, "0 " * 2500 + text(lang, 300), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    got = language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.95 * len(held)
    again = language_id.identified(spark.createDataFrame([*rows, *rows[:5], (None, text("cc", 50), "cc")], "doc_id long, text string, lang string"))
    assert again.count() == len(rows) + 6


def test_language_accuracy_on_held_out(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language_id.op2(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_language_edge_cases(spark):
    rows = odd(spark).withColumn("lang", F.lit("xx"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identified(rows).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[4][0] == "xx"
    unlabelled = language_id.identified(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    assert language_id.identified(odd(spark).limit(0)).collect() == []


# Quality rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


def test_quality_counts(spark, docs):
    rows = docs + [(10**6 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judged(df, labels).collect()}
    for doc, text in rows:
        want = brute_counts(text)
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, doc
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_binomial_bound_and_path():
    exact = sum(math.comb(200, i) * 0.02**i * 0.98 ** (200 - i) for i in range(3))
    assert abs(quality_rules.binomial_tail(2, 200, 0.02) - exact) < 1e-12
    # Kinds: plain good ones, bad ones far over rule 0, mixed ones over rule 1.
    over, good, bad = np.array([[0, 0], [9, 0], [0, 5], [3, 0]]), np.array([900, 0, 60, 40]), np.array([5, 30, 20, 1])
    steps = quality_rules.path(over, good, bad, 0.05)
    assert steps[0] == (8, quality_rules.STEPS) and steps[1] == (8, 4) and len(steps) == 2  # the second loses six in a hundred
    assert quality_rules.certified(steps, over, good, 0.05, 0.01) == steps[0]
    assert quality_rules.certified(steps, over[:1], np.array([79]), 0.05, 0.05 / 3) is None  # 79 prove nothing, 80 do
    assert quality_rules.certified(steps, over[:1], np.array([80]), 0.05, 0.05 / 3) == steps[1]


def quality_frame(n, seed):
    """Texts of 60 to 150 words; bad ones hold many symbols, good ones hardly any."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        good = bool(draw.random() < 0.7)
        words = [f"w{x}" for x in draw.integers(0, 10**6, int(draw.integers(60, 150)))]
        for at in range(0, len(words), 3 if not good and draw.random() < 0.9 else 40 if draw.random() < 0.1 else 1000):
            words[at] += "###"
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_certified_rules_hold_on_rows_they_never_saw(spark):
    seen, fresh = quality_frame(900, 1), quality_frame(1500, 2)
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in seen] + [(10_000 + i, t, "x") for i, t, _ in fresh], "doc_id long, text string, rule string")
    labels = spark.createDataFrame([(i, q) for i, _, q in seen], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judged(frame, labels).collect()}
    good = [got[10_000 + i] for i, _, q in fresh if q]
    bad = [got[10_000 + i] for i, _, q in fresh if not q]
    assert sum(not r["kept"] for r in good) <= 0.05 * len(good) and sum(r["rule"] == "symbols" for r in bad) > 0.7 * len(bad)
    # Brute force: the same path and tests over single documents.
    half = {r["doc_id"]: r["h"] for r in spark.range(900).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit("half")), F.lit(3)) == 0).alias("h")).collect()}
    kinds = {}
    for i, text, q in seen:
        n, chars, symbols, dup, rep = brute_counts(text)
        scores = [symbols / max(chars, 1), dup, rep / max(n, 1), chars / max(n, 1)]
        kinds[i] = [sum(s > c for c in cuts) for s, (_, cuts) in zip(scores, quality_rules.RULES.values(), strict=True)]
    part = lambda h: ([kinds[i] for i, _, _ in seen if half[i] == h], [q for i, _, q in seen if half[i] == h])
    (a, qa), (b, qb) = part(True), part(False)
    steps = quality_rules.path(np.array(a), np.array(qa), 1 - np.array(qa), 0.05)
    state = quality_rules.certified(steps, np.array(b), np.array(qb), 0.05, 0.05 / 3)
    assert state is not None
    for i, text, _ in seen:
        assert got[i]["kept"] == (not any(k > c for k, c in zip(kinds[i], state, strict=True)))


def test_quality_labels_that_clash_or_repeat(spark):
    rows = quality_frame(400, 3)
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (0, rows[0][1]), (0, None)], "doc_id long, text string")
    labels = [(i, q) for i, _, q in rows]
    plain = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.judged(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert plain[None, 0] is False and plain[0, 0] is False
    clash = spark.createDataFrame([x for i, q in labels for x in ((i, q), (i, 1 - q))] + [(None, 1), (1, None)], "doc_id long, quality int")
    assert {r["rule"] for r in quality_rules.judged(frame, clash).collect()} == {None, "base"}
    assert quality_rules.judged(frame.limit(0), clash).collect() == []


def test_rules_act_on_the_table(spark):
    rules = Counter(r["rule"] for r in quality_rules.op3(spark, "/root/testdata/sf0.01").collect())
    assert set(rules) - {None, "base"}


# PII


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19:
            total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d)))
            if total % 10 == 0:
                out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TRICKY = [
    "a.b@c.de and x@y, z@@q.com 1@2.3.4 a@b-.c", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3", "4111 1111-1111 1111 and 4111111111111112 12-34", "+49 (30) 123456-7 +1 2 +123456789012345678",
    "+1.2.3.4.5.6.7.8.9 @a.b %@x.y 4 4 4 4 4 4 4 4 4 4 4 4", "ñ@x.com é1.2.3.4", "5500 0000 0000 0004 5500 0000 0000 0004", "a@b.c@d.e.f", "1..2.3.4 10.0.0.256.1.1.1.1",
]


def test_base_spans_equal_the_patterns(docs):
    for text in [t or "" for _, t in docs] + TRICKY + [t or "" for t in ODD]:
        assert pii.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize(
    "text,kind,covered",
    [
        ("write to jane dot doe at example dot com today", "email", "jane dot doe at example dot com"),
        ("write to jane [at] example [dot] org now", "email", "jane [at] example [dot] org"),
        ("mail jаne@exаmple.com please", "email", "jаne@exаmple.com"),
        ("call plus four nine three zero one two three four five six seven now", "phone", "plus four nine three zero one two three four five six seven"),
        ("ip ten: 192 dot 168 dot 1 dot 20 end", "ip", "192 dot 168 dot 1 dot 20"),
        ("full width ４１１１１１１１１１１１１１１１ card", "card", "４１１１１１１１１１１１１１１１"),
    ],
)
def test_disguises_map_to_source_characters(text, kind, covered):
    base, new = pii.spans_of(text)
    found = {(pii.KINDS[k], text[s:e]) for s, k, e in base + new}
    assert (kind, covered) in found


@pytest.mark.parametrize(
    "text,kind,covered",
    [
        ("call plus 49 one seven zero 1234567 now", "phone", "plus 49 one seven zero 1234567"),
        ("call plus 49 30 1234567 now", "phone", "plus 49 30 1234567"),
        ("call plus 49 30 12345 six 7 now", "phone", "plus 49 30 12345 six 7"),
        ("host 192 dot 168 dot one dot five end", "ip", "192 dot 168 dot one dot five"),
        ("host 10 dot 20 dot 30 dot four end", "ip", "10 dot 20 dot 30 dot four"),
        ("card 4111 1111 1111 one one one 1 end", "card", "4111 1111 1111 one one one 1"),
        ('ring: "plus four nine; no, plus four nine three zero one two three four five"', "phone", "plus four nine three zero one two three four five"),
        ("write to jane.doe at example.com today", "email", "jane.doe at example.com"),
        ("écrire à jane arobase exemple.fr vite", "email", "jane arobase exemple.fr"),
        ("a jane arroba mail.ejemplo.es hoy", "email", "jane arroba mail.ejemplo.es"),
        ("ask jane four two at example dot com now", "email", "jane four two at example dot com"),
        ("ask jane four two [at] example.com now", "email", "jane four two [at] example.com"),
        ("ask 𝐣𝐚𝐧𝐞@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦 now", "email", "𝐣𝐚𝐧𝐞@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦"),
        ("ask ⓙⓐⓝⓔ at ⓔⓧⓐⓜⓟⓛⓔ dot com now", "email", "ⓙⓐⓝⓔ at ⓔⓧⓐⓜⓟⓛⓔ dot com"),
        ("call +⁴⁹ ³⁰ one two three four five six now", "phone", "+⁴⁹ ³⁰ one two three four five six"),
        ("host 192 dot 168 dot ① dot five end", "ip", "192 dot 168 dot ① dot five"),
    ],
)
def test_few_spelled_digits_and_bare_at(text, kind, covered):
    base, new = pii.spans_of(text)
    assert {(pii.KINDS[k], text[s:e]) for s, k, e in base + new} == {(kind, covered)}


def test_prose_with_few_spelled_digits_and_at_is_left_alone():
    for text in ("find us at example.com today", "one or 2 of 3000 came, plus 1500 more", "at 9.30 we met at work.then left", "une ou deux fois, un 12 mai, trois 4"):
        assert pii.spans_of(text) == ([], [])


def test_plain_prose_is_left_alone():
    for text in ("we met at noon. dot the i at home", "two or three of four five people", "she looked at the point and left", "version 1.2.3 of 2024"):
        assert pii.spans_of(text) == ([], [])


def test_planted_disguises_are_found():
    """Recall over made disguises of each kind, at random places of prose, and no other span."""
    draw = np.random.default_rng(6)
    names, homes = ["jane", "joe.doe", "m_smith", "anna"], ["example.com", "mail.example.org", "firma.de"]
    prose = "the river ran under the old bridge and nobody came to see it".split()
    style = lambda t, base: "".join(chr(base + ord(c) - 97) if c.islower() else c for c in t)
    words = {v: k for k, v in [*pii.SPELLED.items()][:10]}
    spell = lambda digits: " ".join(words[d] for d in digits)
    found = made = 0
    for _ in range(400):
        name, home = str(draw.choice(names)), str(draw.choice(homes))
        number = "49" + "".join(map(str, draw.integers(0, 10, 9)))
        kind, text = [
            ("email", f"{name.replace('.', ' dot ')} at {home.replace('.', ' dot ')}"), ("email", f"{name} [at] {home.replace('.', ' [dot] ')}"), ("email", f"{name}@{home}".replace("a", "а").replace("e", "е")),
            ("email", style(f"{name}@{home}", 0x1D41A)), ("email", f"{name}\u200b@\u200b{home}"), ("phone", f"plus {spell(number)}"), ("phone", f"＋{number}"), ("ip", " dot ".join(str(x) for x in draw.integers(1, 256, 4))),
        ][int(draw.integers(0, 8))]
        before, after = " ".join(draw.choice(prose, 5)), " ".join(draw.choice(prose, 5))
        base, new = pii.spans_of(f"{before}, {text}; {after}")
        made += 1
        found += [(pii.KINDS[k], s, e) for s, k, e in sorted(base + new)] == [(kind, len(before) + 2, len(before) + 2 + len(text))]
    assert found >= 0.98 * made, (found, made)


def test_pii_query(spark, docs):
    rows = docs + [(10**6 + i, t) for i, t in enumerate(ODD + TRICKY)]
    got = {r["doc_id"]: r for r in pii.found(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_email int")).collect()}
    for doc, text in rows:
        spans = brute_spans(text or "")
        r = got[doc]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        own = [x for x in r["spans"].split(",") if x]
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans} <= set(own)
    cleaned = pii.redact(spark.createDataFrame([(1, "mail a@b.co or +49 30 1234567"), (2, None)], "doc_id long, text string")).collect()
    assert [r["text"] for r in cleaned] == ["mail <email> or <phone>", None]
    again = pii.found(spark.createDataFrame([(None, "a@b.co"), (None, "a@b.co"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in again) == [("3", 0, ""), ("None", 1, "email:0:6"), ("None", 1, "email:0:6")]
    assert pii.found(spark.createDataFrame([], "doc_id long, text string, spans string")).collect() == []


# SentencePiece


def all_segmentations(text, path):
    words = sentencepiece_codec.vocabulary(path)
    ids = {b.decode(): i for i, b in enumerate(words.surface) if b and not (i in words.bytes_of)}
    text = " " + text

    def rest(i):
        if i == len(text):
            return [((), 1.0)]
        return [((ids[text[i:j]], *tail), words.weights[ids[text[i:j]]] * w) for j in range(i + 1, min(len(text), i + 16) + 1) if text[i:j] in ids for tail, w in rest(j)]

    found = rest(0)
    total = sum(w for _, w in found)
    return {k: w / total for k, w in found}


def test_samples_follow_the_lattice():
    path = tokens.vocabulary_path(sentencepiece_codec.MODEL)
    want = all_segmentations("a to", path)
    first, second, weighted, n = Counter(), Counter(), Counter(), 4000
    for own in sentencepiece_codec.segmented(["a to"] * n, sentencepiece_codec.row_keys(list(range(n))), path, 3):
        picks = [tuple(ids.tolist()) for ids, *_ in own]
        assert len(set(picks)) == 3 and [o[2] for o in own] == sorted((o[2] for o in own), reverse=True)
        assert all(abs(math.exp(o[1]) - want[p]) < 1e-9 for o, p in zip(own, picks, strict=True))
        first[picks[0]] += 1
        second[picks[1]] += 1
        for o, p in zip(own, picks, strict=True):
            weighted[p] += math.exp(o[1]) / o[3] / n
    for k, p in want.items():
        then = sum(q * p / (1 - q) for j, q in want.items() if j != k)
        assert abs(first[k] / n - p) < 0.03 and abs(second[k] / n - then) < 0.03
    assert abs(sum(weighted.values()) - 1) < 0.02  # inclusion scores make sums unbiased


def test_every_segmentation_comes_once():
    path = tokens.vocabulary_path(sentencepiece_codec.MODEL)
    want = all_segmentations("tha", path)
    (own,) = sentencepiece_codec.segmented(["tha"], sentencepiece_codec.row_keys([9]), path, 100)
    assert {tuple(o[0].tolist()) for o in own} == set(want) and len(own) == len(want)


def test_long_units_keep_every_edge():
    """A unit of thousands of letters: node by node, the chances are those of an exact recursion over all edges."""
    path = tokens.vocabulary_path(sentencepiece_codec.MODEL)
    words = sentencepiece_codec.vocabulary(path)
    weight = {b.decode(): words.weights[i] for i, b in enumerate(words.surface) if b and i not in words.bytes_of}
    draw = np.random.default_rng(8)
    text = "".join(draw.choice(list("thequickbrownfox"), 3000)) + "鿕" * 40  # the last letter is no piece
    units = sentencepiece_codec.Units(words, [text])
    lattice = sentencepiece_codec.Lattice(words, units.codes, units.sizes)
    assert len(units.sizes) == 1
    whole = " " + text
    byte = math.prod(words.weights[words.bytes_of[b]] for b in "鿕".encode())
    behind = [0.0] * len(whole) + [0.0]  # logarithms
    for i in range(len(whole) - 1, -1, -1):
        terms = [math.log(weight[whole[i:j]]) + behind[j] for j in range(i + 1, min(len(whole), i + words.longest) + 1) if whole[i:j] in weight]
        terms = terms or [math.log(byte) + behind[i + 1]]
        behind[i] = max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))
    for i in (0, 1, 63, 64, 65, 1000, 2990):
        own = range(int(lattice.first[i]), int(lattice.first[i + 1]))
        assert abs(sum(lattice.chance[e] for e in own) - 1) < 1e-9
        for e in own:
            j = int(lattice.to[e])
            assert abs(lattice.chance[e] - math.exp(math.log(weight[whole[i:j]]) + behind[j] - behind[i])) < 1e-9
    (samples,) = sentencepiece_codec.segmented([text], sentencepiece_codec.row_keys([1]), path, 2)
    assert all(sentencepiece_codec.decoded(ids, path).decode() == text for ids, *_ in samples) and samples[0][0].tolist() != samples[1][0].tolist()


def test_round_trip(spark, docs):
    path = tokens.vocabulary_path(sentencepiece_codec.MODEL)
    rows = docs[:60] + [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, "null id")]
    coded = sentencepiece_codec.encoded(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string"), path, 3)
    assert all(r["round_trip"] for r in coded.select("round_trip").collect())
    back = defaultdict(list)
    for r in sentencepiece_codec.texts_of(coded, path).collect():
        back[r["doc_id"]].append(r["text"])
    assert all(t == (text or "") for doc, text in rows for t in back[doc]) and set(back) == {d for d, _ in rows}
    assert sentencepiece_codec.encoded(spark.createDataFrame([], "doc_id long, text string, sample int"), path).collect() == []
    again = sentencepiece_codec.encoded(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), path, 3)
    assert sorted(map(str, coded.drop("ids").collect())) == sorted(map(str, again.drop("ids").collect()))


def test_added_finds_equal_plain_loops():
    draw = np.random.default_rng(2)
    for _ in range(300):
        span = lambda: (a := int(draw.integers(0, 60)), a + int(draw.integers(1, 15)))
        taken = [span() for _ in range(int(draw.integers(0, 5)))]
        finds = [(int(draw.integers(0, 4)), *span()) for _ in range(int(draw.integers(0, 25)))]
        new = []
        for kind, s, e in finds:
            inside = [x for x in new if s <= x[0] and x[2] <= e]
            if all(e <= a or s >= b for a, b in taken) and all(x in inside or e <= x[0] or s >= x[2] for x in new):
                new = [x for x in new if x not in inside] + [(s, kind, e)]
        assert sorted(pii.apart(finds, taken)) == sorted(new)


def test_a_text_with_50_000_spans_takes_seconds():
    began = time.time()
    base, new = pii.spans_of("\n".join(f"10.0.{i % 256}.{i % 200} user{i}@host.example.com GET" for i in range(25_000)))
    assert (len(base), len(new)) == (50_000, 0)
    base, new = pii.spans_of("\n".join(f"user{i} [at] host{i} [dot] com" for i in range(25_000)))
    assert (len(base), len(new)) == (0, 25_000)
    base, new = pii.spans_of("1." * 50_000)
    assert len(new) == 0 and time.time() - began < 15


# Packing and token counts


def reference_ids(texts):
    t = tokens.tokenizer(tokens.vocabulary_path(tokens.VOCABULARY))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_ids_of_awkward_words_equal_the_tokenizer():
    """30,000 strings of letters that lower case or composition changes, combining marks, ligatures, figures and unspaced scripts, next to marks."""
    draw = np.random.default_rng(7)
    pieces = [*"aZéßİıĞşΣσςﬁﬀǅÅÅ１²½ⅷ日本語かがゖアｱーไทยกำ한ᄀ\u1161नमस्ते\u0307\u0301\u0338\u00a0\u2028\u3000", *"abcXYZ ,.!?()[]{}<>=+-_~^`@#'\"*/\\ \n\t\r\x0b\x00\u200b", "KENDİSİ", "GELDİ", "don't", "we'LL", "'S", "ing", "the ", "e\u0301", "😀"]
    texts = ["".join(pieces[i] for i in draw.integers(0, len(pieces), int(draw.integers(1, 14)))) for _ in range(30_000)] + ["GELDİ!", "KENDİSİ.", "(İ)", "İ.", "İ", "İİ..", "<|endoftext|>İ."]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.token_ids([t.encode() for t in texts], tokens.vocabulary_path(tokens.VOCABULARY))]
    assert [t for t, x, y in zip(texts, got, reference_ids(texts), strict=True) if x != y] == []


def test_token_ids_equal_the_tokenizer(docs):
    texts = [t or "" for _, t in docs] + [t or "" for t in ODD] + ["ﬁne İstanbul ǅ", "don't we'll 'S x's", "a b c   d", "…!?.,;: w,x", "٣٤ ½ ²"]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.token_ids([t.encode() for t in texts], tokens.vocabulary_path(tokens.VOCABULARY))]
    assert got == reference_ids(texts)


def packing_faults(rows, texts, capacity=2048):
    ids = {d: [*x, 1] for d, x in zip(texts, reference_ids(texts.values()), strict=True)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for doc, own in ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    sizes = []
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        sizes.append(at)
    padded = sum(s if s & (s - 1) == 0 else capacity for s in sizes)
    return sum(sizes), padded


def test_packing(spark, sf, docs):
    total, padded = packing_faults(packing.op6(spark, sf).collect(), dict(docs))
    assert total == padded
    path = tokens.vocabulary_path(tokens.VOCABULARY)
    rows = [r for r in enumerate(ODD)]
    packing_faults(packing.packed(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(3), path).collect(), dict(rows))
    assert packing.packed(odd(spark).limit(0), path).collect() == []
    # A null id and repeated rows are documents each.
    again = packing.packed(spark.createDataFrame([(None, "null id"), (5, "one two"), (5, "one two"), (6, None)], "doc_id long, text string").coalesce(1), path, with_ids=True).collect()
    lengths = [len(x) + 1 for x in reference_ids(["null id", "one two", "one two", ""])]
    assert sum(r["length"] for r in again) == sum(lengths) and all(len(r["ids"]) == 4 * r["length"] for r in again)
    assert {(r["doc_id"], r["doc_tokens"]) for r in again} == {(None, lengths[0]), (5, lengths[1]), (6, 1)}


def test_bins_take_a_fixed_number_of_each_class():
    draw = np.random.default_rng(4)
    lengths = draw.integers(1, 2049, 4000).tolist() + draw.integers(1, 130, 6000).tolist()
    bins = packing.Bins(0)
    for doc, n in enumerate(lengths):
        bins.add(doc, bytes(4 * n))
        assert all(len(w) < max(k, 1) for k, w in enumerate(bins.waiting)) and bins.filling <= packing.FILLER + packing.CAPACITY
    bins.finish()
    held = defaultdict(list)
    for (doc, start, ids, total), sequence, offset in bins.rows:
        held[sequence].append((offset, len(ids) // 4, total, start))
    whole = Counter()
    for own in held.values():
        own.sort()
        assert [o for o, *_ in own] == [sum(n for _, n, *_ in own[:i]) for i in range(len(own))]
        first = own[0]
        if first[1] == first[2] > packing.CAPACITY // packing.CLASSES:
            k = packing.CAPACITY // first[1]
            whole[k, sum(packing.CAPACITY // n == k for _, n, total, start in own[:k] if n == total)] += 1
    assert sum(n for (k, found), n in whole.items() if k == found) > 0.9 * sum(whole.values())


def test_histogram(spark, sf, docs):
    lengths = [len(x) for x in reference_ids([t for _, t in docs])]
    table = tokens.op9(spark, sf).cache()
    want = Counter(lengths)
    rows = {r["length"]: r for r in table.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == want
    for k, r in rows.items():
        assert r["docs_over"] == sum(x > k for x in lengths) and r["tokens_kept"] == sum(min(x, k) for x in lengths) and r["tokens_total"] == sum(lengths)
    limits = {r["context_limit"]: r for r in tokens.at_limits(table, [1, 100, 10**9]).collect()}
    for k, r in limits.items():
        assert r["docs_over"] == sum(x > k for x in lengths) and r["tokens_kept"] == sum(min(x, k) for x in lengths)
    q = tokens.length_at(table, [0.5, 0.9, 1.0]).first()
    assert [q["q0"], q["q1"], q["q2"]] == [sorted(lengths)[math.ceil(s * len(lengths)) - 1] for s in (0.5, 0.9, 1.0)]


# Line dedup


def test_lines(spark):
    rows = [(i, "h", f"Menu\n own {i} \n\nFoot\r", 1) for i in range(10)] + [(10, None, "Menu\nx", 1), (11, "h", None, 1), (12, "few", "Menu", 1), (13, "h", "Rare\nRare\n\t", 1)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string, n_lines int")
    for salted in ({}, {"broadcast": 0, "per_salt": 3}):
        found = line_dedup.without_boilerplate(df, "host", "text", 0.5, 5, **salted)
        assert found.columns == ["page_id", "host", "text", "n_lines", "n_dropped"]
        got = {r["page_id"]: r for r in found.collect()}
        assert got[3]["text"] == " own 3 \n" and (got[3]["n_lines"], got[3]["n_dropped"]) == (3, 2)
        assert got[10]["text"] == "Menu\nx" and got[11]["text"] is None and got[12]["text"] == "Menu" and got[13]["text"] == "Rare\nRare\n\t" and got[13]["n_lines"] == 2


def test_lines_clashing_columns_empty_repeated_and_long(spark):
    names = "page_id long, host string, text string, row string, common int, line int, `n_dropped` int, `a.b` int"
    rows = [(1, "h", "Menu\nx", "r", 1, 2, 3, 4)] * 6 + [(None, "h", "Menu\n" + "y" * 500_000, "r", 1, 2, 3, 4)]
    got = line_dedup.without_boilerplate(spark.createDataFrame(rows, names), "host", "text", counts=False)
    assert got.columns == ["page_id", "host", "text", "row", "common", "line", "n_dropped", "a.b"]
    assert sorted(len(r["text"]) for r in got.collect()) == [0] * 6 + [500_000]
    assert line_dedup.without_boilerplate(spark.createDataFrame([], names), "host", "text").collect() == []


def test_lines_equal_the_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(line_dedup.OP8_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in line_dedup.op8(spark, sf).collect())


def test_long_passages_go_by_a_fixed_number_of_texts(spark):
    import corpus_pipeline

    passage = {s: " ".join(f"{s}{i}" for i in range(51)) for s in ("small", "large", "third")}
    short, copied = " ".join(f"w{i}" for i in range(50)), " ".join(f"c{i}" for i in range(60))
    rows = []
    for source, n in (("small", 8), ("large", 600), ("third", 1200), *((f"other{i}", 300) for i in range(6))):
        for i in range(n):
            lines = [f"own {source} {i}"]
            if source in passage and i < 5:
                lines += [passage[source], short]
            if source.startswith("other") and i < 4:
                lines.append(passage["large"])
            if source == "large" and 10 <= i < 20:
                lines = ["copy", copied]
            rows.append((len(rows), "\n".join(lines), "en", source, 0))
    rows += [(None, None, "en", "large", 0), (-1, passage["large"], "en", None, 0)]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert len(got) == len(rows)
    left = Counter((r["source"], line) for r in got for line in (r["text"] or "").split("\n"))
    for source in passage:
        assert left[source, passage[source]] == 0 and left[source, short] == 5
    assert all(left[f"other{i}", passage["large"]] == 4 for i in range(6)) and left[None, passage["large"]] == 1
    assert left["large", copied] == 10
    assert sum(line.startswith("own ") for _, line in left.elements()) == sum(r[1] is not None and r[1].startswith("own ") for r in rows)


# Toxicity


def test_toxicity_on_held_out(spark, sf):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op10(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    known = [r for r in rows if r["doc_id"] in labels and r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in known) >= 0.9 * len(known)


def test_features_and_weights_equal_a_plain_loop():
    """FTRL-proximal as published, one coordinate at a time, over features that are told apart by their words."""
    texts = ["You are a fool, a FOOL", "a fine day", "fool you", "what a day it is", "you fool", "fine"] * 4
    labels = [1, 0, 1, 0, 1, 0] * 4
    doc, at = toxicity.features([t.encode() for t in texts])
    sets = [sorted(set(at[doc == i].tolist())) for i in range(len(texts))]

    def named(text):
        words = [w.strip(".,:;!?\"'()[]") for w in text.lower().split()]
        return set(words) | {(a, b, min(g, 2)) for g in (1, 2, 3) for a, b in zip(words, words[g:], strict=False)}

    assert [len(x) for x in sets] == [len(named(t)) for t in texts]
    alpha, beta, l1, l2, epochs = 1.0, 1.0, 0.4, 0.1, 3
    z, n, bias = Counter(), Counter(), 1 << toxicity.BITS

    def weight(i):
        if abs(z[i]) <= (0 if i == bias else l1):
            return 0.0
        return -(z[i] - math.copysign(0 if i == bias else l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for own, y in zip(sets, labels, strict=True):
            w = {i: weight(i) for i in [*own, bias]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    got = dict(zip(*(x.tolist() for x in toxicity.ftrl([(np.array([*own, bias]), y) for own, y in zip(sets, labels, strict=True)], alpha, beta, l1, l2, epochs)), strict=True))
    want = {i: weight(i) for i in z if weight(i)}
    assert got.keys() == want.keys() and all(abs(got[i] - w) < 1e-9 for i, w in want.items())


def test_toxicity_edge_cases(spark):
    docs = odd(spark)
    none = toxicity.classified(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == len(ODD) + 1 and {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    some = toxicity.classified(docs, spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert all(0 <= r["score"] <= 1 for r in some)
    both = toxicity.train(docs, spark.createDataFrame([(4, 1), (4, 0), (5, 0)], "doc_id long, toxic int"))
    toxic = toxicity.train(docs, spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int"))
    assert all((a == b).all() for a, b in zip(both, toxic, strict=True))  # of clashing labels the toxic one counts
    named = toxicity.scored(docs, toxic)
    assert named.columns == ["doc_id", "text", "lang", "score"] and toxicity.scored(docs, toxic, "t").columns == [*docs.columns, "t"]
    assert toxicity.scored(docs.union(docs), toxic).count() == 2 * docs.count() and toxicity.scored(docs.limit(0), toxic).collect() == []
