"""Column builders for passages of text: normal forms, words with boundaries, n-grams, sentences, paragraphs, clippings."""

from __future__ import annotations

import re
import unicodedata
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Marks that go, what stands for a dash, katakana, ends of sentences, heads of list items, blanks.
MARKS = "™℠"
DASHES = "ｰー―‐‑–—−─〜~"
KANA = "゠-ヿㇰ-ㇿ"
ENDS = "。！？!?"
HEADS = "・●■①-⑳"
NUMBERED = "[0-9０-９]{1,3}[)）]"
ITEM = f"(?:[{HEADS}]|[(（]{NUMBERED})"
BLANKS = r"\s\x{a0}\x{1680}\x{2028}\x{2029}\x{3000}\x{feff}"
SHORT_KANA = 4

RUN = re.compile(f"((?<=[{KANA}]))?([{DASHES}]+)(?=([{KANA}]?))")
MARK, BLANK = re.compile(f"[{MARKS}]"), re.compile("[ \t\n\v\f\r\xa0\u1680\u2028\u2029\u3000\ufeff]+")
BREAK = re.compile(rf"(?<=[{ENDS}])(?![{ENDS}])|(?<=[\r\n])|(?<=[\s　])(?={ITEM})")
# BREAK in two parts that each begin with one of a few characters, so that all others are passed over at once: it ends where the first ends and where the second begins.
END = re.compile(rf"[{ENDS}\r\n](?:(?<=[{ENDS}])[{ENDS}]*)?")
HEAD = re.compile(rf"[{HEADS}(（](?<=[\s　].)(?:(?<=[{HEADS}])|{NUMBERED})", re.DOTALL)
LINE = re.compile(r"[^\r\n]+")


def _dashes(run: re.Match) -> str:
    """From the first dash with katakana on either side on, a run is long vowel marks, before it hyphens."""
    behind, dashes, ahead = run.groups()
    mark = dashes.find("ー", 1)
    start = 0 if behind is not None else mark - 1 if mark > 0 else len(dashes) - bool(ahead)
    return "-" * start + "ー" * (len(dashes) - start)


def _normal(text: str) -> str:
    """Patterns run only where their characters are; of all blanks, a single space alone is printable."""
    if text.isascii():
        text = text.replace("~", "-").lower()
    else:
        if any(m in text for m in MARKS):
            text = MARK.sub("", text)
        text = unicodedata.normalize("NFKC", text)
        if any(d in text for d in DASHES):
            text = RUN.sub(_dashes, text)
        text = text.encode().lower().decode()
    return BLANK.sub(" ", text) if "  " in text or not text.isprintable() else text


@F.pandas_udf(StringType())
def _normals(texts: pd.Series) -> pd.Series:
    return texts.map(_normal, na_action="ignore")


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC alone, which no built-in function gives."""
    return texts.str.normalize("NFKC")


def normal(text: Column) -> Column:
    """The form in which words are looked up: NFKC (which no built-in function gives), one kind of dash, single blanks, ASCII in lower case."""
    return _normals(text)


def word_pattern(word: str) -> str:
    """A normal word where it stands for itself: no ASCII letter or digit goes on beyond one, no katakana beyond a short katakana word.

    What stands before it is looked at behind the word: a pattern that begins with the word itself passes over other characters much faster.
    """
    if len(word) <= SHORT_KANA and re.fullmatch("[゠-ヿ]+", word):
        return f"\\Q{word}\\E(?<![{KANA}]\\Q{word}\\E)(?![{KANA}])"
    head, tail = (re.fullmatch("[a-z0-9]", c) for c in (word[0], word[-1]))
    return f"\\Q{word}\\E" + (f"(?<![a-z0-9]\\Q{word}\\E)" if head else "") + ("(?![a-z0-9])" if tail else "")


def words_in(text: Column, words: list[str]) -> Column:
    """The words of a list that a normal text has, in the list's order."""
    return F.array_compact(F.array(*(F.when(text.rlike(word_pattern(w)), F.lit(w)) for w in words)))


def ngrams(text: Column, n: int = 2) -> Column:
    """The n-grams of a normal text; a shorter one is its own, an empty one has none."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.char_length(text) > 0, many).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Trimmed sentences: they end behind end marks and lines, and before the head of a list item."""
    cut = F.split(text, BREAK.pattern)
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, f"^[{BLANKS}]+|[{BLANKS}]+$", "")), lambda s: s != "")


def _breaks(text: str) -> list[int]:
    """Where sentences end: the places of BREAK."""
    ends, heads = [m.end() for m in END.finditer(text)], [m.start() for m in HEAD.finditer(text)]
    return sorted({*ends, *heads}) if heads else ends


def _spans(pieces: list[tuple[int, str]]) -> list[tuple[int, int]]:
    return [(at + len(s) - len(s.lstrip()), at + len(s.rstrip())) for at, s in pieces if s.strip()]


def _sentences(text: str) -> list[tuple[int, int]]:
    cuts = [0, *_breaks(text), len(text)]
    return _spans([(a, text[a:b]) for a, b in pairwise(cuts)])


def paragraph_spans(text: str, most: int = 400) -> list[tuple[int, int]]:
    """Lines; where there is none, runs of whole sentences of at most `most` characters (a longer sentence alone)."""
    if "\n" in text or "\r" in text:
        return _spans([(m.start(), m.group()) for m in LINE.finditer(text)])
    spans: list[tuple[int, int]] = []
    for start, end in _sentences(text):
        if spans and end - spans[-1][0] <= most:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
    return spans


def paragraphs(text: Column, most: int = 400) -> Column:
    """The paragraphs of a text as (start, end) in characters; null for null, none for blanks. Running lengths are linear in Python only."""

    @F.pandas_udf("array<struct<start int, end int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in paragraph_spans(t, most)])

    return spans(text)


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.arrow_udf(ArrayType(StructType([*SPANS.elementType.fields, StructField("text", StringType())])))
def normal_sentences(texts: pa.Array) -> pa.Array:
    """The sentences of a text as (start, end, text) in its characters, the sentence in normal form; null for null, none for blanks.

    A running sum over a text's pieces is quadratic in built-in functions, and to cut each out of the whole text would read the text again for each.
    """
    at, starts, ends, found = [0], [], [], []
    for text in map(pa.StringScalar.as_py, texts):
        for a, b in _sentences(text or ""):
            starts.append(a)
            ends.append(b)
            found.append(_normal(text[a:b]))
        at.append(len(starts))
    each = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())], ["start", "end", "text"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), each, mask=texts.is_null())


def clipped(text: Column, word: Column, most: int = 300) -> Column:
    """A text of at most `most` characters whole; of a longer one the stretch around the word, moved inside, or its middle where the word is not."""
    size, at, wide = F.char_length(text), F.instr(text, word), F.char_length(word)
    half = F.floor((most - wide) / 2)
    span = wide + 2 * half
    first = F.greatest(F.least(at - 1 - half, size - span), F.lit(0))
    middle = F.floor((size - most) / 2)
    start, length = F.when(at > 0, first).otherwise(middle).cast("int"), F.when(at > 0, span).otherwise(most).cast("int")
    more = lambda there: F.when(there | (at == 0), "…").otherwise("")
    cut = F.concat(more(start > 0), F.substring(text, start + 1, length), more(start + length < size))
    return F.when(size <= most, text).otherwise(cut)
