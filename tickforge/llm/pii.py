"""Personal data: base patterns on the raw text, and further finds under disguise.

Transducers rewrite a text while they keep, for each character written, the source characters it
stands for: one folds homoglyphs, styled and full-width forms and zero-width characters to ASCII, one turns runs of spelled digits into
digits, one "at"/"dot" disguises, with spelled digits before them, into @ and dots. They compose: each works on what the ones before it wrote, and
identifiers are looked for after the first, after either of the others, and after all. Finds are mapped back to source characters and added
where they touch no base span; a find that holds an earlier one takes its place. A disguised address has at most four dots and eight spelled digits
before its at and five behind, local parts of 64 and labels of 63 characters (as mail and host names have); plain ones have no such bounds.
Work is linear in a text's finds, but for their search by bisection.

Offsets are code points, ends exclusive. Defined results: null text is taken as empty; rows are
independent, so repeated rows and null ids give a row each; an empty table gives an empty result; further
columns are ignored. The counts n_email, n_ip, n_card and n_phone are those of the base patterns,
n_added counts the method's spans.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import batched, read, slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "ε": "e", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\ufe63": "-", "\ufe62": "+", "\ufe6b": "@", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Blocks whose styled letters, digits and signs (mathematical, circled, raised, lowered, squared) fold as Unicode's compatibility forms do.
STYLED = [(0xA0, 0xFF), (0x2070, 0x209F), (0x2100, 0x214F), (0x2460, 0x24FF), (0x1D400, 0x1D7FF), (0x1F100, 0x1F1FF)]
#: Styled and full-width forms, Arabic-Indic and extended digits follow by rule.
FOLDED = {chr(c): form for a, b in STYLED for c in range(a, b + 1) if len(form := unicodedata.normalize("NFKC", chr(c))) == 1 and "!" <= form <= "~"} | HOMOGLYPHS | {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)} | {chr(base + d): str(d) for base in (0x660, 0x6F0) for d in range(10)} | dict.fromkeys(HIDDEN, "")
FOLDS = frozenset(FOLDED)
# Digits spelled in the four languages of the corpus.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_POINT = "dot|point|punkt|punto"
#: A run of at least four digits, spelled or written, with or without "plus" before it and "dot" inside.
RUN = re.compile(rf"(?i)(?<![^\W_])(?:(plus|\+)[\s.,-]*)?(?:{_DIGIT}|[0-9])(?:(?:[\s,.\-()/]|{_POINT})*(?:{_DIGIT}|[0-9])){{3,}}(?![^\W_])")
ITEM = re.compile(rf"(?i){_DIGIT}|{_POINT}|[0-9.]")
WORDED = re.compile(rf"(?i){_DIGIT}")
# Suffixes that make an address of plain words ("at", "dot").
SUFFIXES = frozenset("com org net edu gov info biz io co de fr es uk eu us ch at it nl".split())
_AT = r"(?:\s*[\[({<]\s*(?:at|arobase|arroba|@)\s*[\])}>]\s*|\s+(?:at|arobase|arroba)\s+|\s+@\s*|@\s+)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|point|punto|punkt|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+|\s+point\s+)"
#: local at domain dot suffix, where at or a dot is disguised.
MAIL = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:(?:\.|{_DOT})[A-Za-z0-9_%+-]{{1,64}}){{0,4}}(?:\s+(?:{_DIGIT})(?![A-Za-z0-9])){{0,8}}(?:{_AT}|@)[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,63}}){{1,5}}(?![A-Za-z0-9-])")
ATS, DOTS = re.compile(f"(?i){_AT}"), re.compile(f"(?i){_DOT}")
TAIL = re.compile(rf"(?i)\s+({_DIGIT})(?![A-Za-z0-9])")
#: An address whose dots alone are disguised.
NUMBER_DOTS = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:\s*[\[({{]\s*(?:dot|point|punto|punkt|\.)\s*[\])}}]\s*|\s+(?:dot|punkt|punto|point)\s+|\.)[0-9]{{1,3}}){{3}}(?![0-9.])")
#: Bare at, arobase or arroba before a dotted domain with a common suffix.
BARE = rf"\s(?:at|arobase|arroba)\s+(?:[A-Za-z0-9-]{{1,63}}\.){{1,5}}(?:{'|'.join(sorted(SUFFIXES))})(?![A-Za-z0-9-])"
# Words of prose that stand before "at" and a domain without being an address's local part.
BEFORE_AT = frozenset("us me you him her them it is are was were be been look looks looked looking here there available online found hosted located live read see seen more posted published page pages site website visit visited and or not".split())
HINT = re.compile(r"(?i)\bdot\b|\bpoint\b|\bpunto\b|\bpunkt\b|[\[({<]\s*[.@]\s*[\])}>]|\s@|@\s|[\[({<]\s*(?:at|arobase|arroba)\s*[\])}>]|" + BARE)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and non-overlapping within each kind; matches that fail their check are dropped."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if text.count(".") >= 3:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


class Rewritten:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def replaced(self, pattern: re.Pattern, by) -> Rewritten:
        """Each match replaced by by(match): pieces (written, start, end) in the match's text, each character of which maps to that stretch.

        A match for which by gives None stays; where all do, the text is this one.
        """
        made = [(m.start(), m.end(), pieces) for m in pattern.finditer(self.text) if (pieces := by(m)) is not None]
        if not made:
            return self
        starts = self.starts or list(range(len(self.text)))
        ends = self.ends or list(range(1, len(self.text) + 1))
        out, new_starts, new_ends, at = [], [], [], 0
        for start, end, pieces in made:
            out.append(self.text[at:start])
            new_starts += starts[at:start]
            new_ends += ends[at:start]
            for piece, s, e in pieces:
                out.append(piece)
                new_starts += [starts[s]] * len(piece)
                new_ends += [ends[e - 1]] * len(piece)
            at = end
        out.append(self.text[at:])
        view = Rewritten("".join(out))
        view.starts, view.ends = new_starts + starts[at:], new_ends + ends[at:]
        return view

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _folded(m: re.Match) -> list[tuple[str, int, int]]:
    return [(FOLDED[m[0]], m.start(), m.end())]


def _digits(m: re.Match) -> list[tuple[str, int, int]] | None:
    """A run with its words as digits and points, and nothing between them; None for a run without spelled digits or "plus"."""
    if not (m[1] and m[1] != "+") and not WORDED.search(m[0]):
        return None
    plus = [("+", m.start(1), m.end(1))] if m[1] else []
    return plus + [(SPELLED.get(d[0].lower(), d[0] if d[0].isdigit() else "."), d.start(), d.end()) for d in ITEM.finditer(m.string, m.end(1) if m[1] else m.start(), m.end())]


def _plain(m: re.Match) -> list[tuple[str, int, int]] | None:
    """The match with its at and dot disguises undone; None unless there is a bracket, an @, or the word at and a common suffix.

    Before a bare at and a plain domain, a word of BEFORE_AT is prose.
    """
    text, base = m[0], m.start()
    ats, dots = list(ATS.finditer(text)), list(DOTS.finditer(text))
    marks = [("@", x) for x in ats] + [(".", x) for x in dots]
    bracketed = any(re.search(r"[\[({<]", x[0]) for _, x in marks)
    worded = marks and marks[0][0] == "@" and text.rsplit(None, 1)[-1].rsplit(".", 1)[-1].lower() in SUFFIXES
    worded = worded and (len(marks) > 1 or text.split(None, 1)[0].lower() not in BEFORE_AT)
    if not marks or not (bracketed or "@" in text or worded):
        return None
    digits = [(SPELLED[x[1].lower()], x) for x in TAIL.finditer(text, 0, ats[-1].start())] if ats and (dots or bracketed) else []
    if digits and not all(a.end() == b.start() for (_, a), (_, b) in zip(digits, [*digits[1:], ("", ats[-1])], strict=True)):
        digits = []
    out, at = [], 0
    marks += digits
    for kind, x in sorted(marks, key=lambda y: y[1].start()):
        if x.start() < at:
            continue
        out += [(c, base + i, base + i + 1) for i, c in enumerate(text[at : x.start()], at)]
        out.append((kind, base + x.start(), base + x.end()))
        at = x.end()
    return out + [(c, base + i, base + i + 1) for i, c in enumerate(text[at:], at)]


def _undone(text: Rewritten) -> Rewritten:
    """The text without at and dot disguises; itself where it has none."""
    return text.replaced(MAIL, _plain).replaced(NUMBER_DOTS, _plain_ip) if HINT.search(text.text) else text


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Finds in the rewritten text, mapped to the source, that touch no base span and none of each other."""
    source = Rewritten(text)
    # A pattern of the few characters that are there: one of all of them is slow to search.
    odd = FOLDS.intersection(set(text)) if not text.isascii() else ()
    folded = source.replaced(re.compile("[" + re.escape("".join(sorted(odd))) + "]"), _folded) if odd else source
    digits = folded.replaced(RUN, _digits)
    plain = _undone(folded)
    views = [v for v, before in ((folded, source), (digits, folded), (plain, folded)) if v is not before]
    if digits is not folded and plain is not folded:
        views.append(_undone(digits))
    finds = ((kind, *view.source(start, end)) for view in views for start, kind, end in base_spans(view.text))
    return apart(finds, [(s, e) for s, _, e in base])


def apart(finds: Iterable[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the finds (kind, start, end), one after another, that meet none of `taken`, and of those before only such as lie inside and give way."""
    # Taken ones by start, with the farthest end so far; kept ones never overlap, so both their ends are in order.
    taken = sorted(taken)
    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    starts, ends, kinds = [], [], []
    for kind, s, e in finds:
        before = bisect_left(begins, e)
        if before and reach[before - 1] > s:
            continue
        low, high = bisect_right(ends, s), bisect_left(starts, e)
        if low == high or starts[low] >= s and ends[high - 1] <= e:
            starts[low:high], ends[low:high], kinds[low:high] = [s], [e], [kind]
    return list(zip(starts, kinds, ends, strict=True))


def _plain_ip(m: re.Match) -> list[tuple[str, int, int]]:
    parts = list(re.finditer("[0-9]+", m[0]))
    out = []
    for i, p in enumerate(parts):
        if i:
            out.append((".", m.start() + parts[i - 1].end(), m.start() + p.start()))
        out += [(c, m.start() + p.start() + k, m.start() + p.start() + k + 1) for k, c in enumerate(p[0])]
    return out


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) of one text."""
    base = base_spans(text)
    return base, added_spans(text, base)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    base, new = spans_of(text)
    if not base and not new:
        return text
    out, at = [], 0
    for s, k, e in sorted(base + new):
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"<{KINDS[k]}>"]
        at = e
    return "".join([*out, text[at:]])


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans, all_spans) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows: list[list] = [[] for _ in range(7)]
            for text in part.column(1).to_pylist():
                base, new = spans_of(text or "")
                for k in range(4):
                    rows[k].append(sum(kind == k for _, kind, _ in base))
                rows[4].append(len(new))
                rows[5].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows[6].append(joined(base + new))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(r, pa.int64()) for r in rows[:5]), pa.array(rows[5], pa.string()), pa.array(rows[6], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    return batched(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the spans of `column` replaced; nulls stay null, other columns stay as they are."""
    at = batched(docs).columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            columns = list(part.columns)
            columns[at] = pa.array([t if t is None else redacted(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(read(spark, sf_dir, "documents", "doc_id", "text"))
