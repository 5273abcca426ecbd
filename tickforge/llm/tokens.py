"""Token ids and token counts with the public tokenizers' files.

`Words` rests on what word_bpe_49k does with white space: it separates words and is dropped, so a
text's ids are those of its words one after another. Words met before come from two tables of each
Python worker of about CACHE words each; the others go to the tokenizer. Results never depend on them.

Token counts are one histogram of encoded lengths; suffix sums over its distinct lengths answer totals,
quantiles and truncated totals of every context limit.

Defined results: null or empty text has no ids (length 0 without an end id); repeated rows count each;
an empty table gives an empty histogram; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm.common import batched, read, slices, utf8

VOCABULARY = "word_bpe_49k.json"
CACHE = 150_000
LONGEST = 48
#: ASCII marks that belong to no contraction: a run of them before or behind letters is a piece of its own.
MARKS = b'.,:;!?#*"()[]{}<>|$%&/\\=+-_~^`@'


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Ids of words (UTF-8, A-Z lower-cased) as little-endian unsigned 32-bit integers.

    Two generations of at most CACHE words each: words that are asked for again move to the young one, and
    when it is full it becomes the old one, so frequent words stay and rare ones go.
    """

    def __init__(self, path: str):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {b"": b""}
        self.tokenizer = tokenizer(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def encoded(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def run(self, marks: bytes) -> bytes:
        """Ids of a run of MARKS, which the tokenizer keeps apart from the letters beside it."""
        if marks in self.runs:
            return self.runs[marks]
        (ids,) = self.encoded([marks.decode()])
        if len(self.runs) < CACHE and len(marks) <= LONGEST:
            self.runs[marks] = ids
        return ids

    def met(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not in the tables. Letters are encoded as one text and cut where a word's last piece ends."""
        found, letters, others, marked = {}, set(), [], []
        known = lambda w: self.young.get(w) or self.old.get(w)
        for w in words:
            core = w.strip(MARKS)
            # A letter that lower case splits (İ) leaves a mark that is joined with those behind it: such a word is not cut.
            if not core or not (core.isalpha() or (read := core.decode("utf-8")).isalpha() and read.lower().isalpha()):
                others.append(w)
                continue
            if core != w:
                marked.append((w, core))
            if core == w or not known(core):
                letters.add(core)
        if letters:
            asked = list(letters)
            ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(asked).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(asked):
                raw, at = ids.tobytes(), 0
                for w, cut in zip(asked, (4 * cuts).tolist(), strict=True):
                    found[w] = raw[at:cut]
                    at = cut
            else:  # a letter that lower case splits
                found.update(zip(asked, self.encoded([w.decode("utf-8") for w in asked]), strict=True))
        for w, core in marked:
            at = w.index(core)
            found[w] = self.run(w[:at]) + (found.get(core) or known(core)) + self.run(w[at + len(core) :])
        found.update(zip(others, self.encoded([w.decode("utf-8") for w in others]), strict=True))
        return found

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids, its words' one after another."""
        words = [() if b"<|" in t else t.lower().split() for t in texts]
        missing = set().union(*words).difference(self.young)
        if missing:
            again = missing & self.old.keys()
            self.young.update((w, self.old[w]) for w in again)
            missing -= again
            self.young.update(self.met(missing))
        out = [b"".join(map(self.young.__getitem__, w)) for w in words]
        for w in missing:
            if len(w) > LONGEST:
                del self.young[w]
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        for i, t in enumerate(texts):
            if b"<|" in t:
                out[i] = self.encoded([t.decode("utf-8")])[0]
        return out


@cache
def words_of(path: str) -> Words:
    return Words(path)


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    return words_of(path).ids(texts)


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id and n_tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in token_ids(utf8(part, "text"), path)], pa.int64())], ["doc_id", "n_tokens"])

    return batched(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """One row per distinct length: n_docs of it, and for a context limit of that length

    docs_over (documents longer), tokens_kept (sum of lengths cut to the limit), docs_upto and
    share_upto (for quantiles) and tokens_total of the corpus. The distinct lengths, not the
    documents, are what the window orders; they are at most the longest text's length.
    """
    table = lengths(docs, path).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    upto, everything = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    total_docs, total = F.sum("n_docs").over(everything), F.sum(F.col("n_docs") * F.col("length")).over(everything)
    table = table.select("length", "n_docs", F.sum("n_docs").over(upto).alias("docs_upto"), F.sum(F.col("n_docs") * F.col("length")).over(upto).alias("tokens_upto"), total_docs.alias("docs_total"), total.alias("tokens_total"))
    over = F.col("docs_total") - F.col("docs_upto")
    return table.select("length", "n_docs", "docs_upto", over.alias("docs_over"), (F.col("tokens_upto") + over * F.col("length")).alias("tokens_kept"), "tokens_total", (F.col("docs_upto") / F.col("docs_total")).alias("share_upto"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, tokens_kept): documents over each limit and tokens kept under it, in one pass over the histogram."""
    none = F.lit(0).cast("long")
    rows = [
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), none).alias("docs_over"),
            F.coalesce(F.sum(F.least("length", F.lit(limit).cast("long")) * F.col("n_docs")), none).alias("tokens_kept"),
        )
        for limit in limits
    ]
    return table.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def length_at(table: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least each share of the documents reaches down to (exact quantiles, in whole numbers)."""
    parts = [Fraction(str(s)) for s in shares]
    total = F.col("docs_upto") + F.col("docs_over")
    return table.agg(*(F.min(F.when(F.col("docs_upto") * p.denominator >= total * p.numerator, F.col("length"))).alias(f"q{i}") for i, p in enumerate(parts)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path(VOCABULARY))
