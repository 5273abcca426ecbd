"""Substring dedup by seed and extend: words in a stretch of `least` words that a document with a smaller id holds too go.

Seeds. The hashes of a document's `seed`-word runs are winnowed: each window of `least` words selects its smallest hash (the
last of equals), its anchor, so equal windows select the same anchor wherever they are. Consecutive windows with the same
anchor are a stretch, and each window is in exactly one. Anchors are joined across documents: those that two documents share
are kept, with partial minima and maxima of ids, so a hot anchor is no hot group.

Extension. For a shared anchor, the stretch of the smallest (id, words) leads. Every other stretch is laid on it at the anchor and
extended both ways, word by word; if the match reaches `least` words, and the leader's id is smaller, it is covered. A stretch is all that its
windows can reach, so the union of such matches are the maximal repeats with the leaders.

The rest. Windows outside the match with the leader may repeat in other documents. They are grouped by their words
(128-bit digests), with partial minima of ids, and those of a smaller id are covered too. So an anchor that very many documents hold in
different surroundings costs its windows, never its pairs.

Work is linear in the texts: a document's anchors are shuffled once for the counts and once to meet the shared ones (an inner join whose
hot keys Spark splits); only stretches at shared anchors travel with their words. What a document collects is bounded by its own length.

Defined results: null, empty or wordless text has no words; rows with a null doc_id neither lose words nor take them from others; rows
that share a doc_id don't take words from each other; a text of fewer than `least` words loses none; windows repeated inside one document
alone stay; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import STEP_BYTES, batched, drop_table, hash_words, ngram_hashes, read, slices, utf8, written

#: Words of a repeat at least, and words of a seed.
LEAST = 13
SEED = 5


def stretches(hashes: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """(anchor, start, windows, offset) of each stretch: its first window begins at start, its anchor's words at start + offset."""
    grams = ngram_hashes(hashes, seed)
    width = least - seed + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    best, at = grams[width - 1 :].copy(), np.arange(width - 1, len(grams))
    for back in range(2, width + 1):
        other = grams[width - back : len(grams) - back + 1]
        less = other < best
        best, at = np.where(less, other, best), np.where(less, np.arange(width - back, len(grams) - back + 1), at)
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return best[start], start, np.diff(np.append(start, n)), at[start] - start


def _hashed(texts: list[bytes]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    words = [t.split() for t in texts]
    ends = np.cumsum([0] + [len(w) for w in words])
    flat = hash_words([x for w in words for x in w])
    return words, [flat[ends[i] : ends[i + 1]] for i in range(len(words))]


def anchors(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """(anchor, doc_id, key): the distinct anchors of each row of docs (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            found = [np.unique(stretches(h, least, seed)[0]).view(np.int64) for h in _hashed(utf8(part, "text"))[1]]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column(0).take(of), part.column(1).take(of)], ["anchor", "doc_id", "key"])

    return docs.mapInArrow(run, "anchor long, doc_id long, key long")


def shared_stretches(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """(anchor, doc_id, key, words, offset, starts): the distinct stretches of docs (doc_id, key, text, shared) at shared anchors, with each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            words, hashes = _hashed(utf8(part, "text"))
            rows: list[tuple] = []
            for i, (w, h, shared) in enumerate(zip(words, hashes, part.column(3), strict=True)):
                anchor, start, windows, offset = stretches(h, least, seed)
                held = np.flatnonzero(np.isin(anchor.view(np.int64), shared.values.to_numpy()))
                own: dict[tuple, list[int]] = {}
                for a, s, n, o in zip(*(x[held].tolist() for x in (anchor.view(np.int64), start, windows, offset)), strict=True):
                    own.setdefault((a, b" ".join(w[s : s + n + least - 1]), o), []).append(s)
                rows += [(i, *stretch, places) for stretch, places in own.items()]
            of, anchor, text, offset, places = zip(*rows, strict=True) if rows else ((),) * 5
            of = pa.array(of, pa.int64())
            columns = [pa.array(anchor, pa.int64()), part.column(0).take(of), part.column(1).take(of), pa.array(text, pa.binary()).cast(pa.string()), pa.array(offset, pa.int32()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "key", "words", "offset", "starts"])

    return docs.mapInArrow(run, "anchor long, doc_id long, key long, words string, offset int, starts array<int>")


def extended(words: list[bytes], at: int, other: list[bytes], there: int, seed: int) -> tuple[int, int]:
    """[low, high) of words: the match with other that holds words[at : at + seed], laid on other[there : there + seed]; empty if these differ."""
    if words[at : at + seed] != other[there : there + seed]:
        return at, at
    low, high = at, at + seed
    shift = there - at
    while low and low + shift and words[low - 1] == other[low + shift - 1]:
        low -= 1
    while high < len(words) and high + shift < len(other) and words[high] == other[high + shift]:
        high += 1
    return low, high


def matches(rows: DataFrame, least: int, seed: int) -> DataFrame:
    """(doc_id, key, starts, low, high, digest) of rows (doc_id, key, words, offset, starts, lead, lead_offset, behind).

    With a null digest: words [start + low, start + high) are matched by the leader. With one: the window there is not, and has
    these words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "words", STEP_BYTES, 4096):
            out: list[tuple] = []
            offset, there, behind = (part.column(i).to_pylist() for i in (3, 6, 7))
            for i, (text, lead) in enumerate(zip(utf8(part, "words"), utf8(part, "lead"), strict=True)):
                if text == lead and offset[i] == there[i]:  # a copy of the leader's stretch matches whole
                    if behind[i]:
                        out.append((i, 0, text.count(b" ") + 1, None))
                    continue
                words = text.split()
                low, high = extended(words, offset[i], lead.split(), there[i], seed)
                long = high - low >= least
                if long and behind[i]:
                    out.append((i, low, high, None))
                for s in range(len(words) - least + 1):
                    if not (long and low <= s and s + least <= high):
                        out.append((i, s, s + least, hashlib.blake2b(b" ".join(words[s : s + least]), digest_size=16).digest()))
            of, low, high, digest = zip(*out, strict=True) if out else ((),) * 4
            of = pa.array(of, pa.int64())
            columns = [part.column(0).take(of), part.column(1).take(of), part.column(4).take(of), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "starts", "low", "high", "digest"])

    return rows.select("doc_id", "key", "words", "offset", "starts", "lead", "lead_offset", "behind").mapInArrow(run, "doc_id long, key long, starts array<int>, low int, high int, digest binary")


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def without(docs: DataFrame, texts: bool) -> DataFrame:
    """SCHEMA of docs (doc_id, text, spans array<struct<starts, low, high>>): the words outside the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            rows = []
            for text, spans in zip(utf8(part, "text"), part.column(2), strict=True):
                words = text.split()
                kept = words
                if spans.is_valid:
                    own = spans.values
                    starts = own.field("starts")
                    of = np.repeat(np.arange(len(own)), pa.compute.list_value_length(starts).to_numpy(zero_copy_only=False).astype(np.int64))
                    start = starts.flatten().to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start + own.field("low").to_numpy()[of], 1)
                    np.add.at(edge, start + own.field("high").to_numpy()[of], -1)
                    kept = [w for w, x in zip(words, np.cumsum(edge).tolist(), strict=False) if not x]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if texts else None))
            n, removed, digest, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string())], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def without_repeats(docs: DataFrame, texts: bool = True, least: int = LEAST, seed: int = SEED, parts: int = 2) -> DataFrame:
    """SCHEMA of documents (doc_id, text): each without the words of windows of `least` words that a document with a smaller id holds (kept is null unless `texts`).

    Stretches meet their leaders in `parts` parts of the anchors, one after another, which bounds the disk that their words take.
    """
    spark, spent = docs.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        table, seen = written(df)
        spent.append(seen["path"])
        return table

    docs = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    known = docs.where("doc_id is not null").select("doc_id", "key", "text")
    posts = kept(anchors(known, least, seed))
    seeds = kept(posts.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor"))
    shared = kept(posts.join(seeds, "anchor").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("shared")))
    drop_table(spark, spent[0])
    found = kept(shared_stretches(known.join(shared, ["doc_id", "key"]).select("doc_id", "key", "text", "shared"), least, seed))
    drop_table(spark, spent[2])
    matched = None
    for i in range(parts):
        own = found.where(F.pmod("anchor", F.lit(parts)) == i)
        lead = kept(own.groupBy("anchor").agg(F.min(F.struct("doc_id", "words", "offset")).alias("lead")))
        laid = own.join(lead, "anchor").select("doc_id", "key", "words", "offset", "starts", F.col("lead.words").alias("lead"), F.col("lead.offset").alias("lead_offset"), (F.col("doc_id") > F.col("lead.doc_id")).alias("behind"))
        one = kept(matches(laid, least, seed))
        drop_table(spark, spent[-2])
        matched = one if matched is None else matched.union(one)
    drop_table(spark, spent[3])
    windows = matched.where("digest is not null")
    again = windows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    spans = matched.where("digest is null").select("doc_id", "key", "starts", "low", "high").union(windows.join(again, "digest").where("doc_id > first").select("doc_id", "key", "starts", "low", "high"))
    spans = kept(spans.distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("starts", "low", "high")).alias("spans")))
    out, _ = written(without(docs.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans"), texts))
    for path in spent[1:]:
        drop_table(spark, path)
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), texts=False).drop("kept")
