"""Target-distribution importance resampling over hashed word n-grams, by an integer word dictionary.

Inside a task, the distinct words of a block of texts (BLOCK_BYTES at most, a longer text alone) get ids. An n-gram is a tuple of ids, held as one
integer: the id of its head (an n-1-gram, numbered likewise) and the id of its last word. Each distinct tuple's bytes are put
together from the dictionary and hashed once (a CRC carries on from the head's to the last word's bytes), and the
buckets join back to the tuple's places by its id. Dictionaries belong to a block, not to the corpus: a block's are bounded
by its bytes, while a corpus' distinct trigrams are about as many as its words and would all be shuffled.

Two passes over the texts: bucket counts (each task adds up its own, so a hot source or group of copies is no hot key; the
totals are `buckets` rows, which go to the driver), then each document's sum of gains. Draws are the highest scores, weight
plus Gumbel noise of a hash of the row's key, which is sampling without replacement by weight. Ranks are numbered from one
sorted table, a range a task.

Defined results: null, empty or wordless text has no features and weight 0, and fewer than `least_words` words are never drawn;
A-Z alone are lower-cased; repeated rows count and are drawn each on their own, those that share a doc_id have the same noise;
a null doc_id takes the noise of the bare seed and comes last in ties; an empty table gives an empty result, an empty target
has t = 0 in every bucket; very long texts are one block, taken whole; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import batched, read, slices, utf8
from tickforge.operators.series import numbered

BUCKETS = 10_000
ORDERS = 3
LEAST_WORDS = 20
SEED = "42"
#: Drawn are floor(5 * N / 100) of N documents.
SHARE = (5, 100)
#: Text bytes of a block, which has one dictionary.
BLOCK_BYTES = 4 << 20
#: ASCII letters (lower-cased), figures and every byte of other letters stay; the rest parts words.
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(texts: list[bytes], buckets: int, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of each feature, its text's place in `texts`)."""
    words = [t.translate(KEEP).split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    if not flat:
        return sizes, np.empty(0, np.int64), np.empty(0, np.int64)
    encoded = pa.array(flat, pa.binary()).dictionary_encode()
    ids, dictionary = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()
    tails = [b" " + w for w in dictionary]
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    sums, grams = np.fromiter(map(crc32, dictionary), np.int64, len(dictionary)), ids
    found, place = [sums[grams] % buckets], [owner]
    for n in range(2, orders + 1):
        at = np.flatnonzero(left >= n)
        grams, distinct = pd.factorize(grams[at] * len(dictionary) + ids[at + n - 1])
        heads, last = sums[distinct // len(dictionary)], distinct % len(dictionary)
        sums = np.fromiter(map(crc32, map(tails.__getitem__, last.tolist()), heads.tolist()), np.int64, len(distinct))
        found.append(sums[grams] % buckets)
        place.append(owner[at])
        every = np.zeros(len(flat), np.int64)
        every[at] = grams
        grams = every
    return sizes, np.concatenate(found), np.concatenate(place)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """(bucket, n): the features of texts (text) in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text", BLOCK_BYTES):
            total += np.bincount(features(utf8(part, "text"), buckets, orders)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    each = batched(texts).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's whole gain in thousandths: the log of its smoothed share of target over that of source."""

    def table(counts: DataFrame) -> list[int]:
        held = {r.bucket: r.n for r in counts.collect()}
        return [held.get(i, 0) for i in range(buckets)]

    s, t = table(source), table(target)
    of_s, of_t = sum(s) + buckets, sum(t) + buckets
    gain = lambda own, other: math.floor(1000 * math.log((float(other + 1) * float(of_s)) / (float(own + 1) * float(of_t))))
    return np.array([gain(own, other) for own, other in zip(s, t, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK_BYTES):
            sizes, buckets, place = features(utf8(part, "text"), len(gain), orders)
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, place, gain[buckets])
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (sizes, np.bincount(place, minlength=len(sizes)), total))], ["doc_id", "n_words", "n_features", "weight"])

    docs = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, buckets: int = BUCKETS, orders: int = ORDERS, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of documents (doc_id, text) for target (text); the drawn have ranks from 1.

    buckets bounds what the driver holds and what a task is sent: 8 bytes each.
    """
    gain = gains(bucket_counts(docs, buckets, orders), bucket_counts(target, buckets, orders), buckets)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = weights(docs, gain, orders).withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= least_words)
    ranked, seen = numbered(scored, F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), name="place", observed=[F.sum(F.col("fit").cast("long")).alias("fit")])
    most = (seen["fit"] or 0) * share[0] // share[1]
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= most, F.col("place")).alias("rank"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text")).drop("n_words")
