"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are binary: the hashed words, word pairs and pairs that skip up to `SKIP`
words, lower-cased (A-Z), whole texts; pairs that skip one word and two are one feature. Per-coordinate learning rates and the L1 term leave few non-zero weights,
which are broadcast (at most 2 ** BITS of them).

Training takes a sample of labelled rows of at most `most_rows` documents (those of least
xxhash64(doc_id), half of either label at most where enough are there), so it is bounded at any size.

Defined results: null or empty text is scored by the intercept; with no labelled rows, every score
is 0 (predicted 0); null labels are not learnt from, of labels that clash within a doc_id the toxic one counts;
repeated rows are scored each (and learnt from each); rows with a null
doc_id are scored and not held out; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickforge.llm.common import batched, hash_words, mixed, read, slices, utf8

BITS = 18
SKIP = 2


def features(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every distinct feature of each text, sorted; of `wanted` features only, if given."""
    words = [[w.strip(b".,;:!?\"'()[]") for w in t.lower().split()] for t in texts]
    lengths = np.array([len(w) for w in words])
    doc = np.repeat(np.arange(len(texts)), lengths)
    hashes = mixed(hash_words([x for w in words for x in w]))
    found = [(doc, hashes)]
    for gap in range(1, SKIP + 2):
        inside = doc[gap:] == doc[:-gap]
        pair = mixed(hashes[:-gap] * np.uint64(3) + hashes[gap:] * np.uint64(5) + np.uint64(min(gap, 2)))
        found.append((doc[gap:][inside], pair[inside]))
    docs = np.concatenate([d for d, _ in found])
    keys = np.concatenate([h for _, h in found]) >> np.uint64(64 - BITS)
    if wanted is not None:
        inside = wanted[keys]
        docs, keys = docs[inside], keys[inside]
    both = np.sort((docs.astype(np.uint64) << np.uint64(BITS)) | keys)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def ftrl(samples: list[tuple[np.ndarray, int]], alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the non-zero weights; index 2 ** BITS is the intercept, which the L1 term spares."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    penalty = np.full(size, l1)
    penalty[-1] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= penalty[at], 0, -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, y in samples:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(size))
    at = np.flatnonzero(w)
    return at, w[at]


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12000, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from docs (doc_id, text) and labels (doc_id, toxic), both for training only."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").where("doc_id is not null").distinct().join(labels, "doc_id").select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    drawn = None
    for y in (1, 0):
        part = known.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(most_rows // 2)
        drawn = part if drawn is None else drawn.union(part)
    sample = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", F.col("toxic").cast("int"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, at = features(utf8(part, "text"))
            cuts = np.searchsorted(doc, np.arange(1, part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.split(at.astype(np.int32), cuts), pa.list_(pa.int32()))], ["doc_id", "toxic", "at"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            lists, starts = batch.column(2), batch.column(2).offsets.to_numpy()
            values = lists.values.to_numpy()
            rows += [((d * 2654435761) % (1 << 32), d, np.append(values[starts[i] : starts[i + 1]].astype(np.int64), 1 << BITS), y) for i, (d, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))]
        rows.sort(key=lambda r: (r[0], r[1], r[3], len(r[2])))
        if rows:
            at, w = ftrl([(r[2], r[3]) for r in rows], alpha, beta, l1, l2, epochs)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["at", "w"])

    got = sample.mapInArrow(extract, "doc_id long, toxic int, at array<int>").repartition(1).mapInArrow(fit, "at long, w double").toPandas()
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(np.float64)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """docs (text, ...) with the score as a double column `name`, which replaces one of that name; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = batched(docs).drop(name)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        weights = np.zeros((1 << BITS) + 1)
        weights[at] = w
        wanted = weights[:-1] != 0
        for part in slices(batches, "text"):
            doc, found = features(utf8(part, "text"), wanted)
            total = np.bincount(doc, weights[found], part.num_rows) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(at) else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out() -> Column:
    """One document in five, by crc32 of doc_id; no label of it is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from the documents that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return train(docs.where(~held_out()), labels)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; one in five documents (crc32) is held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(docs, trained(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
