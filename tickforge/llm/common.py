"""Reading, materialising, batching and linking helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.sources.shared import drop_table, shared_dir, written

__all__ = ["batched", "connected_components", "drop_table", "forest", "hash_words", "letters", "mixed", "ngram_hashes", "read", "shared_dir", "slices", "utf8", "written"]

#: Text bytes that one step inside a Python worker looks at together.
STEP_BYTES = 1 << 20
#: Rows of texts that Spark sends to a Python worker together.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def batched(docs: DataFrame) -> DataFrame:
    """docs, whose rows the session's Python workers now get BATCH_ROWS at a time: whole texts are long rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = STEP_BYTES, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts stay under most_bytes (one longer text comes alone)."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        lengths = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null gives empty bytes."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, alike in every process."""
    if not words:
        return np.empty(0, np.uint64)
    array = np.empty(len(words), object)
    array[:] = words
    return pd.util.hash_array(array, categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads near ones (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of one run of word hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = mixed(total + words[i : len(words) - n + 1 + i] * np.uint64(2 * i + 3))
    return total


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs out of (left, right) that join the same of n points together, without cycles."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each is two joins and partial minima over the
    edges, so no node's neighbours ever meet in one task, and the rounds grow as log of the longest path.
    Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    check = (F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"))
    stars, seen = written(edges.where("a <> b").select(high, low).distinct(), *check)
    for _ in range(rounds):
        if not seen["n"]:
            break
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        before, old = seen, seen["path"]
        stars, seen = written(small, *check)
        drop_table(spark, old)
        if (before["n"], before["x"]) == (seen["n"], seen["x"]):
            break
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
