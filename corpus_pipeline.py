"""A training-corpus pipeline of five operators over the documents table.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns the packed
pieces. Toxic documents go, boilerplate lines of a source go, one document of each group of near-duplicates stays,
personal data is written as its kind in angle brackets, and what is left is packed.

Defined results: rows with a null text are kept up to packing, where they are the end id alone (null texts are no
copies of each other); rows with a null source keep all their lines; rows with a null doc_id are judged and packed, but no
copies of others; rows that share a doc_id are one document to the near-duplicate stage and rows of their own to the
others; without labels no document is toxic; an empty table gives an empty result; further columns stay up to packing, whatever
their names; n_chars is counted anew where a stage changes texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import drop_table, read, written
from tickforge.llm.line_dedup import without_boilerplate
from tickforge.llm.minhash_dedup import near_duplicates
from tickforge.llm.packing import packed
from tickforge.llm.pii import redact
from tickforge.llm.tokens import VOCABULARY, vocabulary_path
from tickforge.llm.toxicity import scored, trained

#: A line in more than this share of a source's documents, and in so many of them at least, is boilerplate.
LINE_RATIO, LINE_LEAST = 0.02, 5
#: A line of more words than this is boilerplate in LINE_LEAST different texts of a source, whatever their share.
LONG_WORDS = 50


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0))).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    model = trained(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    name = "score"
    while name in columns:
        name = f"_{name}"
    return scored(docs, model, name).where(F.col(name) < 0.5).select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(without_boilerplate(docs, "source", "text", LINE_RATIO, 20, LINE_LEAST, LONG_WORDS, counts=False), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packed(docs.select("doc_id", "text"), vocabulary_path(VOCABULARY))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]
#: The stages learn weights, hash and tokenise, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs, seen = written(stage(spark, docs, sf_dir))
        if before:
            drop_table(spark, before)
        before = seen["path"]
    return docs
