"""The pipeline's stages on the small table, and what each must hold."""

from pyspark.sql import functions as F

import corpus_pipeline
from tickforge.llm import pii

NAMES = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines int, n_dropped int, row string, kept string, h string"


def through(spark, rows, sf):
    docs = spark.createDataFrame(rows, NAMES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [x.split()[0] for x in NAMES.split(", ")], name
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, sf)


def test_edge_cases(spark, sf):
    extra = ("en", "s", 0, 0.9, 1, 2, "r", "k", "h")
    assert [df.collect() for df in through(spark, [], sf)] == [[], []]
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(10**9 + 1, None, *extra), (None, "a null id " + long[:300], *extra), (10**9 + 2, "", *extra), (10**9 + 3, long, *extra), (10**9 + 4, long + " end", *extra), (10**9 + 5, "mail jane@example.com now", *extra), (10**9 + 5, "mail jane@example.com now", *extra)]
    docs, packed = through(spark, rows, sf)
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()), key=str)
    assert [r[0] for r in got] == [10**9 + 1, 10**9 + 2, 10**9 + 3, 10**9 + 5, 10**9 + 5, None]
    assert got[0][1] is None and got[2][1] == long and got[3] == (10**9 + 5, "mail <email> now", 16)
    assert {r["doc_id"] for r in packed.collect()} == {r[0] for r in got}


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "pii", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        assert ids <= kept
        if i in (1, 3, 4):
            assert ids == kept
        if i < 4:
            assert docs.columns == columns
        kept = ids
        if name == "pii":
            assert not any(pii.base_spans(r["text"] or "") for r in docs.select("text").collect())
    again = corpus_pipeline.run(spark, sf)
    # Which documents share a sequence, and so where they are cut, depends on the files of the stage before.
    sums = lambda df: sorted((r["doc_id"], r["doc_tokens"], r["n"]) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect())
    assert sums(again) == sums(docs)
