"""Importance resampling, periodic runs and substring dedup: SQL on the tables, plain loops on made texts, edge cases."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.llm import importance, oracles, periodic_runs, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n\t ", "é☃你​", "x" * 100_000, "a b c " * 5000, "a " * 30_000, "A\r\nB\x0bC\x00", "İ ß K \u0085x y"]


def odd(spark):
    """Odd texts, a repeated row, a null id, two rows of one id, and columns whose names clash with results'."""
    rows = [(i, t, 1.0, "x", 7) for i, t in enumerate(ODD)] + [(5, ODD[5], 1.0, "x", 7), (None, "a b c " * 20, 1.0, "x", 7), (3, "a b c " * 20, 1.0, "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, kept string, rank int")


@pytest.mark.parametrize("query, sql", [(importance.op11, oracles.OP11_SQL), (periodic_runs.op12, oracles.OP12_SQL), (substring_dedup.op13, oracles.OP13_SQL)])
def test_query_equals_sql(query, sql, spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        path = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(got.fetchall(), key=repr)


# Importance resampling


def plain_features(text):
    words = PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resampled(docs, target, share=(5, 100)):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    held = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in held for f in fs), Counter(bucket(f) for x in target for f in plain_features(x)[1])
    a, b = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * a / ((s[k] + 1) * b))) for k in {*s, *t}}
    out = []
    for i, n, fs in held:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = order[: share[0] * len(order) // share[1]]
    return sorted(out), drawn


def test_resampling_equals_plain_loops(spark):
    draw = np.random.default_rng(5)
    text = lambda n, low, high: " ".join(f"W{x}é" if x % 7 == 0 else f"w{x}" for x in draw.integers(low, high, n))
    docs = [(i, text(int(draw.integers(0, 60)), 0, 40)) for i in range(300)] + [(1000 + i, text(30, 500, 540)) for i in range(40)] + list(enumerate(ODD, 2000))
    target = [text(40, 500, 540) for _ in range(9)] + [None, ""]
    want, drawn = plain_resampled(docs, target, (20, 100))
    rows = importance.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), (20, 100)).collect()
    assert sorted(tuple(r)[:5] for r in rows) == want
    assert [r.doc_id for r in sorted((r for r in rows if r.rank), key=lambda r: r["rank"])] == [x[0] for x in drawn]
    assert sum(1000 <= x[0] < 1040 for x in drawn) >= 38  # those that look like the target are drawn first


def test_a_tuple_is_hashed_once_and_joins_back():
    texts = [b"a b a b a", b"", b"B a  b", b"a\xc3\xa9-a"]
    sizes, buckets, place = importance.features(texts, 1 << 32, 3)
    assert sizes.tolist() == [5, 0, 3, 2]
    want = Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in plain_features(t.decode())[1])
    assert Counter(zip(place.tolist(), buckets.tolist(), strict=True)) == want


def test_resampling_of_odd_rows_and_empty_tables(spark):
    target = spark.createDataFrame([("a b c",)], "text string")
    rows = importance.resampled(odd(spark), target, (100, 100)).collect()
    assert len(rows) == len(ODD) + 3 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 6))
    assert {(r.n_features, r.weight) for r in rows if r.doc_id in (0, 1, 2)} == {(0, 0)}
    assert importance.resampled(odd(spark), target.limit(0), (100, 100)).count() == len(ODD) + 3
    assert importance.resampled(odd(spark).limit(0), target).count() == 0


# Periodic runs


def plain_runs(words):
    """Every period's maximal stretches; the smallest period of each counts."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def some_texts(draw):
    def pieces():
        out = []
        for _ in range(int(draw.integers(1, 5))):
            root = draw.integers(0, int(draw.integers(1, 6)), int(draw.integers(1, 14))).tolist()
            out += (root * 40)[: int(draw.integers(1, 90))]
            out += draw.integers(0, 50, int(draw.integers(0, 9))).tolist()
        return [b"w%d" % x for x in out]

    fibonacci = [b"a", b"ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    return [pieces() for _ in range(150)] + [[bytes([c]) for c in fibonacci[-1]], [], [b"x"], [b"a"] * 700, [b"a", b"b"] * 13, ([b"a"] * 30 + [b"b"]) * 4]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_plain_loops(seed):
    texts = some_texts(np.random.default_rng(seed))
    of, *columns = (x.tolist() for x in periodic_runs.runs(texts))
    got = [[] for _ in texts]
    for d, *r in zip(of, *columns, strict=True):
        got[d].append(tuple(r))
    assert got == [plain_runs(w) for w in texts]


def test_a_very_long_text_gives_the_same_runs(monkeypatch):
    texts = some_texts(np.random.default_rng(3))
    want = [x.tolist() for x in periodic_runs.runs(texts)]
    monkeypatch.setattr(periodic_runs, "MANY", 10)
    assert [x.tolist() for x in periodic_runs.runs(texts)] == want


def test_range_minima_equal_plain_loops():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 1000, 700)
    low = draw.integers(0, 700, 3000)
    high = np.minimum(low + draw.integers(0, 700, 3000), 699)
    assert periodic_runs.Minima(values).least(low, high).tolist() == [int(values[a : b + 1].min()) for a, b in zip(low, high, strict=True)]


def test_collapsed_texts_and_the_greatest_exponent(spark):
    draw = np.random.default_rng(9)
    texts = [" ".join(w.decode() for w in words) for words in some_texts(draw)]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, text in enumerate(texts):
        words, r = text.split(), got[i]
        own = plain_runs(words)
        gone = {k for s, n, p in own for k in range(s + p, s + n)}
        best = min(own, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r.n_runs == len(own) and r.collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest()


def test_runs_of_odd_rows_and_empty_tables(spark):
    got = periodic_runs.periodic_runs(odd(spark)).collect()
    assert len(got) == len(ODD) + 3
    of = {r.doc_id: r for r in got if r.doc_id != 3}
    assert (of[0].n_runs, of[0].collapsed, of[6].length, of[6].collapsed, of[5].period) == (0, "", 30_000, "a", 3)
    assert of[None].exponent_milli == 20_000
    assert periodic_runs.periodic_runs(odd(spark).limit(0)).count() == 0
    assert periodic_runs.planted(odd(spark)).count() == len(ODD) + 3


# Substring dedup


def plain_without(docs, least=13):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for s in range(len(w) - least + 1) if i is not None else ():
            key = tuple(w[s : s + least])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = {k for s in range(len(w) - least + 1) if i is not None and first[tuple(w[s : s + least])] < i for k in range(s, s + least)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def repeats(docs, spark, least=13):
    rows = substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), True, least).collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in rows)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


@pytest.mark.parametrize("least, seed", [(13, 1), (13, 2), (7, 3)])
def test_repeats_equal_plain_loops(least, seed, spark):
    """Copies, passages in many surroundings, few words (anchors that many documents share in different surroundings), repeats inside documents."""
    draw = np.random.default_rng(seed)
    text = lambda n, words: [f"w{x}" for x in draw.integers(0, words, n)]
    passages = [text(int(draw.integers(8, 80)), 300) for _ in range(6)]
    docs = []
    for i in range(160):
        w = text(int(draw.integers(0, 60)), 400)
        for _ in range(int(draw.integers(0, 4))):
            p = passages[int(draw.integers(0, 6))]
            a = int(draw.integers(0, len(p)))
            w = w + p[a : a + int(draw.integers(1, 60))] + text(int(draw.integers(0, 9)), 400)
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(text(60, 2))) for i in range(60)]
    docs += [(300 + i, " ".join(passages[i % 6] * 3)) for i in range(12)]
    assert repeats(docs, spark, least) == plain_without(docs, least)


def test_hot_anchors_in_different_surroundings_keep_every_link(spark):
    """A phrase of seven words in all documents; only pairs of documents share a window, none with the leader."""
    draw = np.random.default_rng(4)
    hot = [f"h{x}" for x in range(7)]
    around = lambda: [f"u{x}" for x in draw.integers(0, 10**9, 8)]
    docs = []
    for i in range(150):
        left, right = around(), around()
        docs += [(2 * i, " ".join(left + hot + right)), (2 * i + 1, " ".join(around() + left[-3:] + hot + right[:4] + around()))]
    got = repeats(docs, spark)
    assert got == plain_without(docs) and sum(r[2] > 0 for r in got) == 150


def test_repeats_of_odd_rows_and_empty_tables(spark):
    frame = odd(spark)
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    got = substring_dedup.without_repeats(frame).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == plain_without(docs)
    assert substring_dedup.without_repeats(frame.limit(0)).count() == 0


def test_shares_of_a_hot_copy_group(spark):
    """A third of all rows are copies of one text: all but the smallest id lose it whole."""
    text = " ".join(f"c{i}" for i in range(40))
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat_ws(" ", *(F.sha2(F.concat("id", F.lit(f"-{j}")), 256) for j in range(15)))).alias("text"))
    out = substring_dedup.without_repeats(rows, texts=False)
    assert out.where("n_removed = 40").count() == 299 and out.where("n_removed > 0").count() == 299
