"""Embedding and MinHash near-duplicates against brute force."""

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tickforge.llm import embedding_dedup, minhash_dedup
from tickforge.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def brute_vectors(rows, threshold=0.98):
    links, edges = defaultdict(int), []
    fine = []
    for vec_id, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, float)
            fine.append((vec_id, u / np.linalg.norm(u), label))
    for i, (a, u, x) in enumerate(fine):
        for b, w, y in fine[i + 1 :]:
            if x == y and len(u) == len(w) and float(u @ w) >= threshold:
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    comp = components([r[0] for r in rows], edges)
    return {r[0]: (links[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}


def vectors(n=400, dim=16, seed=3):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.normal(size=dim).tolist(), int(i % 3)) for i in range(n)]
    centre = draw.normal(size=dim)
    for i in range(n, n + 120):  # one clump, some pairs of which lie on either side of the threshold
        rows.append((i, (centre + 0.16 * draw.normal(size=dim)).tolist(), 1))
    rows += [(n + 120 + i, rows[i][1], rows[i][2]) for i in range(5)]  # equal vectors
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [None] + [1.0] * (dim - 1), 1), (903, [float("nan")] * dim, 1), (904, [float("inf")] * dim, 1), (905, rows[0][1], None), (906, [1.0, 0.0], 1), (907, [1.0, 1e-9], 1), (908, [], 1)]
    return rows


def test_embeddings_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, label int, component int, n_links int")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, block=32).collect()}
    assert got == brute_vectors(as_float)


def test_thousands_of_vectors_around_the_threshold(spark):
    draw = np.random.default_rng(11)
    dim, rows = 32, []
    for clump in range(150):  # spread so that cosines within a clump lie on both sides of 0.98
        centre = draw.normal(size=dim)
        for _ in range(20):
            rows.append((len(rows), (centre + draw.uniform(0.03, 0.25) * draw.normal(size=dim)).tolist(), clump % 2))
    rows += [(len(rows) + i, draw.normal(size=dim).tolist(), i % 2) for i in range(1500)]
    rows += [(10_000 + i, rows[i][1], rows[i][2]) for i in range(0, 200, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    ids, label = [r[0] for r in rows], np.array([r[2] for r in rows])
    unit = embedding_dedup.units(np.array([r[1] for r in rows]))
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near)), strict=True)])
    assert near.sum() > 10_000
    assert got == {i: (int(n), comp[i], comp[i] == i) for i, n in zip(ids, near.sum(axis=1), strict=True)}


def test_embeddings_repeated_vec_ids(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(rows).collect()), key=str)
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (None, 3, None, True)]


def test_embedding_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.op1(spark, sf).collect()}
    assert got == brute_vectors(rows)


def test_embeddings_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, component_id long, id long")
    assert embedding_dedup.near_duplicates(df).collect() == []


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(0)
    dim = 64
    a, b = (embedding_dedup.units(draw.normal(size=(1, dim))) for _ in range(2))
    b = embedding_dedup.units(0.9 * a + 0.4 * b)
    found, errors = [], []
    for seed in range(300):
        turns = embedding_dedup.rotations(dim, 1, seed)
        code, factor = embedding_dedup.codes(a, turns)
        direction = (2.0 * code[0] - 1) @ turns.T / np.sqrt(dim)
        found.append(float(direction @ b[0]) / factor[0, 0])
        errors.append(np.sqrt(1 / factor[0, 0] ** 2 - 1) / np.sqrt(dim - 1))
    true = float(a[0] @ b[0])
    assert abs(np.mean(found) - true) < 0.02
    assert np.mean(np.abs(np.array(found) - true) <= 5 * np.array(errors)) == 1.0


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute_documents(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids, edges = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                edges.append((a, b))
    comp = components(ids, edges)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def as_map(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def documents(seed=5):
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: list(draw.choice(words, n))
    rows = [" ".join(text(int(n))) for n in draw.integers(1, 120, 80)]
    for base in ([text(200), text(60), text(12)] * 4):
        for share in (0.0, 0.01, 0.03, 0.05, 0.08):
            own = list(base)
            for k in range(len(own)):
                if draw.random() < share:
                    own[k] = "x" + str(draw.integers(10**6))
            rows.append(" ".join(own))
    boiler = text(40)
    rows += [" ".join(boiler + text(int(n))) for n in draw.integers(1, 60, 90)]  # one passage that many share
    rows += ["a b c", "A b  C", "a b\tc", "", None, "   ", "é È x", "É È x"]
    return list(enumerate(rows))


def test_documents_match_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, component string")
    assert as_map(minhash_dedup.near_duplicates(df)) == brute_documents(rows)
    # Long lists and small blocks reach the same links.
    assert as_map(minhash_dedup.near_duplicates(df, long_list=4, members=8, strays=3)) == brute_documents(rows)


def test_documents_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert as_map(minhash_dedup.op7(spark, sf)) == brute_documents(rows)


def test_documents_empty_null_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(rows).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(1, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 240)) and got[7] == 7


def test_hashes_are_stable():
    assert zlib.crc32(minhash_dedup.shingle_sets([b"a b c d e f"])[0].tobytes()) == zlib.crc32(minhash_dedup.shingle_sets([b"A B\nc d e F "])[0].tobytes())


def test_sets_that_hold_each_other_at_the_threshold_link(spark):
    """400 pairs of which one set has 300 shingles of the other's 400, a similarity of exactly 0.75; and 400 with 299 of 400, just under it."""
    draw = np.random.default_rng(8)
    rows = []
    for i in range(800):
        words = [f"w{x}" for x in draw.integers(0, 10**9, 404)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 304 if i < 400 else 303]))]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(400) if got[2 * i + 1] != 2 * i] == [] and [i for i in range(400, 800) if got[2 * i + 1] == 2 * i] == []


def test_every_hundredth_document_against_all(spark):
    """Recall on a larger table: each link of an asked document, found over an inverted index of all full sets, joins it."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the larger tables are not there")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    planted = [(100_000 + i, " ".join(w[: 4 + int(round(0.76 * (len(w) - 4)))])) for i, t in docs if i % 100 == 0 and len(w := (t or "").split()) > 40]
    docs += planted
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))) else frozenset() for i, t in docs}
    asked = [i for i in sets if i % 100 == 0 or i >= 100_000]
    wanted = {s for i in asked for s in sets[i]}
    lists = defaultdict(list)
    for i, own in sets.items():
        for s in own & wanted:
            lists[s].append(i)
    links = set()
    for i in asked:
        both = defaultdict(int)
        for s in sets[i]:
            for j in lists[s]:
                both[j] += 1
        links |= {(i, j) for j, n in both.items() if i != j and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)}
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    assert len(links) > 150 and [x for x in links if got[x[0]] != got[x[1]]] == []
