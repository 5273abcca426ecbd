"""MinHash near-dedup with bottom-k sketches of one hash function.

Every document keeps the `k` least hash values of its set of shingles. Documents with equal sets are first put
together. The `indexed` least values of the others go to inverted lists. Two sets at the threshold have `shared` of
these values in common at least (of sets of equal size all but 4 pairs in a thousand million; where one set holds the other, all but 4 in a
million, by the binomial; surely, where sets are small), so a document only needs the lists of its rarest values, all but `shared` - 1 of them: any such pair still meets in one of them, and a passage that many texts
share lists none of them unless the text is mostly made of it. Three passes follow.

1. Overlaps in the lists: each document is paired with that list leader (smallest id) with which it shares most
   lists, so linear in the lists; the union-sketch estimate filters, exact Jaccard on the full sets confirms.
2. Lists of at most `long_list` documents: pairs of different components so far, the estimate filters, exact
   Jaccard confirms.
3. Longer lists: those outside a list's largest component (the strays) are compared with all of the list, in blocks of
   bounded size. Inside a block the estimate picks who is open, and full sets decide; a block returns a spanning
   forest of its links, never its pairs.

Pairs inside one component need no comparison, as only components are returned. Tables of a pass are dropped when
the last reader is done.

Defined results: null or blank text has an empty set and links with nothing; rows with a null
doc_id link with nothing and are kept; rows that share a doc_id count as one document with what any of them links; an empty
table gives an empty result; very long texts are one row each, taken whole; further columns are ignored. Ties have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import batched, connected_components, drop_table, hash_words, mixed, ngram_hashes, read, slices, utf8, written

SHINGLE = 5
SIMILAR = (75, 100)
#: Flipped, so that the order of hashes is also that of the signed values in sketches.
SIGN = np.uint64(1 << 63)


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of n-word windows; a shorter text is one shingle as a whole."""
    if 0 < len(words) < n:
        total = np.array([len(words)], np.uint64)
        for i in range(len(words)):
            total = mixed(total + words[i : i + 1] * np.uint64(2 * i + 3))
        return total
    found = np.sort(ngram_hashes(words, n))
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """A set for each UTF-8 text: A-Z lower-cased, words split at ASCII white space."""
    words = [t.lower().split() for t in texts]
    ends = np.cumsum([0] + [len(w) for w in words])
    hashes = hash_words([x for w in words for x in w])
    return [shingle_set(hashes[ends[i] : ends[i + 1]]) for i in range(len(words))]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, h1, h2, sketch): set size, two hashes of the whole set, and its k least values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(utf8(part, "text"))
            h1 = np.array([int(np.bitwise_xor.reduce(mixed(s))) if len(s) else 0 for s in sets], np.uint64)
            h2 = np.array([int(np.add.reduce(mixed(s ^ np.uint64(0x9E3779B97F4A7C15)))) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([(s[:k] ^ SIGN).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n", "h1", "h2", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def estimated(k: int) -> Column:
    """The union-sketch estimate from sketches sa and sb: of the k least values of the union, the share in both."""
    union = F.array_union("sa", "sb")
    both = F.array_intersect(F.slice(F.sort_array(union), 1, k), F.array_intersect("sa", "sb"))
    return F.size(both) / F.least(F.lit(k), F.size(union))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; texts (doc_id, text) holds the candidates.

    Only b's text is shuffled with the pair, so b should be the side with fewer pairs.
    """
    named = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ta", 2 << 20, 500):
            left, right = utf8(part, "ta"), utf8(part, "tb")
            unseen = list({*left, *right})
            sets = dict(zip(unseen, shingle_sets(unseen), strict=True))
            held = []
            for a, b in zip(left, right, strict=True):
                a, b = sets[a], sets[b]
                both = len(np.intersect1d(a, b, assume_unique=True))
                held.append(bool(both) and SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(held))

    return both.mapInArrow(run, "a long, b long")


def open_pairs(pairs: DataFrame, sketches_: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) whose union-sketch estimate reaches `least`."""
    named = lambda x: sketches_.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}"))
    return pairs.join(named("b"), "b").join(named("a"), "a").where(estimated(k) >= least).select("a", "b").distinct()


def prefixes(real: DataFrame, copies: DataFrame, indexed: int, shared: int) -> DataFrame:
    """(value, doc_id, n): the lists each document needs, by its rarest values first."""
    lone = real.select("doc_id", "n", "h1", "h2", F.slice("sketch", 1, indexed).alias("values"))
    lone = lone.join(copies.select("doc_id", "h1", "h2"), ["doc_id", "h1", "h2"], "left_anti")
    posted = lone.select("doc_id", "n", "h1", "h2", F.explode("values").alias("value"))
    lists = posted.groupBy("value").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    own = posted.join(lists, "value").groupBy("doc_id", "h1", "h2").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.struct("docs", "value"))).alias("own"))
    need = F.least(F.lit(shared), F.ceil(F.least("n", F.lit(indexed)) * (SIMILAR[0] / SIMILAR[1])).cast("int"))
    more = F.size("own") - need + 1
    return own.where(more > 0).select("doc_id", "n", F.explode(F.slice("own", 1, F.greatest(more, F.lit(1)))).alias("at")).select(F.col("at.value").alias("value"), "doc_id", "n").distinct()


def spanning(near: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (child, parent) that join what a symmetric matrix of links joins, a tree for each component."""
    open_ = near.any(axis=1)
    out = []
    while open_.any():
        frontier = np.array([int(np.argmax(open_))])
        open_[frontier] = False
        while len(frontier):
            links = near[frontier]
            reached = np.flatnonzero(links.any(axis=0) & open_)
            out.append((reached, frontier[links[:, reached].argmax(axis=0)]))
            open_[reached] = False
            frontier = reached
    return out


def estimates(one: np.ndarray, sets: list[np.ndarray], k: int) -> np.ndarray:
    """The union-sketch estimate of one sorted sketch against each of a block's sketches, all of k values at most."""
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.searchsorted(one, flat)
    both = (at < len(one)) & (one[np.minimum(at, len(one) - 1)] == flat)
    so_far = np.cumsum(both)
    before = so_far - both - np.append(0, so_far)[np.cumsum(sizes) - sizes][owner]
    total = np.bincount(owner, both, len(sets))
    width = np.minimum(k, sizes + len(one) - total)
    return np.bincount(owner, both & (place + at - before < width[owner]), len(sets)) / width


def linked(strays: list[np.ndarray], members: list[np.ndarray]) -> np.ndarray:
    """Whether each stray's full set (row) and each member's (column) reach the similarity."""
    sets = strays + members
    sizes = np.array([len(x) for x in sets], np.int64)
    values, spot = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(spot, minlength=len(values)) > 1
    row = np.repeat(np.arange(len(sets)), sizes)[held[spot]]
    column = (np.cumsum(held) - 1)[spot[held[spot]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(strays), len(members)), np.float32)
    for at in range(0, int(held.sum()), 2048):
        own = slice(*np.searchsorted(column, [at, at + 2048]))
        table = np.zeros((len(sets), 2048), np.float32)
        table[row[own], column[own] - at] = 1
        both += table[: len(strays)] @ table[len(strays) :].T
    near = (SIMILAR[0] + SIMILAR[1]) * both.astype(np.int64) >= SIMILAR[0] * (sizes[: len(strays), None] + sizes[None, len(strays) :])
    return near & (both > 0)


def block_links(rows: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b): a spanning forest of the links between the strays and the members of each block of rows (value, i, j, stray, doc_id, component, members)."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in block["members"]]
        ids, parts, stray = block["doc_id"].to_numpy(), block["component"].to_numpy(), block["stray"].to_numpy()
        a, b = np.flatnonzero(stray), np.flatnonzero(~stray)
        none = pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        if not len(a) or not len(b):
            return none
        sketches_ = [x[:k] for x in sets]
        others = [sketches_[i] for i in b]
        open_ = np.stack([estimates(sketches_[i], others, k) >= least for i in a]) & (parts[a][:, None] != parts[b][None, :])
        a, b = a[open_.any(axis=1)], b[open_.any(axis=0)]
        if not len(a):
            return none
        near = linked([sets[i] for i in a], [sets[i] for i in b]) & (ids[a][:, None] != ids[b][None, :])
        square = np.zeros((len(a) + len(b),) * 2, bool)
        square[: len(a), len(a) :] = near
        square[len(a) :, : len(a)] = near.T
        edges, names = spanning(square), ids[np.append(a, b)]
        child, parent = (np.concatenate([names[e[side]] for e in edges] or [ids[:0]]) for side in (0, 1))
        return pd.DataFrame({"a": np.minimum(child, parent), "b": np.maximum(child, parent)})

    return rows.groupBy("value", "i", "j").applyInPandas(run, "a long, b long")


def full_sets(texts: DataFrame) -> DataFrame:
    """(doc_id, members) of texts (doc_id, text): the sorted hashes of the whole set, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(utf8(part, "text"))], pa.binary())], ["doc_id", "members"])

    return texts.mapInArrow(run, "doc_id long, members binary")


def blocks_of(long: DataFrame, sets: DataFrame, members: int, strays: int, shingles: int) -> DataFrame:
    """Rows of block_links for lists (value, doc_id, n, component, main, docs, away, longest): every stray of a list meets all of the list in some block.

    A block has about `members` documents and `strays` strays, fewer where sets are large (`shingles` together).
    """
    stray = F.col("component") != F.col("main")
    sides = lambda count, most: F.ceil(F.greatest(count / most, count * F.col("longest") / shingles)).cast("int")
    rows = long.withColumn("p", sides(F.col("docs"), members)).withColumn("q", sides(F.col("away"), strays))
    side = lambda count: F.pmod(F.xxhash64("doc_id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    keys = ["value", "doc_id", "component"]
    as_member = rows.select(*keys, F.lit(False).alias("stray"), side("p").alias("j"), every("q").alias("i"))
    as_stray = rows.where(stray).select(*keys, F.lit(True).alias("stray"), every("p").alias("j"), side("q").alias("i"))
    return as_member.unionByName(as_stray).join(sets, "doc_id")


def near_duplicates(docs: DataFrame, k: int = 64, indexed: int = 16, shared: int = 4, slack: float = 0.25, long_list: int = 64, members: int = 2048, strays: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text).

    k: values retained in a sketch; indexed: of them, those with inverted lists; shared: of these, what a pair at the
    threshold has in common at least; slack: how far under the threshold (by the estimate) exact checks go
    (4.6 standard deviations at k = 64); long_list: a list with more documents is compared in blocks of
    `members` documents by `strays` strays.
    """
    spark = docs.sparkSession
    docs = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = SIMILAR[0] / SIMILAR[1] - slack
    spent: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        table, seen = written(df)
        spent.append(seen["path"])
        return table

    rows = kept(sketches(docs, k))
    real = rows.where("doc_id is not null and n > 0")
    alike = real.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = kept(real.select("doc_id", "h1", "h2", "n").join(alike, ["h1", "h2", "n"]).where("doc_id <> rep").select("doc_id", "h1", "h2", "rep"))
    posts = kept(prefixes(real, copies, indexed, shared))
    leaders = posts.groupBy("value").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").select("value", "leader")
    posts = kept(posts.join(leaders, "value"))
    candidates = kept(posts.select("doc_id").distinct())
    texts = kept(docs.join(candidates, "doc_id", "left_semi"))
    values = kept(real.select("doc_id", "sketch").join(candidates, "doc_id", "left_semi"))

    # Pass 1: the leader that a document shares most lists with.
    stars = posts.where("doc_id <> leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    stars = stars.groupBy("b").agg(F.max_by("a", F.struct("lists", -F.col("a"))).alias("a"))
    first = kept(confirmed(open_pairs(stars, values, k, least), texts))
    parts = kept(connected_components(first))

    # What is left: lists with documents of more than one component.
    named = posts.select("value", "doc_id", "n").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    each = named.groupBy("value", "component").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("longest"))
    mixed_lists = each.groupBy("value").agg(F.max_by("component", F.struct("held", -F.col("component"))).alias("main"), F.sum("held").alias("docs"), (F.sum("held") - F.max("held")).alias("away"), F.max("longest").alias("longest")).where("away > 0")
    mixed = kept(named.join(mixed_lists, "value"))

    # Pass 2: short lists, by pairs.
    side = lambda x: mixed.where(F.col("docs") <= long_list).select("value", *(F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "n", "component")))
    pairs = side("l").join(side("r"), "value").where("l_doc_id < r_doc_id and l_component <> r_component and 100 * l_n >= 75 * r_n and 100 * r_n >= 75 * l_n")
    pairs = pairs.select(F.col("l_doc_id").alias("a"), F.col("r_doc_id").alias("b")).distinct()
    second = kept(confirmed(open_pairs(pairs, values, k, least), texts))

    # Pass 3: long lists, in blocks.
    long = mixed.where(F.col("docs") > long_list)
    sets = full_sets(texts.join(long.select("doc_id").distinct(), "doc_id", "left_semi"))
    third = kept(block_links(blocks_of(long, sets, members, strays, 1_500_000), k, least))

    same = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    parts = kept(connected_components(first.union(second).union(third).union(same)))
    out = (
        rows.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    out, _ = written(out)
    for path in spent:
        drop_table(spark, path)
    return out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
