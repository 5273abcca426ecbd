"""Embedding near-dedup with randomised-rotation binary codes.

Every distinct vector is scaled to unit length, turned by seeded random rotations, and reduced to the signs of
the turned coordinates (the code) and, for each rotation, the inner product of the vector with its own
code direction (the correction factor).

Candidates are vectors that share one of several bands of code bits; the bands' width grows with the
logarithm of the number of vectors and their number follows, so that a pair at the threshold is missed
with probability `miss`. A pair is looked at in the first band it shares. Buckets carry ids and packed codes only. There,
the codes' differing bits (a binomial count of the angle) rule pairs out beyond `sigmas` standard deviations, and a
bucket returns the vectors that have an open partner, never pairs. Those alone meet again with their vectors: a code, its
factors and the other vector give an unbiased estimate of the inner product, whose error is at most sin(angle) times
what the factors say; where the upper confidence bound lies under the threshold the pair is dropped, the others are
recomputed exactly, in double precision, so no pair below the threshold is ever linked.

Equal vectors of a label are put together first and counted. A bucket with more than `block` vectors is cut into
blocks, and each pair of blocks is a unit of work of its own; what leaves a unit is a count of links per
vector and a spanning forest of its links. (Counting the links of m near, unequal vectors
takes m * m comparisons of codes, dealt over all tasks.)

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a
null label or of another length, link with nothing; repeated rows are vectors of their own that link with
each other; rows with a null vec_id count as links but form no component; an empty table gives an empty
result; further columns are ignored. Ties have no effect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import connected_components, drop_table, forest, read, written

THRESHOLD = 0.98
#: Pairs that one numpy step looks at together.
STEP = 1 << 17


def plan(vectors: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, bands): a pair at the threshold shares no band with probability `miss` at most."""
    bits = min(40, max(8, round(math.log2(max(vectors, 2) / 64))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


@lru_cache(maxsize=4)
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """`count` random orthogonal matrices, side by side: (dim, count * dim)."""
    draw = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(count)], axis=1)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length in double precision, safe for very large and very small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def codes(unit: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits (rows, count * dim) and correction factors (rows, count): the inner product of a unit vector and its code direction."""
    dim = unit.shape[1]
    turned = unit @ turns
    factors = np.abs(turned).reshape(len(unit), -1, dim).sum(axis=2) / math.sqrt(dim)
    return turned >= 0, factors


def usable(embedding: Column) -> Column:
    """Whether the vector has a direction."""
    sane = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(sane & F.exists(embedding, lambda x: x != 0), F.lit(False))


def encoded(vectors: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(id, label, dim, code, factors, keys) of vectors (id, label, embedding); code is padded to whole 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(2)
            dims = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = batch.take(pa.array(at))
                unit = units(own.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim))
                if dim not in made:
                    made[dim] = rotations(dim, -(-max(256, bits * bands) // dim), seed)
                code, factors = codes(unit, made[dim])
                keys = code[:, : bits * bands].reshape(len(at), bands, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                packed = np.packbits(np.pad(code, ((0, 0), (0, -code.shape[1] % 64))), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(np.full(len(at), dim, np.int32)), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array([x.tobytes() for x in factors], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    ["id", "label", "dim", "code", "factors", "keys"],
                )

    return vectors.select("id", "label", F.col("embedding").cast("array<double>")).mapInArrow(run, "id long, label string, dim int, code binary, factors binary, keys array<long>")


def _groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 4096) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by `key`, several groups together; a group is bounded by its block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = table[key][-1]
        same = pa.compute.equal(table[key], last).to_numpy()
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each run [start, end), in steps of bounded size."""
    sizes = ends - starts
    row = np.concatenate([np.arange(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    left = np.repeat(ends, sizes) - row - 1
    at = 0
    total = np.cumsum(left)
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP)))
        n = left[at:to]
        a = np.repeat(row[at:to], n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = to


WORK = ["work", "name", "band", "side", "other", "dim", "id"]


def units_of_work(encodings: DataFrame, block: int, seed: int) -> DataFrame:
    """(work, name, band, side, other, dim, id, code): each vector in every unit of work that it belongs to."""
    bucket = ["label", "dim", "band", "bucket"]
    spread = encodings.select("id", "label", "dim", "code", F.posexplode("keys").alias("band", "bucket"))
    held = encodings.select("label", "dim", F.posexplode("keys").alias("band", "bucket")).groupBy(*bucket).agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    spread = spread.join(held, bucket).withColumn("blocks", F.ceil(F.col("held") / block).cast("int"))
    spread = spread.withColumn("side", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = [*bucket, F.least("side", "other"), F.greatest("side", "other")]
    return spread.select(F.xxhash64(*unit).alias("work"), F.xxhash64(F.lit(seed), *unit).alias("name"), "band", "side", "other", "dim", "id", "code")


class Unit:
    """The rows of one vector length among whole units of work, and the pairs to look at in them."""

    def __init__(self, table: pa.Table, dim: int, bits: int, bands: int):
        work, dims = table["work"].to_numpy(), table["dim"].to_numpy()
        cuts = np.flatnonzero(np.append(True, work[1:] != work[:-1]))
        chosen = dims[cuts] == dim
        # A run of one work key has one length, unless two keys' hashes agree: such rows are passed over in pairs().
        self.rows = np.flatnonzero(dims == dim)
        self.place = np.full(len(work), -1)
        self.place[self.rows] = np.arange(len(self.rows))
        self.starts, self.ends, self.dims, self.dim = cuts[chosen], np.append(cuts[1:], len(work))[chosen], dims, dim
        self.table = table.take(pa.array(self.rows))
        self.name, self.band, self.side, self.other, self.ids = (table[c].to_numpy() for c in ("name", "band", "side", "other", "id"))
        raw = np.frombuffer(b"".join(self.table["code"].to_pylist()), np.uint8).reshape(len(self.rows), -1)
        self.words = raw.view(np.uint64)
        self.bytes = raw
        first = np.unpackbits(raw, axis=1, count=bits * bands).reshape(len(self.rows), bands, bits)
        self.keys = first.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one unit of work, on different sides of it, that share no earlier band; as places among `rows`."""
        for a, b in _pairs(self.starts, self.ends):
            fine = (self.dims[a] == self.dim) & (self.dims[b] == self.dim) & (self.name[a] == self.name[b]) & (self.band[a] == self.band[b])
            fine &= (self.side[a] != self.side[b]) | (self.other[a] == self.side[a]) & (self.other[b] == self.side[b])
            band = self.band[a[fine]]
            a, b = self.place[a[fine]], self.place[b[fine]]
            first = (self.keys[a] == self.keys[b]).argmax(axis=1) == band
            yield a[first], b[first]


def met(batches: Iterator[pa.RecordBatch], bits: int, bands: int) -> Iterator[Unit]:
    for table in _groups(batches, "work"):
        for dim in np.unique(table["dim"].to_numpy()).tolist():
            yield Unit(table, dim, bits, bands)


def most_differing(code_bits: int, threshold: float, sigmas: float) -> float:
    """Differing bits that two codes at the threshold have at most, but for `sigmas` standard deviations."""
    share = math.acos(threshold) / math.pi
    return code_bits * share + sigmas * math.sqrt(code_bits * share * (1 - share)) + 1


def opened(work: DataFrame, bits: int, bands: int, threshold: float, sigmas: float) -> DataFrame:
    """The rows of units of work that have an open partner there, by the codes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in met(batches, bits, bands):
            limit = most_differing(-(-max(256, bits * bands) // unit.dim) * unit.dim, threshold, sigmas)
            open_ = np.zeros(len(unit.rows), bool)
            for a, b in unit.pairs():
                near = np.bitwise_count(unit.words[a] ^ unit.words[b]).sum(axis=1, dtype=np.int64) <= limit
                open_[a[near]] = open_[b[near]] = True
            if open_.any():
                yield from unit.table.select(WORK).filter(pa.array(open_)).combine_chunks().to_batches()

    return work.select(*WORK, "code").mapInArrow(run, "work long, name long, band int, side int, other int, dim int, id long")


def links(work: DataFrame, bits: int, bands: int, threshold: float, sigmas: float, seed: int) -> DataFrame:
    """(a, b, n) of open rows with copies, code, factors and embedding: for b null, n copies are linked with a; otherwise an edge of the spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in met(batches, bits, bands):
            dim, rows, ids = own.dim, len(own.rows), own.table["id"].to_numpy()
            copies = own.table["copies"].to_numpy()
            unit = units(own.table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, dim))
            factors = np.frombuffer(b"".join(own.table["factors"].to_pylist()), np.float64).reshape(rows, -1)
            turns = factors.shape[1]
            signs = np.unpackbits(own.bytes, axis=1, count=turns * dim)
            directions = (2.0 * signs.reshape(rows, turns, dim) - 1) / (math.sqrt(dim) * factors[:, :, None])
            # The code directions turned back and averaged: their product with a vector estimates the vectors' own.
            turned = directions.reshape(rows, -1) @ rotations(dim, turns, seed).T / turns
            # What is off lies across the vector, so a pair at the threshold sees at most sin(angle) of it.
            error = 1e-9 + sigmas * math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 / factors**2 - 1).mean(axis=1) / max(dim - 1, 1) / turns)
            counts = np.zeros(rows, np.int64)
            left, right = [], []
            for a, b in own.pairs():
                upper = np.einsum("ij,ij->i", turned[a], unit[b]) + error[a]
                a, b = a[upper >= threshold], b[upper >= threshold]
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                a, b = a[near], b[near]
                np.add.at(counts, a, copies[b])
                np.add.at(counts, b, copies[a])
                left.append(a)
                right.append(b)
            if not left:
                continue
            some = np.flatnonzero(counts)
            edges = forest(rows, np.concatenate(left), np.concatenate(right))
            a = np.concatenate([ids[some], ids[[x for x, _ in edges]] if edges else np.empty(0, np.int64)])
            b = pa.array([None] * len(some) + [int(ids[y]) for _, y in edges], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), b, pa.array(np.concatenate([counts[some], np.zeros(len(edges), np.int64)]))], ["a", "b", "n"])

    return work.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = 1e-4, sigmas: float = 5.0, block: int = 512, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("exact"), F.col("embedding"))
    linked = F.col("label").isNotNull() & usable(F.col("exact"))
    # -0.0 and 0.0 are one value; equal vectors of a label have equal keys.
    plain = F.transform("exact", lambda x: x + F.lit(0.0))
    keys = rows.select("vec_id", linked.alias("linked"), F.xxhash64("label", plain).alias("h1"), F.xxhash64(F.lit(seed), "label", plain).alias("h2"))
    spent: list[str] = []

    def kept(df: DataFrame, *observed) -> tuple[DataFrame, dict]:
        table, seen = written(df, *observed)
        spent.append(seen["path"])
        return table, seen

    keys, _ = kept(keys)
    reps = rows.where(linked).select("vec_id", "label", "embedding", F.xxhash64("label", plain).alias("h1"), F.xxhash64(F.lit(seed), "label", plain).alias("h2"))
    reps = reps.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    # The table, once written, keeps these ids.
    reps, seen = kept(reps.withColumn("id", F.monotonically_increasing_id()), F.count(F.lit(1)).alias("n"))
    bits, bands = plan(seen["n"], threshold, miss)
    encodings, _ = kept(encoded(reps, bits, bands, seed))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), seen["n"] // 20000)
    dealt = lambda df: df.repartition(parts, "work").sortWithinPartitions("work", "id")
    work, _ = kept(opened(dealt(units_of_work(encodings, block, seed)), bits, bands, threshold, sigmas))
    about = encodings.select("id", "code", "factors").join(reps.select("id", "copies", "embedding"), "id")
    full = work.join(about, "id").select(*WORK, "copies", "code", "factors", "embedding")
    found, _ = kept(links(dealt(full), bits, bands, threshold, sigmas, seed))
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("near"))
    # Components are named by their smallest vec_id: edges between the representatives' least ids.
    named = reps.where("least is not null").select("id", "least")
    edges = found.where("b is not null").join(named.select(F.col("id").alias("a"), F.col("least").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("least").alias("y")), "b")
    parts_of, _ = kept(connected_components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    about = reps.join(counts, "id", "left").join(parts_of.withColumnRenamed("node", "least"), "least", "left").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component"))
    own = keys.where("linked").join(about, ["h1", "h2"]).select("vec_id", "n_links", F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component")), "vec_id").alias("component_id"))
    alone = keys.where("not linked").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out, _ = written(own.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
    for path in spent:
        drop_table(spark, path)
    return out


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
