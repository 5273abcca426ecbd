"""SentencePiece encoding by sampled segmentations without replacement, and decoding.

A text (a space put before it, every space written as the vocabulary's mark) is a lattice: its pieces are edges
between character positions. A segmentation's probability is in proportion to the product of its pieces' weights;
the vocabulary's pieces are ranked, so a piece of rank r weighs 1 / (r + 2) of their sum (Zipf's law).
Characters that are no piece are one edge made of their bytes' pieces.

`samples` distinct segmentations of the whole text are the first ones of an A-star search over regions of the
lattice that are perturbed by Gumbel noise. A region's largest perturbed log-probability is Gumbel at the
log of its mass, and is known before the region is opened; the best region is opened, its best segmentation drawn
and emitted, and what is left of the region becomes a region again, bounded by the value just emitted. This is
sampling without replacement in the order of the perturbed values. Each sample carries its log-probability, its
perturbed value and its inclusion score 1 - exp(-exp(log-probability - threshold)), the chance of a value over the
first one that was not emitted (1 where every segmentation was). Noise comes from a counter-based generator
that is seeded by row key, sample and position, so results do not depend on partitions.

No piece holds a space behind another character, a line feed, or letters beside other characters, so the lattice falls
into units (spaces and the letters or the signs behind them) and a unit's table serves all its places in a batch. Units have any length: in
scripts without spaces they reach from sign to sign, and every edge of theirs counts. The masses of units longer than PLAIN
characters carry an exponent of their own.

Each sample is also decoded: its crc32, and whether it is the text again, are returned beside it.

Defined results: null or empty text has one segmentation, the empty one; repeated rows with one doc_id get
equal samples; a null doc_id seeds like 0; an empty table gives an empty result; further columns are ignored.
Texts that hold the mark U+2581 itself decode to a space there, as the vocabulary has it.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import batched, letters, mixed, read, slices
from tickforge.llm.tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of a unit whose masses fit a double whatever they are.
PLAIN = 32
SLOTS = 20
SPACE, LINE, LETTER, SIGN = range(4)
FACTOR = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes whose units share a lattice.
STEP_TEXT = 3 << 20


class Vocabulary:
    """The pieces, their weights, and a table from hashes of code points to pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.surface: list[bytes] = [b""] * size
        self.bytes_of = np.zeros(256, np.int64)
        texts, ids, rank = [], [], {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[int(piece[1:-1], 16)] = i
                self.surface[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                texts.append(piece)
                ids.append(i)
                self.surface[i] = piece.replace(MARK, " ").encode()
            rank[i] = i
        self.longest = max(map(len, texts))
        # Where no piece mixes letters with other characters, the lattice also falls apart between them.
        apart = not any(len({c.isalpha() for c in t.strip(MARK)}) > 1 for t in texts)
        assert not any("\n" in t or MARK in t.lstrip(MARK) for t in texts), "pieces cross units"
        self.kinds = np.where(letters() if apart else True, LETTER, SIGN).astype(np.uint8)
        self.kinds[[ord(MARK), ord("\n")]] = SPACE, LINE
        self.known = self._multipliers(64)
        weights = 1 / (np.arange(size) + 2.0)
        self.weights = weights / weights.sum()
        hashes = np.array([self._hash([ord(c) for c in t]) for t in texts], np.uint64)
        slots = self._slots(hashes)
        order = np.argsort(slots, kind="stable")
        self.hashes, self.ids = np.append(hashes[order], np.uint64(0)), np.append(np.array(ids, np.int32)[order], np.int32(-1))
        self.first = np.full(1 << SLOTS, len(ids), np.int32)
        self.first[slots[order][::-1]] = np.arange(len(ids))[::-1]
        self.deep = int(np.bincount(slots).max())

    @staticmethod
    def _multipliers(n: int) -> np.ndarray:
        return np.random.default_rng(1).integers(1, 1 << 63, (2, n), np.uint64) * np.uint64(2) + np.uint64(1)

    def multipliers(self, n: int) -> np.ndarray:
        return self.known if n <= self.known.shape[1] else self._multipliers(n)

    @staticmethod
    def _hash(points: list[int]) -> int:
        h = 0
        for p in points:
            h = (h * int(FACTOR) + p + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return (((hashes ^ (hashes >> np.uint64(29))) * SPREAD) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 for none."""
        out = np.full(len(hashes), -1, np.int32)
        at = self.first[self._slots(hashes)]
        open_ = np.flatnonzero(at < len(self.ids) - 1)
        for k in range(self.deep):
            place = np.minimum(at[open_] + k, len(self.ids) - 1)
            hit = self.hashes[place] == hashes[open_]
            out[open_[hit]] = self.ids[place[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """The lattices of distinct units, one after another: a node for each character and one behind the last."""

    def __init__(self, words: Vocabulary, points: np.ndarray, sizes: np.ndarray):
        codes, units = points.astype(np.uint64), len(sizes)
        self.start = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.start + sizes
        n = int(sizes.sum())
        left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(n)).astype(np.int32)
        node = (np.arange(n) + np.repeat(np.arange(units), sizes)).astype(np.int32)
        begins, lengths, pieces, missing = [], [], [], np.empty(0, np.int32)
        live, h = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64)
        for length in range(1, words.longest + 1):
            h = h * FACTOR + codes[live + (length - 1)] + np.uint64(1)
            piece = words.found(h)
            hit = piece >= 0
            begins.append(live[hit])
            lengths.append(np.full(len(begins[-1]), length, np.int32))
            pieces.append(piece[hit])
            if length == 1:
                missing = live[~hit]
            more = left[live] > length
            live, h = live[more], h[more]
            if not len(live):
                break
        bytes_ = [words.bytes_of[list(chr(int(points[i])).encode("utf-8", "replace"))].tolist() for i in missing.tolist()]
        begins.append(missing)
        lengths.append(np.ones(len(missing), np.int32))
        length, begin = np.concatenate(lengths), np.concatenate(begins)
        weight = np.concatenate([words.weights[p] for p in pieces] + [np.array([float(np.prod(words.weights[b])) for b in bytes_])])
        #: An edge's id, or -1 - its place in `spelled`.
        piece = np.concatenate([*pieces, -1 - np.arange(len(missing), dtype=np.int32)])
        # Edges by their begin: each length's edges go behind the shorter ones of the same begin.
        base = np.cumsum(held := np.bincount(begin, minlength=n)) - held
        order = np.empty(len(begin), np.int64)
        at = 0
        for own in begins:
            order[at : at + len(own)] = base[own]
            base[own] += 1
            at += len(own)
        self.piece, self.to, self.begin = np.empty(len(begin), np.int32), np.empty(len(begin), np.int32), np.empty(len(begin), np.int32)
        scaled, remaining = np.empty(len(begin)), np.empty(len(begin), np.int32)
        self.piece[order], self.begin[order], self.to[order] = piece, node[begin], node[begin] + length
        scaled[order], remaining[order] = weight * np.exp2(10.0 * np.arange(words.longest + 1))[length], left[begin]
        self.spelled, from_node = bytes_, self.begin
        starts = np.zeros(n + units, np.int64)
        starts[node] = held
        self.first = np.append(0, np.cumsum(starts))
        # Masses of what lies behind each node, scaled by a factor per character so that none vanishes.
        mass = np.zeros(n + units)
        mass[self.end] = 1.0
        longest = int(remaining.max(initial=0))
        by_left = np.argsort(remaining.astype(np.int16) if longest < 1 << 15 else remaining, kind="stable")
        bounds = np.searchsorted(remaining[by_left], np.arange(1, longest + 2))
        if longest <= PLAIN:
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = by_left[a:b]
                np.add.at(mass, from_node[own], scaled[own] * mass[self.to[own]])
            self.chance = scaled * mass[self.to] / mass[from_node]
        else:
            # A mass is times 2 ** power; powers are set anew every PLAIN characters.
            power = np.zeros(n + units, np.int32)
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = by_left[a:b]
                nodes, to = from_node[own], self.to[own]
                np.add.at(mass, nodes, np.ldexp(scaled[own] * mass[to], power[to] - power[nodes + 1]))
                power[nodes] = power[nodes + 1]
                if i % PLAIN == PLAIN - 1:
                    once = np.unique(nodes)
                    mass[once], more = np.frexp(mass[once])
                    power[once] += more
            self.chance = np.ldexp(scaled * mass[self.to] / mass[from_node], power[self.to] - power[from_node])
        total = np.cumsum(self.chance)
        self.upto = total - (np.append(0, total)[self.first[:-1]])[from_node]
        filled = self.first[1:] > self.first[:-1]
        self.upto[self.first[1:][filled] - 1] = 2.0  # rounding never leaves a node without a choice
        #: What an edge's node offers besides it; exactly 0 where that is nothing.
        self.rest = 1 - self.chance
        single = self.first[1:] - self.first[:-1] == 1
        self.rest[self.first[:-1][single]] = 0
        self.chance[self.first[:-1][single]] = 1
        self.logs = np.log(self.chance)


def noise(key: np.ndarray | np.uint64, sample: int, step: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from row key, sample and step."""
    with np.errstate(over="ignore"):
        x = mixed(mixed(key + np.uint64(sample + 1) * SPREAD) + step.astype(np.uint64) * SPREAD)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def drawn(lattice: Lattice, unit: np.ndarray, key: np.ndarray, offset: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """A segmentation of every unit's place: (edges in text order, edges per place); offset: of its first character in its text."""
    at, end = lattice.start[unit], lattice.end[unit]
    live, rounds, lengths = np.arange(len(unit)), [], np.zeros(len(unit), np.int64)
    while len(live):
        u = noise(key[live], sample, offset[live] + len(rounds))
        e = lattice.first[at]
        behind = np.flatnonzero(u >= lattice.upto[e])
        while len(behind):
            e[behind] += 1
            behind = behind[u[behind] >= lattice.upto[e[behind]]]
        rounds.append((live, e))
        lengths[live] += 1
        at = lattice.to[e]
        more = at < end[live]
        live, at = live[more], at[more]
    begins = np.cumsum(lengths) - lengths
    edges = np.empty(int(lengths.sum()), np.int64)
    for i, (who, e) in enumerate(rounds):
        edges[begins[who] + i] = e
    return edges, lengths


def bounded(location: float, limit: float, u: float) -> float:
    """A Gumbel value at `location` that lies under `limit`."""
    free = location - math.log(-math.log(u))
    return -float(np.logaddexp(-limit, -free)) if limit < math.inf else free


class Region:
    """Segmentations like `edges` up to some step from `since` on, with another edge there; at `since` the edges `out` are left out too."""

    def __init__(self, lattice: Lattice, edges: np.ndarray, since: int, prefix: float, out: frozenset[int]):
        self.edges, self.since, self.out = edges, since, out
        steps = np.cumprod(lattice.chance[edges[since:]])
        #: Probability of the steps before each one, and of all.
        self.before = np.empty(len(steps))
        self.before[0], self.before[1:] = prefix, prefix * steps[:-1]
        rest = lattice.rest[edges[since:]]
        if out:
            rest = rest.copy()
            node = int(lattice.begin[edges[since]])
            others = set(range(int(lattice.first[node]), int(lattice.first[node + 1]))) - out - {int(edges[since])}
            rest[0] = lattice.chance[list(others)].sum() if others else 0
        self.mass = self.before * rest


def completed(lattice: Lattice, node: int, end: int, key: np.uint64, sample: int, step: int) -> list[int]:
    """Edges drawn from a node to its unit's end."""
    out = []
    while node < end:
        u = float(noise(key, sample, np.array([step + len(out)]))[0])
        e = int(lattice.first[node])
        while u >= lattice.upto[e]:
            e += 1
        out.append(e)
        node = int(lattice.to[e])
    return out


def search(lattice: Lattice, unit: np.ndarray, draws: list[tuple[np.ndarray, np.ndarray]], key: np.uint64, samples: int) -> tuple[list[tuple[np.ndarray, float, float]], float]:
    """([(edges, log-probability, perturbed value)], first value not emitted) for one text; draws: a fresh segmentation per sample."""
    ends = lattice.end[unit]
    numbers = noise(key, 1 << 20, np.arange(4 * samples + 4))
    top = bounded(0.0, math.inf, float(numbers[0]))
    heap: list[tuple[float, int, Region | None]] = [(-top, 0, None)]
    out: list[tuple[np.ndarray, float, float]] = []
    used = 1
    while heap and len(out) < samples:
        negative, _, region = heapq.heappop(heap)
        value, fresh, lengths = -negative, draws[len(out)][0], draws[len(out)][1]
        if region is None:
            edges, since, prefix, barred = fresh, 0, 1.0, frozenset()
        else:
            # Which step the best segmentation leaves the parent's at, and by which edge.
            total = np.cumsum(region.mass)
            i = int(min(np.searchsorted(total, numbers[used] * total[-1], side="right"), np.flatnonzero(region.mass)[-1]))
            since = region.since + i
            barred = (region.out if i == 0 else frozenset()) | {int(region.edges[since])}
            node = int(lattice.begin[region.edges[since]])
            choices = [e for e in range(int(lattice.first[node]), int(lattice.first[node + 1])) if e not in barred]
            weights = np.cumsum(lattice.chance[choices])
            edge = choices[min(int(np.searchsorted(weights, numbers[used + 1] * weights[-1], side="right")), len(choices) - 1)]
            used += 2
            # The units before the step stay, this one is completed, those behind are the fresh ones.
            w = int(np.searchsorted(region.ends_at, since, side="right"))
            tail = completed(lattice, int(lattice.to[edge]), int(ends[w]), key, len(out), (1 << 40) + since)
            edges = np.concatenate([region.edges[:since], np.array([edge, *tail]), fresh[int(lengths[: w + 1].sum()) :]])
            prefix = float(region.before[i])
            lengths = np.concatenate([region.lengths[:w], [since - int(region.lengths[:w].sum()) + 1 + len(tail)], lengths[w + 1 :]])
            region.mass[i] = 0
            if (left := float(region.mass.sum())) > 0:
                heapq.heappush(heap, (-bounded(math.log(left), value, float(numbers[used])), len(out) * 2 + 1, region))
            used += 1
        rest = Region(lattice, edges, since, prefix, barred)
        rest.lengths, rest.ends_at = lengths, np.cumsum(lengths)
        out.append((edges, float(lattice.logs[edges].sum()), value))
        if (left := float(rest.mass.sum())) > 0:
            heapq.heappush(heap, (-bounded(math.log(left), value, float(numbers[used])), len(out) * 2, rest))
        used += 1
    return out, -heap[0][0] if heap else -math.inf


class Units:
    """The units of texts: `codes` and `sizes` of the distinct ones, `unit` and `offset` of every place, `count` of places per text."""

    def __init__(self, words: Vocabulary, texts: list[str]):
        whole = "".join([" " + t for t in texts if t])
        codes = np.frombuffer(whole.replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        kind = words.kinds[codes]
        here, before = kind[1:], kind[:-1]
        new = np.ones(len(codes), bool)
        new[1:] = (here == LINE) | (before == LINE) | ((here != before) & (before != SPACE))
        begins = np.append(0, ends[:-1])
        new[begins[begins < len(codes)]] = True
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(codes)))
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        self.count = np.diff(np.append(0, np.searchsorted(starts, ends)))
        self.offset = starts - np.repeat(begins, self.count)
        multipliers = words.multipliers(int(sizes.max(initial=0)))
        values = codes.astype(np.uint64) + np.uint64(1)
        h1, h2 = (np.add.reduceat(values * m[place], starts) if len(starts) else np.empty(0, np.uint64) for m in multipliers)
        _, at, self.unit = np.unique(h1, return_index=True, return_inverse=True)
        if (h2[at][self.unit] != h2).any():
            _, at, self.unit = np.unique(np.stack([h1, h2], axis=1), axis=0, return_index=True, return_inverse=True)
        self.sizes = sizes[at]
        inside = np.arange(int(self.sizes.sum())) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.codes = codes[np.repeat(starts[at], self.sizes) + inside]


def segmented(texts: list[str], keys: np.ndarray, path: str, samples: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, its samples: (piece ids, log-probability, perturbed value, inclusion score)."""
    words = vocabulary(path)
    units = Units(words, texts)
    unit, count = units.unit, units.count
    lattice = Lattice(words, units.codes, units.sizes)
    ends = np.cumsum(count)
    key = np.repeat(keys, count)
    draws = [drawn(lattice, unit, key, units.offset, j) for j in range(samples)]
    cuts = [np.append(0, np.cumsum(d[1])) for d in draws]
    for i, n in enumerate(count.tolist()):
        if not n:
            yield [(np.empty(0, np.int64), 0.0, 0.0, 1.0)]
            continue
        a, b = int(ends[i]) - n, int(ends[i])
        own = [(d[0][c[a] : c[b]], d[1][a:b]) for d, c in zip(draws, cuts, strict=True)]
        found, limit = search(lattice, unit[a:b], own, keys[i], samples)
        out = []
        for edges, log_p, value in found:
            ids = lattice.piece[edges]
            if (ids < 0).any():
                ids = np.array([x for p in ids.tolist() for x in ([p] if p >= 0 else lattice.spelled[-1 - p])], np.int64)
            out.append((ids, log_p, value, -math.expm1(-math.exp(min(log_p - limit, 50.0)))))
        yield out


def decoded(ids: np.ndarray, path: str) -> bytes:
    """The UTF-8 text of piece ids, without the space put before it."""
    surface = vocabulary(path).surface
    return b"".join(map(surface.__getitem__, ids.tolist()))[1:]


def row_keys(ids: list[int | None]) -> np.ndarray:
    return mixed(np.array([(x or 0) & 0xFFFFFFFFFFFFFFFF for x in ids], np.uint64) + SPREAD)


def encoded(docs: DataFrame, path: str, samples: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per document and sample: (doc_id, sample, n_pieces, ids_crc32, log_prob, perturbed, inclusion, decoded_crc32, round_trip[, ids]).

    decoded_crc32 is that of the decoded sample, round_trip whether it is the text (the mark being a space).
    """
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_TEXT):
            texts = [t or "" for t in part.column(1).to_pylist()]
            rows: list[list] = [[] for _ in names]
            docs_ = part.column(0).to_pylist()
            for doc, text, own in zip(docs_, texts, segmented(texts, row_keys(docs_), path, samples), strict=True):
                raw = text.replace(MARK, " ").encode()
                for j, (ids, log_p, value, inclusion) in enumerate(own):
                    back = decoded(ids, path)
                    row = (doc, j, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), log_p, value, inclusion, zlib.crc32(back), back == raw, ids.astype(np.int32) if with_ids else None)
                    for column, x in zip(rows, row, strict=False):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=False)], names)

    return batched(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def texts_of(rows: DataFrame, path: str) -> DataFrame:
    """Decoding: rows (..., ids array<int>) with text instead of ids."""
    kept = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column(part.schema.get_field_index("ids")).to_pylist()
            text = [None if x is None else decoded(np.array(x, np.int64), path).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(text, pa.string())], [*kept, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept), "text string"])
    return rows.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path(MODEL), samples=2, with_ids=False)
