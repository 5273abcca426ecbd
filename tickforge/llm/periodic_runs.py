"""Maximal periodic runs of words, by the runs theorem.

Every run's root that is a Lyndon word (in one of the two orders of the words, each the other's reverse) is the longest Lyndon word
that begins at some place. So a text of n words has at most 2 n candidates (place, length):

1. Suffixes are sorted by doubling, for the words' order, for its reverse, and for the text read backwards. Words have numbers per
   document, and a document's suffixes stay apart from the others' that are sorted with it.
2. The longest Lyndon word at a place ends before the next smaller value of the inverse suffix array.
3. A root at i of length p is extended to the right by the longest common prefix of the suffixes at i and i + p, to the left by that
   of the backward ones: the least of the LCP array between their ranks, a range minimum over blocks and a sparse table of blocks' minima.
4. A run of three periods or more holds a root that is followed by itself, so a root that is not is dropped before step 3's left side. The
   extended roots that are long enough are the runs, each once. A Lyndon word has no border, so its length is the smallest period.

Texts are sorted a STEP_BYTES block at a time inside a task; memory is linear in a block, or in a longer text alone.

Defined results: null, empty or wordless texts have no runs and the hash of an empty text; every row is on its own (repeated rows, ties and
shared or null ids have no effect on others); of runs with the same exponent the one that begins first, then the shorter period counts;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import STEP_BYTES, batched, read, slices, utf8

#: A run has so many words, and so many periods, at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Values of a block of range minima.
BLOCK = 16
#: From so many words together on (one very long text) lists of Python's numbers are done without.
MANY = 1 << 20


def ranks(symbols: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The inverse suffix array of texts laid end to end: of one text's suffixes, a proper prefix comes first.

    symbols: numbers from 0; owner: the text of each place, ascending, and texts are sorted apart from each other; ends: where it ends.
    """
    n = len(symbols)
    key = owner * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key, kind="stable")
    head = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    held = 1
    # A rank is the place of its group's first; only groups of more than one are sorted on.
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_):
        then = open_ + held
        follow = np.where(then < ends[open_], rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.lexsort((follow, rank[open_]))
        open_, follow = open_[by], follow[by]
        group = rank[open_]
        first = np.append(True, group[1:] != group[:-1])
        head = first | np.append(True, follow[1:] != follow[:-1])
        begins = np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))
        new = group + np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0)) - begins
        rank[open_] = new
        alone = head & np.append(head[1:], True)
        open_ = open_[~alone]
        held *= 2
    return rank


def items(values: np.ndarray) -> list[int] | memoryview:
    """The values to be read one by one: as a list, which is quicker, or of many in place, which takes no more memory."""
    return values.tolist() if len(values) < MANY else memoryview(values)


def shared_prefixes(symbols: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP array: at rank r, the common words of the suffixes of ranks r - 1 and r (0 across texts).

    In the order of the text a value falls by one at most, so all comparisons together are linear.
    """
    n = len(symbols)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    before = order[np.maximum(rank - 1, 0)]
    text, at, end = items(symbols), items(before), items(ends)
    lcp, h, last = np.zeros(n, np.int64), 0, -1
    out = items(np.zeros(n, np.int64))
    for i in range(n):
        j, stop = at[i], end[i]
        if stop != last:
            h, last = 0, stop
        if end[j] != stop or j == i:
            h = 0
            continue
        most = stop - (i if i > j else j)
        while h < most and text[i + h] == text[j + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    lcp[rank] = np.asarray(out)
    return lcp


class Minima:
    """Range minima of an array in constant time: blocks' own from both ends, and a sparse table over blocks."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        blocks = np.full((-(-n // BLOCK), BLOCK), np.iinfo(np.int64).max)
        blocks.ravel()[:n] = values
        self.values = blocks.ravel()
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(blocks):
            row, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(row[:-half], row[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of values[low..high], both ends included."""
        first, last = low // BLOCK, high // BLOCK
        out = np.empty(len(low), np.int64)
        inside = np.flatnonzero(first == last)
        if len(inside):
            a, b = low[inside], high[inside]
            least = self.values[a]
            for step in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(a + step, b)])
            out[inside] = least
        across = np.flatnonzero(first < last)
        out[across] = np.minimum(self.behind[low[across]], self.ahead[high[across]])
        gap = last - first - 1
        wide = np.flatnonzero(gap > 0)
        level = np.frexp(gap[wide].astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = wide[level == k]
            row = self.table[k]
            out[own] = np.minimum(out[own], np.minimum(row[first[own] + 1], row[last[own] - (1 << int(k))]))
        return out


class Extension:
    """Common words of two suffixes of one text."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, rank: np.ndarray):
        self.rank, self.minima = rank, Minima(shared_prefixes(symbols, ends, rank))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b))


def next_smaller(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The next place in the same text with a smaller value, or the text's end."""
    out, waiting, last = ends.copy(), [], -1
    end, ranked = items(ends), items(values)
    for i, v in enumerate(ranked):
        if end[i] != last:
            waiting, last = [], end[i]
        while waiting and ranked[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def runs(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run, by text, start and period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    flat = [x for w in texts for x in w]
    if not flat:
        return none
    symbols = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = (np.cumsum(sizes) - sizes)[owner]
    ends = starts + sizes[owner]
    place = np.arange(len(flat))
    rank = ranks(symbols, owner, ends)
    forward = Extension(symbols, ends, rank)
    found = []
    for order in (rank, ranks(symbols.max() - symbols, owner, ends)):
        period = next_smaller(order, ends) - place
        at = np.flatnonzero(place + period * 2 <= ends)
        at = at[symbols[at] == symbols[at + period[at]]]
        right = forward.common(at, at + period[at])
        whole = right >= period[at]
        found.append((at[whole], period[at][whole], right[whole]))
    at, period, right = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(at):
        return none
    # Places of the text read backwards: i becomes start + end - 1 - i.
    back = (starts + ends - 1 - place)[at - (at > starts[at])]
    held = np.unique(owner[at])
    pick = np.isin(owner, held)
    shift = np.cumsum(pick) - 1
    turned = symbols[starts + ends - 1 - place][pick]
    back_ends = (np.cumsum(sizes[held]))[np.searchsorted(held, owner[pick])]
    backward = Extension(turned, back_ends, ranks(turned, owner[pick], back_ends))
    left = np.where(at > starts[at], backward.common(shift[back], shift[np.maximum(back - period, 0)]), 0)
    begin, length = at - left, left + period + right
    long = length >= np.maximum(least_words, least_periods * period)
    table = np.unique(np.stack([owner[at], begin - starts[at], period, length], axis=1)[long], axis=0)
    return table[:, 0], table[:, 1], table[:, 3], table[:, 2]


def collapsed(words: list[bytes], own: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run (start, length, period) contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in own:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, x in zip(words, np.cumsum(gone).tolist(), strict=False) if not x]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def periodic_runs(docs: DataFrame, texts: bool = True, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """SCHEMA of docs (doc_id, text): how many runs, the one of greatest exponent, and the text without their repeats (null unless `texts`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            words = [t.split() for t in utf8(part, "text")]
            of, *columns = (x.tolist() for x in runs(words, least_words, least_periods))
            own: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for d, *r in zip(of, *columns, strict=True):
                own[d].append(tuple(r))
            rows = []
            for w, found in zip(words, own, strict=True):
                best = None
                for r in found:  # by start, then period: the first of equals stays
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                kept = b" ".join(collapsed(w, found) if found else w)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.string() if i >= 5 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True)))], [f.split()[0] for f in SCHEMA.split(", ")])

    docs = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, SCHEMA)


def repeated(words: list[bytes], h: int) -> list[bytes]:
    """The words with a tail that repeats a stretch of them, where h is divisible by 10 (a stated rule for checks)."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a periodic tail in each text whose crc32(doc_id) is divisible by 10; others stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids = part.column(0).to_pylist()
            sums = [1 if i is None else zlib.crc32(str(i).encode()) for i in ids]
            texts = [t if h % 10 else b" ".join(repeated(t.split(), h)) for t, h in zip(utf8(part, "text"), sums, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(planted(read(spark, sf_dir, "documents", "doc_id", "text")), texts=False).drop("collapsed")
