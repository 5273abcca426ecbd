"""Harmonic packing of documents into sequences of at most `CAPACITY` tokens.

Lengths fall into reciprocal-capacity classes: class k holds documents longer than CAPACITY / (k + 1) and up to
CAPACITY / k, and a bin of class k takes exactly k of them, so no search for a fitting bin is needed and every
worker fills its bins on its own: nothing is shuffled, and a bin never leaves its task. A document longer than the
capacity fills whole bins first. What is left of it, and documents under CAPACITY / CLASSES, are the filler: they are
cut to fill the gap that the k documents of a bin leave. Only where a task has no filler at hand is a document of
the shortest waiting class cut instead. At a task's end the few that wait are laid out one after another, and the
last of them is cut at powers of two.

Padding: a sequence is padded to the capacity unless its length is a power of two; so nothing is padded here.
A task holds fewer than k documents of each class and a filler of FILLER tokens, whatever it reads.

Defined results: null or empty text is a document of the end id alone; repeated rows and null ids are
packed each as a document; very long texts are cut at every CAPACITY ids; an empty table gives an empty result;
further columns are ignored. Which documents share a sequence depends on how the input is split into tasks and on
its order there, the invariants do not; a task that is run again writes all of its sequences again.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import batched, read, slices, utf8
from tickforge.llm.tokens import VOCABULARY, token_ids, vocabulary_path

CAPACITY = 2048
CLASSES = 16
FILLER = 8 * CAPACITY
END = (1).to_bytes(4, "little")
#: Sequences that one task can number.
SEQUENCES = 1 << 40

#: A piece: document, start, its ids (four bytes each), the document's length.
Piece = tuple[int | None, int, memoryview, int]


class Bins:
    """The bins of one task; `rows` holds what was placed since it was last taken: (piece, sequence, offset)."""

    def __init__(self, task: int):
        self.next = task * SEQUENCES
        self.rows: list[tuple[Piece, int, int]] = []
        self.waiting: list[list[Piece]] = [[] for _ in range(CLASSES)]
        self.filler: deque[Piece] = deque()
        self.filling = 0
        self.open, self.used = -1, 0

    def put(self, piece: Piece) -> None:
        self.rows.append((piece, self.open, self.used))
        self.used += len(piece[2]) // 4

    def begin(self) -> None:
        self.open, self.used = self.next, 0
        self.next += 1

    def fill(self, piece: Piece) -> Piece | None:
        """The open bin takes the piece, or as much of it as fits; what does not fit is returned."""
        doc, start, ids, total = piece
        gap = CAPACITY - self.used
        if len(ids) // 4 <= gap:
            self.put(piece)
            return None
        self.put((doc, start, ids[: 4 * gap], total))
        return doc, start + gap, ids[4 * gap :], total

    def close(self) -> None:
        """Fills the open bin's gap; without filler it stays open for the next document."""
        while self.used < CAPACITY:
            if self.filler:
                piece = self.filler.popleft()
                self.filling -= len(piece[2]) // 4
            elif short := next((w for w in reversed(self.waiting) if w), None):
                piece = short.pop()
            else:
                return
            if left := self.fill(piece):
                self.filler.appendleft(left)
                self.filling += len(left[2]) // 4
        self.open = -1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, view, start = len(ids) // 4, memoryview(ids), 0
        if self.open >= 0:
            left = self.fill((doc, 0, view, total))
            if self.used == CAPACITY:
                self.open = -1
            if not left:
                return
            _, start, view, _ = left
        while len(view) >= 4 * CAPACITY:
            self.begin()
            self.put((doc, start, view[: 4 * CAPACITY], total))
            self.open = -1
            view, start = view[4 * CAPACITY :], start + CAPACITY
        if not view:
            return
        rest = len(view) // 4
        if start or CAPACITY // rest >= CLASSES:
            self.filler.append((doc, start, view, total))
            self.filling += rest
            if self.filling > FILLER:
                self.begin()
                self.close()
            return
        own = self.waiting[CAPACITY // rest]
        own.append((doc, 0, view, total))
        if len(own) == CAPACITY // rest:
            self.begin()
            for piece in own:
                self.put(piece)
            own.clear()
            self.close()

    def finish(self) -> None:
        """Lays out what waits; the last bin is cut at powers of two."""
        left = [p for own in self.waiting for p in own] + list(self.filler)
        self.waiting, self.filler = [[] for _ in range(CLASSES)], deque()
        whole = sum(len(p[2]) // 4 for p in left) + (self.used if self.open >= 0 else 0)
        full = whole - whole % CAPACITY
        # A bin that is open already keeps what it has: it is the first of the sequences counted here.
        ends = [CAPACITY] * (full // CAPACITY) + [1 << b for b in range(CAPACITY.bit_length() - 2, -1, -1) if (whole - full) >> b & 1]
        held = self.open >= 0
        if held and not full:
            # Fewer tokens than one bin: its own pieces are laid out anew.
            again = [r for r in self.rows if r[1] == self.open]
            self.rows = [r for r in self.rows if r[1] != self.open]
            left = [r[0] for r in again] + left
            held = False
        queue = deque(left)
        for size in ends:
            if not held:
                self.begin()
            held = False
            while self.used < size:
                doc, start, ids, total = queue.popleft()
                room = 4 * (size - self.used)
                self.put((doc, start, ids[:room], total))
                if len(ids) > room:
                    queue.appendleft((doc, start + room // 4, ids[room:], total))
        self.open = -1


def packed(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of documents (doc_id, text): one row per piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def table(rows: list[tuple[Piece, int, int]]) -> pa.RecordBatch:
        columns = [[p[0] for p, _, _ in rows], [p[1] for p, _, _ in rows], [len(p[2]) // 4 for p, _, _ in rows], [zlib.crc32(p[2]) for p, _, _ in rows], [p[3] for p, _, _ in rows], [s for _, s, _ in rows], [o for _, _, o in rows]]
        arrays = [pa.array(x, pa.int64()) for x in columns]
        return pa.RecordBatch.from_arrays(arrays + [pa.array([bytes(p[2]) for p, _, _ in rows], pa.binary())] * with_ids, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(TaskContext.get().partitionId())
        for part in slices(batches, "text"):
            for doc, ids in zip(part.column(0).to_pylist(), token_ids(utf8(part, "text"), path), strict=True):
                bins.add(doc, ids + END)
            # An open bin's pieces stay until it is full, as a task's last bin may be laid out anew.
            done = [r for r in bins.rows if r[1] != bins.open]
            bins.rows = [r for r in bins.rows if r[1] == bins.open]
            yield table(done)
        bins.finish()
        yield table(bins.rows)

    return batched(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path(VOCABULARY))
