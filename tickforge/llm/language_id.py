"""Language identification by cross-parsing.

A suffix automaton is built over labelled text of each language. A text is then parsed with each automaton into
longest matches, as in Ziv-Merhav cross-parsing: a phrase ends where the automaton has no transition, and the next
one starts there. Phrases times log2 of the automaton's text length, over the text's length, estimate the cross
entropy; the language with the least wins, ties go to the name that sorts first.

Texts are lower-cased (Unicode); letters that a language's labelled text holds are symbols of their own to its automaton, all other
letters are one symbol that it never has, and whatever is no letter is one more symbol. Whole texts are parsed,
in windows of WINDOW characters that all advance together: a window starts in the state in which the one before it ended,
and where that state turns out otherwise than taken at first, the window is parsed again. So the phrases are exactly those of one pass over the text.

An automaton is a dense table of states by symbols where the languages' letters together are DENSE or fewer, and otherwise a hash
table of its transitions, which is of the size of the labelled text whatever the script.

Training takes `most_chars` characters of a language at most, out of about `most_rows` documents (those of least
hash), and from each of these `passages` stretches of `passage` characters evenly over the whole text (all of a shorter one), so it is
bounded at any size but for the number of languages; everything that is labelled is counted.

Defined results: null text and text without a letter give `und` and score 0; without labelled text all give
`und`; repeated rows and null ids are predicted each, repeated labelled texts are learnt once; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import batched, letters, mixed, read, slices

UNKNOWN = "und"
#: Letters of all languages together, up to which their automata are dense tables.
DENSE = 126
WINDOW = 256
#: Rounds in which a text's windows fall in step, and the length from which a run of one symbol is searched for cycles.
ROUNDS, LONG_RUN = 12, 64
#: Symbols 0 and 1: letters that no labelled text holds, and whatever is no letter.
FOREIGN, OTHER = 0, 1


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (state, symbol, next state) of the suffix automaton of one sequence; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for s in symbols:
        new = len(following)
        following.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at >= 0 and s not in following[at]:
            following[at][s] = new
            at = link[at]
        if at >= 0:
            to = following[at][s]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                twin = len(following)
                following.append(dict(following[to]))
                link.append(link[to])
                longest.append(longest[at] + 1)
                while at >= 0 and following[at].get(s) == to:
                    following[at][s] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    edges = np.array([(state, s, to) for state, own in enumerate(following) for s, to in own.items()], np.int32).reshape(-1, 3)
    return edges[:, 0], edges[:, 1], edges[:, 2]


class Steps:
    """An automaton's moves, one way for dense and hashed tables: state and symbol to the next state, and whether a phrase starts.

    States are numbers that `move` takes back; `begin` is that of a phrase's end, where every symbol starts a phrase,
    also one that the automaton never saw.
    """

    def __init__(self, edges: tuple[np.ndarray, np.ndarray, np.ndarray], width: int):
        state, symbol, to = (x.astype(np.int64) for x in edges)
        end = int(max(state.max(initial=0), to.max(initial=0))) + 1
        start = np.full(width, end, np.int64)
        start[symbol[state == 0]] = to[state == 0]
        self.width = width
        if width <= DENSE + 2:
            table = np.zeros((end + 1, width), np.int32)
            table[state, symbol] = to
            # 2 * width * next state, plus 1 where a new phrase starts there.
            self.table = np.where(table == 0, 2 * width * start[None, :] + 1, 2 * width * table).astype(np.int32).ravel()
            self.begin = 2 * width * end
            self.move = self.dense
            return
        self.start, self.begin, self.move = 2 * start + 1, 2 * end, self.hashed
        key = state * width + symbol
        self.mask = (1 << max(4, int(len(key) * 4).bit_length())) - 1
        self.keys, self.next = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        self.deep, slot, open_ = 0, self.slots(key), np.arange(len(key))
        while len(open_):
            free = open_[self.keys[slot[open_]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.next[slot[taken]] = key[taken], 2 * to[taken]
            left = np.ones(len(key), bool)
            left[taken] = False
            open_ = open_[left[open_]]
            slot[open_] = (slot[open_] + 1) & self.mask
            self.deep += 1

    def slots(self, key: np.ndarray) -> np.ndarray:
        return (mixed(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def dense(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.table[(at >> 1) + symbols]

    def one(self, at: int, symbol: int) -> int:
        """One move from one state."""
        if self.move == self.dense:
            return int(self.table[(at >> 1) + symbol])
        return int(self.hashed(np.array([at]), np.array([symbol]))[0])

    def hashed(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = (at >> 1) * self.width + symbols
        slot, out, open_ = self.slots(key), self.start[symbols], np.arange(len(key))
        for _ in range(self.deep):
            found = self.keys[slot]
            hit = found == key[open_]
            out[open_[hit]] = self.next[slot[hit]]
            more = ~hit & (found >= 0)
            open_, slot = open_[more], (slot[more] + 1) & self.mask
            if not len(open_):
                break
        return out


def phrases_of(symbols: np.ndarray, steps: Steps) -> int:
    """Phrases of one text in order. In a long run of one symbol states come again, and whole cycles are counted at once."""
    heads = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(symbols) else np.empty(0, np.int64)
    at, phrases = steps.begin, 0
    for symbol, size in zip(symbols[heads].tolist(), np.diff(np.append(heads, len(symbols))).tolist(), strict=True):
        seen: dict[int, tuple[int, int]] | None = {} if size > LONG_RUN else None
        i = 0
        while i < size:
            if seen is not None and at in seen:
                before, counted = seen[at]
                times = (size - i) // (i - before)
                phrases, i, seen = phrases + times * (phrases - counted), i + times * (i - before), None
                continue
            if seen is not None:
                seen[at] = (i, phrases)
            got = steps.one(at, symbol)
            phrases, at, i = phrases + (got & 1), got & ~1, i + 1
    return phrases


def parsed(windows: np.ndarray, lengths: np.ndarray, steps: Steps, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases begun, last state) of each window (a column of symbols per position; lengths fall) that starts in state `at`."""
    at, phrases = at.copy(), np.zeros(windows.shape[1], np.int64)
    for row, live in zip(windows, np.searchsorted(-lengths, -np.arange(len(windows)), side="left"), strict=True):
        if not live:
            break
        got = steps.move(at[:live], row[:live])
        phrases[:live] += got & 1
        at[:live] = got & ~1
    return phrases, at


def learnt(docs: DataFrame, most_rows: int = 256, most_chars: int = 40_000, passages: int = 5, passage: int = 500) -> dict:
    """The model from labelled documents (doc_id, text, lang): (name, symbols, automaton's edges, its text's length) of each language."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {"names": [], "symbols": [], "edges": [], "sizes": []}
    # A share of each language's documents by hash: about most_rows of them, however many there are.
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most_rows / n)))), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    spare = F.char_length("text") - passage
    stretches = F.concat_ws(" ", *(F.substring(F.col("text"), F.floor(spare * i / max(passages - 1, 1)).cast("int") + 1, F.lit(passage)) for i in range(passages)))
    text = F.when(F.char_length("text") <= passages * passage, F.col("text")).otherwise(stretches)
    sample = known.where(place < share).select("lang", F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id", text.alias("text")).collect()
    texts: dict[str, dict[str, None]] = {lang: {} for lang in counts}
    for row in sorted(sample, key=lambda r: (r["h"], r["doc_id"], r["text"])):
        if sum(map(len, texts[row["lang"]])) < most_chars:
            texts[row["lang"]][row["text"]] = None
    names = sorted(lang for lang, own in texts.items() if own)
    whole = [points(" ".join(texts[lang])[:most_chars]) for lang in names]
    found = [np.unique(own[letters()[own]]).astype(np.int64) for own in whole]
    together = np.unique(np.concatenate(found))
    symbols = [together] * len(names) if len(together) <= DENSE else found
    model = {"names": names, "symbols": symbols, "edges": [], "sizes": [max(2, len(own)) for own in whole]}
    for own, letters_ in zip(whole, symbols, strict=True):
        model["edges"].append(automaton([s for s in classes(letters_)[own].tolist() if s != FOREIGN]))
    return model


def classes(symbols: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    table = np.where(letters(), FOREIGN, OTHER).astype(np.uint8 if len(symbols) <= 254 else np.int32)
    table[symbols] = np.arange(2, 2 + len(symbols))
    return table


class Windows:
    """A batch of texts, cut into windows that are sorted by falling length."""

    def __init__(self, texts: list[str | None]):
        coded = [points(t or "") for t in texts]
        self.chars = np.array([len(c) for c in coded])
        self.flat = np.concatenate(coded) if coded else np.empty(0, np.uint32)
        ends = np.cumsum(self.chars)
        found = np.append(0, np.cumsum(letters()[self.flat]))
        self.lettered = found[ends] > found[ends - self.chars]
        windows = -(-self.chars // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = (ends - self.chars)[owner] + nth * WINDOW
        size = np.minimum(WINDOW, ends[owner] - begin)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.owner, self.begin, self.size = owner[order], begin[order], size[order]
        #: The place of the window before each one, -1 for a text's first.
        self.before = np.where(nth > 0, np.append(0, place)[:-1], -1)[order] if len(order) else np.empty(0, np.int64)

    def board(self, table: np.ndarray) -> np.ndarray:
        """The symbols, a row per position of the windows."""
        self.symbols = table[self.flat]
        padded = np.append(self.symbols, np.zeros(WINDOW, table.dtype))
        rows = int(self.size.max(initial=0))
        out = np.zeros((rows, len(self.owner)), table.dtype)
        for i in range(rows):
            out[i] = padded[self.begin + i]
        return out

    def phrases(self, board: np.ndarray, steps: Steps) -> np.ndarray:
        """Phrases of each text, as one pass over it has them.

        Windows are parsed together from guessed states, and again where the window before ends in another one. A text that does not settle in
        ROUNDS of this (its windows never fall in step, as with tables of figures) is parsed in order.
        """
        at = np.full(len(self.owner), steps.begin, np.int64)
        count, last = parsed(board, self.size, steps, at)
        ends = np.cumsum(self.chars)
        for turn in itertools.count():
            enters = np.where(self.before >= 0, last[self.before], steps.begin)
            again = np.flatnonzero(enters != at)
            if not len(again) or turn == ROUNDS:
                out = np.bincount(self.owner, count, int(len(self.chars)))
                for i in np.unique(self.owner[again]).tolist():
                    out[i] = phrases_of(self.symbols[ends[i] - self.chars[i] : ends[i]], steps)
                return out
            at[again] = enters[again]
            count[again], last[again] = parsed(board[:, again], self.size[again], steps, at[again])


def bits_of(texts: list[str | None], model: dict, automata: list[Steps], tables: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, chars, lettered): the cost of each text (row) in each language (column), its length, whether it has a letter."""
    cut, boards = Windows(texts), {}
    bits = []
    for symbols, steps, n in zip(model["symbols"], automata, model["sizes"], strict=True):
        key = symbols.tobytes()
        if key not in boards:
            boards = {key: cut.board(tables[key])}
        bits.append(cut.phrases(boards[key], steps) * math.log2(n))
    return np.stack(bits, axis=1), cut.chars, cut.lettered


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text, ...) with lang_pred and score instead of text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in batched(docs).columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = own["names"]
        tables = {s.tobytes(): classes(s) for s in own["symbols"]}
        automata = [Steps(e, 2 + len(s)) for e, s in zip(own["edges"], own["symbols"], strict=True)]
        for part in slices(batches, "text"):
            lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            if names:
                bits, chars, lettered = bits_of(part.column(part.schema.get_field_index("text")).to_pylist(), own, automata, tables)
                best = bits.argmin(axis=1)
                # Each language's weight falls with its excess bits; the square root keeps long texts off the ends.
                excess = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(np.maximum(chars, 1))[:, None]
                share = 1 / np.exp2(-np.minimum(excess, 60)).sum(axis=1)
                lang = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                score = np.where(lettered, share, 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(lang, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "lang_pred string, score double"])
    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents (doc_id, text, lang); one in four (crc32) is held out of learning."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learnt(docs.where(~held))
    return predicted(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
