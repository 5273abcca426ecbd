"""Quality rules whose cutoffs are learnt with a limit on false rejections.

Each rule scores a document; a document is rejected if one of its scores lies over that rule's
cutoff in the document's stratum (band of word counts). Labelled documents that pass the base rule are split by hash. On
one third a path of cutoffs is laid for each stratum: from no cutoffs, always the tightening that rejects most
further bad documents per further good one. On the other two thirds the path is walked, and a step is certified as long as the exact
binomial test rejects "more than `alpha` of the stratum's good documents are lost" at level `delta` / strata. The test
is of all rules' losses together, so rules need no correction; along a path the fixed sequence needs none; across strata
Bonferroni's holds. The last certified step's cutoffs act. With probability 1 - delta no stratum loses more than `alpha`.

A stratum needs log(strata / delta) / -log(1 - alpha) good documents among the two thirds at least (80 at alpha and
delta of 0.05, about 120 in all); with fewer, the base rule alone acts there.

Defined results: null or blank text has counts of 0 and fails the base rule; without labels only the
base rule acts; labels that are null or clash within a doc_id are not used; a labelled doc_id counts once, however many
rows it has (the one of the greatest counts); repeated rows and null ids are judged
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import batched, hash_words, mixed, read, slices, utf8, written

LEAST_WORDS = 50
MOST_REPEATED = 50
SYMBOLS = "#*$%&|<>"
WHITE = "\t\n\x0b\x0c\r "
#: Lower ends of the strata, in words.
BANDS = (0, 200, 1000)
#: Cutoffs of a rule.
STEPS = 12
#: Each rule's score, and its cutoffs from strict to lax.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.005 * 1.6**i for i in range(STEPS)]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.075 * i for i in range(1, STEPS + 1)]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.04 * i for i in range(1, STEPS + 1)]),
    "word_length": ("word_chars / greatest(n_words, 1)", [5.0 * 1.19**i for i in range(STEPS)]),
}


def counts(docs: DataFrame) -> DataFrame:
    """The base counts of documents (doc_id, text), whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = utf8(part, "text")
            words = [t.split() for t in texts]
            lengths = np.array([len(w) for w in words])
            hashes = hash_words([x for w in words for x in w])
            doc = np.repeat(np.arange(len(texts)), lengths)
            covered = np.zeros(len(hashes), bool)
            if len(hashes) > 2:
                inside = doc[2:] == doc[:-2]
                key = mixed(mixed(mixed(hashes[:-2] + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + hashes[1:-1]) + hashes[2:])
                at = np.flatnonzero(inside)
                order = at[np.argsort(key[at], kind="stable")]
                equal = key[order[1:]] == key[order[:-1]]
                twice = np.zeros(len(order), bool)
                twice[1:] |= equal
                twice[:-1] |= equal
                for k in range(3):
                    covered[order[twice] + k] = True
            chars, symbols, lines, again = [], [], [], []
            for raw in texts:
                t = raw.decode("utf-8")
                chars.append(len(t) - sum(map(t.count, WHITE)))
                symbols.append(sum(map(t.count, SYMBOLS)))
                full = [x for x in t.split("\n") if x.strip(WHITE)]
                lines.append(len(full))
                again.append(len(full) - len(set(full)))
            repeated = np.bincount(doc[covered], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.asarray(x, np.int64)) for x in (lengths, chars, symbols, again, repeated, lines))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])

    return batched(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials of probability p: small where k losses among n speak against a loss rate of p."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)


def path(over: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float) -> list[tuple[int, ...]]:
    """Cutoff indices per rule (STEPS: none), from lax to strict.

    over: a row per kind of document, a column per rule: how many of the rule's cutoffs its score exceeds; good, bad: documents of the kind.
    A cutoff index i rejects kinds with over > i. Ends where the good ones lost here pass alpha, or nothing bad is left to reject.
    """
    state, steps = (STEPS,) * over.shape[1], []
    while True:
        left = ~(over > np.array(state)).any(axis=1)
        best = None
        for rule in range(over.shape[1]):
            for i in range(state[rule] - 1, -1, -1):
                more = left & (over[:, rule] > i)
                caught, lost = int(bad[more].sum()), int(good[more].sum())
                if caught and (best is None or (caught / (lost + 1), caught, -rule, i) > best[0]):
                    best = (caught / (lost + 1), caught, -rule, i), (*state[:rule], i, *state[rule + 1 :])
        if best is None:
            return steps
        state = best[1]
        steps.append(state)
        if good[(over > np.array(state)).any(axis=1)].sum() > alpha * good.sum():
            return steps


def certified(steps: list[tuple[int, ...]], over: np.ndarray, good: np.ndarray, alpha: float, level: float) -> tuple[int, ...] | None:
    """The last step that the exact test passes, with all before it."""
    total, best = int(good.sum()), None
    for state in steps:
        lost = int(good[(over > np.array(state)).any(axis=1)].sum())
        if not total or lost > alpha * total or binomial_tail(lost, total, alpha) > level:
            break
        best = state
    return best


def learnt(features: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> dict[tuple[int, str], float]:
    """(stratum, rule) to cutoff.

    What the driver gets is a count for each kind of labelled document: fewer than (STEPS + 1) ** rules * strata * 4.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q2")).where("quality = q2")
    overs = F.array(*(sum((F.expr(score) > c).cast("int") for c in cuts) for score, cuts in RULES.values()))
    rows = features.join(known, "doc_id").groupBy("doc_id").agg(F.max(F.struct("n_words", "stratum", overs.alias("over"))).alias("d"), F.first("quality").alias("quality"))
    tuning = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(3)) == 0
    found = rows.groupBy(F.col("d.stratum").alias("stratum"), tuning.alias("tuning"), F.col("d.over").alias("over")).agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") != 1, 1)).alias("bad")).collect()
    out = {}
    for stratum in range(len(BANDS)):
        of = lambda half: sorted((tuple(r["over"]), r["good"], r["bad"]) for r in found if r["stratum"] == stratum and r["tuning"] == half)
        here, there = of(True), of(False)
        if not here or not there:
            continue
        columns = lambda rows: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        over, good, _ = columns(there)
        state = certified(path(*columns(here), alpha), over, good, alpha, delta / len(BANDS))
        for (name, (_, cuts)), i in zip(RULES.items(), state or (), strict=False):
            if i < STEPS:
                out[stratum, name] = cuts[i]
    return out


def judged(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Counts, base_failed, kept and the first rule that rejects each document."""
    stratum = sum((F.col("n_words") >= b).cast("int") for b in BANDS[1:])
    features, _ = written(counts(docs).withColumn("stratum", stratum).withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words")))
    cutoffs = learnt(features.where("not base_failed"), labels, alpha, delta)
    rule = F.when(F.col("base_failed"), "base")
    for (band, name), cut in sorted(cutoffs.items()):
        rule = rule.when((F.col("stratum") == band) & (F.expr(RULES[name][0]) > cut), name)
    return features.withColumn("rule", rule).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rule").isNull().alias("kept"), "rule")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
