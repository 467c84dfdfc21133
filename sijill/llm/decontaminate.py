"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Every n-gram of a test item is a seed if its words, drawn independently at their corpus rates, would stand together rarely
(``RARE``): a rarity that copies of the item itself cannot spoil, however many there are. An item with few such seeds takes
its rarest ones. Two of its other n-grams at about the same offset count as a seed too. A document that holds a seed is aligned, word by word, with the item around the seed; the local alignment's
score over that of a whole copy is the pair's score. Pairs at ``THRESHOLD`` or more are leaks.

Test items are the query set: they travel to the tasks in blocks of about ``BLOCK`` items or ``BLOCK_CHARS`` characters at most, each
block a pass over the documents, so what is broadcast is bounded whatever the benchmark's size (but for a single item larger
than that). Word rates come from all documents.

Defined cases: null and empty texts have no words and match nothing; items without words match nothing; an item shorter than
a seed is found by its whole word sequence; repeated rows (documents or items) give repeated pairs; other columns are not
looked at (``clean`` passes them on).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, map_rows, read_table

WORD = re.compile(r"[^\W_]+")
SEED = 3
RARE = 1e-9
LEAST_SEEDS = 12
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words by which the offsets of two common n-grams of an item may differ.
NEAR = 3
#: Items, and characters of items, that are sent at once.
BLOCK, BLOCK_CHARS = 5000, 8_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def smith_waterman(item: list[str], passage: list[str]) -> tuple[int, int, int]:
    """The best local alignment's score and its place in the passage (start, end exclusive); of equals the earliest start, then the earliest end.

    A row of the table at a time: a cell holds score * base + (what orders starts), and gaps within a row are a running maximum.
    """
    n, ids = len(passage), {w: k for k, w in enumerate(dict.fromkeys(item))}
    if not n or not item:
        return 0, 0, 0
    base = n + 2
    p = np.fromiter((ids.get(w, -1) for w in passage), dtype=np.int64, count=n)
    hits = {k: np.where(p == k, MATCH, MISMATCH) * base for k in set(p.tolist()) if k >= 0}
    none = np.full(n, MISMATCH * base)
    fresh = base - 1 - np.arange(n + 1, dtype=np.int64)  # score 0, starting here
    slope = -GAP * base * np.arange(n + 1, dtype=np.int64)
    above, best, end = fresh, 0, 0
    for w in item:
        row = fresh.copy()
        np.maximum(above[:-1] + hits.get(ids[w], none), above[1:] + GAP * base, out=row[1:])
        row = np.maximum.accumulate(row + slope) - slope
        above = np.where(row < base, fresh, row)
        j = int(above.argmax())
        if above[j] > best:
            best, end = int(above[j]), j
    return (best // base, base - 1 - best % base, end) if best >= base else (0, 0, 0)


def seeds_of(items: list[list[str]], rate: dict[str, float], size: int = SEED) -> dict[tuple, list[tuple[int, int, bool]]]:
    """N-gram to its (item, position) places, and whether it is rare enough to be a seed by itself."""
    out: dict[tuple, list[tuple[int, int, bool]]] = defaultdict(list)
    for k, w in enumerate(items):
        grams = []
        for i in range(max(1, len(w) - size + 1) if w else 0):
            p = 1.0
            for x in w[i : i + size]:
                p *= rate.get(x, 0.0)
            grams.append((p, i))
        for order, (p, i) in enumerate(sorted(g for g in grams if g[0] > 0)):  # what the corpus lacks a word of is found nowhere
            out[tuple(w[i : i + size])].append((k, i, p <= RARE or order < LEAST_SEEDS))
    return dict(out)


class Finder:
    def __init__(self, items: list[list[str]], rate: dict[str, float], threshold: float):
        self.items, self.threshold = items, threshold
        self.seeds = seeds_of(items, rate)
        self.short = {n: {s for s in self.seeds if len(s) == n} for n in {len(s) for s in self.seeds} if n < SEED}

    def find(self, w: list[str]) -> list[tuple[int, float, int, int]]:
        """(item, score, start, end) of the best place of each item that the document leaks; words, end exclusive."""
        seeds = self.seeds
        hits = [(i, t) for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if t in seeds]
        for n, known in self.short.items():
            hits += [(i, t) for i in range(len(w) - n + 1) if (t := tuple(w[i : i + n])) in known]
        if not hits:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        common: dict[int, set[int]] = defaultdict(set)
        places_of: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, t in hits:
            for k, at, rare in seeds[t]:
                (starts if rare else common)[k].add(i - at)
                if not rare:
                    places_of[k, i - at].add(i)
        for k, offsets in common.items():
            own = sorted(offsets)
            for a, b in zip(own, [*own[1:], None], strict=True):
                if len(places_of[k, a]) > 1 or b is not None and b - a <= NEAR:
                    starts[k].add(a)
        out = []
        for k, places in starts.items():
            item, best = self.items[k], (0, 0, 0)
            n, margin, done = len(item), len(item) // 2 + 2, -1
            exact = next((s for s in sorted(places) if s >= 0 and w[s : s + n] == item), None)
            if exact is not None:
                out.append((k, 1.0, exact, exact + n))
                continue
            for s in sorted(places):
                if s <= done:
                    continue
                a, done = max(0, s - margin), s + margin // 2
                score, x, y = smith_waterman(item, w[a : done + n + margin])
                if score > best[0]:
                    best = (score, a + x, a + y)
            if best[0] >= self.threshold * MATCH * n:
                out.append((k, best[0] / (MATCH * n), best[1], best[2]))
        return out


def word_rates(docs: DataFrame, vocabulary: set[str], text_col: str = "text") -> dict[str, float]:
    """The share of each word of the vocabulary among all words of all documents; each task sends its sums only."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, total = sent.value, Counter(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for t in batch.slice(k, SLICE).column(0).to_pylist():
                    w = words(t)
                    total += len(w)
                    counts.update(known.intersection(w) and [x for x in w if x in known])
        rows = [(None, total), *sorted(counts.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    n = {r["word"]: r["n"] for r in docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = n.pop(None, 0) or 1
    return {w: c / total for w, c in n.items()}


def _finders(docs: DataFrame, benchmark: DataFrame, text_col: str, block: int) -> Iterator[tuple]:
    """For each block of test items a broadcast of (ids, word sequences, word rates)."""
    size = benchmark.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["items"] // block), -(-size["chars"] // BLOCK_CHARS))
    for b in range(blocks):
        own = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = sorted(((r["item_id"], words(r["text"])) for r in own.select(F.col("item_id").cast("long").alias("item_id"), "text").collect()), key=str)
        sequences = [w for _, w in items]
        rate = word_rates(docs, {w for s in sequences for w in s}, text_col)
        yield docs.sparkSession.sparkContext.broadcast(([i for i, _ in items], sequences, rate))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each document and test item that it leaks: doc_id, item_id, score, start_word, end_word."""
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for sent in _finders(x, benchmark, "text", block):

        def make(sent=sent):
            names, sequences, rate = sent.value
            finder = Finder(sequences, rate, threshold)

            def f(docs, texts):
                found = [(d, names[k], s, a, e) for d, t in zip(docs, texts, strict=True) for k, s, a, e in finder.find(words(t))]
                return [list(c) for c in zip(*found, strict=True)] if found else [[] for _ in range(5)]

            return f

        part = map_rows(x, make, "doc_id long, item_id long, score double, start_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs, as they are, that leak no test item."""
    for sent in _finders(docs, benchmark, text_col, block):

        @F.pandas_udf("boolean")
        def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            _, sequences, rate = sent.value  # noqa: B023  pickled at once, below
            finder = Finder(sequences, rate, threshold)
            for texts in batches:
                yield texts.map(lambda t: bool(finder.find(words(t)))).astype(bool)

        docs = docs.where(~leaky(F.col(text_col)))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
