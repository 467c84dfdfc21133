"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text. A text is parsed greedily into the longest phrases that the automaton
has; the language that needs fewest phrases, normalised for the length of its automaton's text, wins (few phrases: low cross
entropy). Texts are folded to letters and single blanks and cut into segments of ``SEGMENT`` characters, all of which are
parsed; segments of many texts walk the automata in step, one numpy operation for each character position.

Fitting reads a bounded sample of labelled rows in one pass (``max_docs`` for each language, ``max_chars`` characters of each language's
text, taken from all over the documents); only rows whose crc32(id) mod 4 is not 2 and that have a language teach. Language, source and id are no inputs of a
prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled row all texts are ``und``;
ties go to the alphabetically first language; an empty table gives an empty result; repeated rows are predicted row by row; other columns are not looked at.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read_table
from .toxicity import held_out

UNKNOWN = "und"
SEGMENT = 512
#: Places of a labelled document that its share is taken from.
SLICES = 4
#: Segments that walk in step.
BATCH = 4096


def fold(text: str | None) -> str:
    """Lower-case letters; everything between them as one blank."""
    s = (text or "").lower()
    return " ".join("".join(c if c.isalpha() else " " for c in s).split()) if not s.isalpha() else s


class FastFold:
    """fold() by a translation table that learns each character once."""

    def __init__(self):
        self.table: dict[int, str] = _Letters()

    def __call__(self, text: str | None) -> str:
        return " ".join((text or "").lower().translate(self.table).split())


class _Letters(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = c if c.isalpha() else " "
        return self[code]


def automaton(text: str, symbols: dict[str, int]) -> list[dict[int, int]]:
    """The suffix automaton of the text: the edges of each state, by symbol. State 1 is the root, state 0 none."""
    nexts: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in text:
        a = symbols[c]
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and a not in nexts[p]:
            nexts[p][a] = cur
            p = link[p]
        if p:
            q = nexts[p][a]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nexts[p].get(a) == q:
                    nexts[p][a] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Rows:
    """The edges of many states in one array: a state is named by its place, and its edge by symbol a stands a places after it.

    An entry holds the state that it belongs to and the one that it leads to, so a step is one lookup and a comparison. Rows
    interleave: each goes to the first of a sequence of random places where its symbols are free, in an array of four places
    an edge. So the size grows with the number of edges, not with states times symbols, whatever the alphabet.
    """

    def __init__(self, nexts: list[dict[int, int]], width: int):
        rng, size = random.Random(1), 4 * max(len(nexts), sum(map(len, nexts))) + 2 * width
        taken, named = bytearray(size), bytearray(size)
        named[0] = 1  # place 0 is no state
        self.place = [0] * len(nexts)
        for s in sorted(range(1, len(nexts)), key=lambda s: (-len(nexts[s]), s)):
            b = rng.randrange(size - width)
            while named[b] or any(taken[b + a] for a in nexts[s]):
                b = rng.randrange(size - width)
            self.place[s], named[b] = b, 1
            for a in nexts[s]:
                taken[b + a] = 1
        self.entries = np.zeros(size, dtype=np.int64)
        for s, e in enumerate(nexts):
            for a, t in e.items():
                self.entries[self.place[s] + a] = self.place[s] << 32 | self.place[t]


class Parser:
    """The automata of all languages as one, so that a step of all segments in all languages is a few lookups."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.symbols = {c: k + 1 for k, c in enumerate(sorted(set("".join(texts.values()))))}
        nexts: list[dict[int, int]] = [{}]
        roots = []
        for x in self.languages:
            roots.append(len(nexts) + 1)
            at = len(nexts)
            nexts += [{a: t + at for a, t in e.items()} for e in automaton(texts[x], self.symbols)]
        self.rows = Rows(nexts, len(self.symbols) + 1)
        self.roots = np.array([self.rows.place[r] for r in roots], dtype=np.int64)
        self.per_phrase = np.array([math.log2(max(2, len(texts[x]))) for x in self.languages])
        self.codes = _Codes(self.symbols)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states; 0 where there is no edge."""
        e = self.rows.entries.take(state + symbol)
        return np.where(e >> 32 == state, e & 0xFFFFFFFF, 0)

    def phrases(self, segments: list[str]) -> np.ndarray:
        """Phrases of each segment in each language. A character that no automaton has is a phrase of its own."""
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        n = np.array([len(segments[i]) for i in order])
        grid = np.zeros((len(segments), n[0] if len(n) else 0), dtype=np.int64)
        for row, i in enumerate(order):
            s = segments[i]
            grid[row, : len(s)] = np.frombuffer(s.translate(self.codes).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        grid = np.ascontiguousarray(grid.T)
        roots = self.roots[:, None]
        first = np.stack([self.step(np.full(len(self.symbols) + 1, r), np.arange(len(self.symbols) + 1)) for r in self.roots]) if len(self.roots) else None
        state = np.repeat(roots, len(segments), axis=1)
        count = np.ones((len(self.languages), len(segments)), dtype=np.int32)
        live = len(segments)
        for t in range(len(grid)):
            while live and n[live - 1] <= t:
                live -= 1
            a = grid[t, :live]
            new = self.step(state[:, :live], a)
            ended = new == 0
            count[:, :live] += ended
            new = np.where(ended, first[:, a], new)
            np.copyto(state[:, :live], np.where(new == 0, roots, new))
        out = np.empty((len(segments), len(self.languages)), dtype=np.int64)
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None], fold=fold) -> tuple[list[str], list[float]]:
        folded = [fold(t) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        owner, segments = [], []
        for i, s in enumerate(folded):
            for k in range(0, len(s), SEGMENT):
                owner.append(i)
                segments.append(s[k : k + SEGMENT])
        total = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for k in range(0, len(segments), BATCH):
            np.add.at(total, owner[k : k + BATCH], self.phrases(segments[k : k + BATCH]))
        bits = total * self.per_phrase
        best = bits.argmin(axis=1)
        names, scores = [], []
        for i, s in enumerate(folded):
            if not s:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            row = bits[i]
            # the share of the evidence that the winner has, from the bits a character that each language needs
            share = np.exp2(-(row - row[best[i]]) / max(8.0, len(s) ** 0.5))
            names.append(self.languages[best[i]])
            scores.append(float(1 / share.sum()))
        return names, scores


class _Codes(dict):
    """Code points to symbols; 0 for what no automaton has."""

    def __init__(self, symbols: dict[str, int]):
        super().__init__({ord(c): chr(k) for c, k in symbols.items()})

    def __missing__(self, code: int) -> str:
        return "\0"


@lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    """One for each worker process and model."""
    return Parser(dict(texts))


def fit(docs: DataFrame, max_docs: int = 150, max_chars: int = 24_000) -> dict[str, str]:
    """Language to the text of its automaton: equal shares of about ``max_docs`` ids each, in ``SLICES`` slices spread over the whole document.

    A repeated id gives the least of its texts. What reaches the driver is the slices.
    """
    known = docs.where(~held_out()).where("doc_id is not null and lang is not null and text is not null").select("lang", "doc_id", "text")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return {}
    steps = 1 << 30
    rows = [(x, int(steps * min(1.0, max_docs / c)), max(64, max_chars // min(c, max_docs))) for x, c in sorted(n.items())]
    told = docs.sparkSession.createDataFrame(rows, "lang string, cut long, each long")
    some = known.join(F.broadcast(told), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(steps)) < F.col("cut"))
    one = some.groupBy("lang", "doc_id").agg(F.min("text").alias("text"), F.first("each").alias("each"))
    # more than the share, as folding drops characters
    size = F.ceil(F.col("each") * 1.5 / SLICES).cast("int")
    starts = [F.floor((F.length("text") - size) * (k / (SLICES - 1))).cast("int") + 1 for k in range(SLICES)]
    slices = F.when(F.length("text") <= size * SLICES, F.array("text")).otherwise(F.array(*(F.substring(F.col("text"), s, size) for s in starts)))
    by: dict[str, list[str]] = {}
    for r in sorted(one.select("lang", "doc_id", "each", slices.alias("slices")).collect(), key=lambda r: (r["lang"], r["doc_id"])):
        own = [s for s in map(fold, r["slices"]) if s]
        if own:
            by.setdefault(r["lang"], []).append(" ".join(s[: max(1, -(-r["each"] // len(own)))] for s in own))
    return {x: " ".join(texts)[:max_chars] for x, texts in by.items()}


def predict(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(texts.items())))

    def make():
        parser, quick = _parser(sent.value), FastFold()

        def f(ids, held, rows):
            names, scores = parser.predict(rows, quick)
            return [ids, held, names, scores]

        return f

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_rows(x, make, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
