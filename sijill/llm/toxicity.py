"""Toxicity: class-conditional Kneser-Ney models, toxic against ordinary.

Both models spell words (``^`` before, ``$`` after) with contexts of up to ``ORDER`` - 1 characters. At the highest order each
class has its own counts, less ``OWN_DISCOUNT``; what that takes off goes to one backoff that the classes share: Kneser-Ney
over the counts of both, raw at the top and continuation counts at every order below. So an expression that a class has seen
only ``OWN_DISCOUNT`` times or fewer is as likely in one class as in the other, and says nothing.

A toxic text is an ordinary one with toxic words in it: under the toxic hypothesis a word comes from the toxic model with
probability ``SHARE``, else from the ordinary one. The evidence of a text is the difference of its two log-likelihoods over its
number of words (``LEAST`` at least), or that of its worst window of ``WINDOW`` words if that is more, so that length does not
dilute it. One logistic
curve over log(evidence + 2 ``SHARE``), whose slope is not negative, makes it a probability; it is fitted to labelled rows by
models that have not counted them (three folds), weighted to the shares that the classes have among the labelled rows.

Fitting reads a bounded sample of labelled rows (``max_toxic``, ``max_ordinary``) and its ``max_words`` most frequent words; only
rows whose crc32(id) mod 4 is not 2 teach. Words are counted on the executors; the driver gets counts, never texts. Scoring
reads every whole text.

Defined cases: a null or empty text, or one without words, gets the score of no evidence; without labelled rows of both
classes every score is the share of toxic rows known (0 if none); an empty table gives an empty result; repeated rows are
scored row by row, and a document that is labelled twice counts as toxic if either label says so; columns other than id and
text are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, hash_sample, map_rows, read_table, write_table

ORDER, OWN_DISCOUNT, DISCOUNT = 8, 2, 0.75
SHARE, WINDOW, LEAST = 0.01, 400, 50
WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.3
FOLDS = 3
#: Words whose evidence a task remembers, and counts that it holds, at most.
REMEMBERED = 500_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def spelled(word: str) -> list[str]:
    """The n-grams that the word's characters are read in, longest contexts."""
    s = f"^{word}$"
    return [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]


@dataclass
class Model:
    """Log ratios, toxic against ordinary: gram, of n-grams that a class has seen often enough; back, of the backoff weights of contexts."""

    gram: dict[str, float]
    back: dict[str, float]
    intercept: float = 0.0
    slope: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        """The log ratio of the word."""
        r = self.known.get(w)
        if r is None:
            r = 0.0
            for g in spelled(w):
                x = self.gram.get(g)
                r += self.back.get(g[:-1], 0.0) if x is None else x
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[w] = r
        return r

    def evidence(self, text: str | None) -> float:
        """Difference of the log-likelihoods a word, of the text or its worst window."""
        w = words(text)
        if not w:
            return 0.0
        m = np.log1p(SHARE * np.expm1(np.minimum([self.word(x) for x in w], 30.0)))
        total = np.concatenate([[0.0], np.cumsum(m)])
        at = np.arange(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)
        ends = np.minimum(len(w), at + WINDOW)
        return float(max(total[-1] / max(LEAST, len(w)), ((total[ends] - total[at]) / WINDOW).max()))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * math.log(self.evidence(text) + 2 * SHARE)))))


class Shared:
    """Kneser-Ney over raw counts of n-grams: continuation counts below the highest order."""

    def __init__(self, raw: dict[str, int]):
        low: dict[str, int] = defaultdict(int)
        layer, seen = list(raw), set(raw)
        while layer:
            found = []
            for g in layer:
                if len(g) > 1:
                    low[g[1:]] += 1
                    if g[1:] not in seen:
                        seen.add(g[1:])
                        found.append(g[1:])
            layer = found
        self.orders = [(c, *self._contexts(c)) for c in (raw, low)]
        self.n_chars = sum(len(g) == 1 for g in low) + 1
        self.known: dict[tuple[str, bool], float] = {}

    @staticmethod
    def _contexts(counts: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        return total, kinds

    def p(self, gram: str, lower: bool = False) -> float:
        """Of the last character after those before it."""
        if not gram:
            return 1 / self.n_chars
        got = self.known.get((gram, lower))
        if got is None:
            counts, total, kinds = self.orders[lower]
            n, below = total.get(gram[:-1], 0), self.p(gram[1:], True)
            got = below if not n else (max(counts.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * kinds[gram[:-1]] * below) / n
            self.known[gram, lower] = got
        return got


class Counts:
    """Counts of the n-grams of words by class (toxic, ordinary) and fold: what all models are made of."""

    def __init__(self, listed: Iterable[tuple[str, list[int]]]):
        """From words with their counts, the folds of toxic rows first."""
        ids: dict[str, int] = {}
        owner, gram, weight = [], [], []
        for k, (w, n) in enumerate(listed):
            weight.append(n)
            for g in spelled(w):
                owner.append(k)
                gram.append(ids.setdefault(g, len(ids)))
        self.grams = list(ids)
        w, of = np.array(weight, dtype=np.int64).reshape(-1, 2 * FOLDS), np.array(owner, dtype=np.int64)
        at = np.array(gram, dtype=np.int64)
        self.n = np.array([np.bincount(at, weights=w[of, k], minlength=len(ids)) for k in range(2 * FOLDS)]).reshape(2, FOLDS, -1)
        known: dict[str, int] = {}
        self.context = np.array([known.setdefault(g[:-1], len(known)) for g in self.grams], dtype=np.int64)
        self.contexts = list(known)
        self.shared = Shared(dict(zip(self.grams, self.n.sum(axis=(0, 1)).astype(np.int64).tolist(), strict=True)))

    def model(self, without: int | None = None) -> Model:
        """The models of all folds but one. An n-gram that neither class has over OWN_DISCOUNT times differs by its context's backoff weights alone."""
        n = self.n[:, [k for k in range(FOLDS) if k != without]].sum(axis=1)
        often = np.flatnonzero(n.max(axis=0, initial=0) > OWN_DISCOUNT)
        base, at = np.array([self.shared.p(self.grams[k]) for k in often]), self.context[often]
        gram, weight = [], []
        for own in n:
            left, total = np.maximum(own - OWN_DISCOUNT, 0), np.maximum(np.bincount(self.context, weights=own, minlength=len(self.contexts)), 1)
            weight.append(1 - np.bincount(self.context, weights=left, minlength=len(self.contexts)) / total)
            gram.append(np.log(left[often] / total[at] + weight[-1][at] * base))
        back = np.log(weight[0]) - np.log(weight[1])
        return Model(dict(zip((self.grams[k] for k in often), (gram[0] - gram[1]).tolist(), strict=True)), {c: b for c, b in zip(self.contexts, back.tolist(), strict=True) if b})


def calibrated(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) of the weighted logistic curve over log(evidence + 2 SHARE), by Newton's method."""
    x, y, w = np.log(np.asarray(evidence, dtype=float) + 2 * SHARE), np.asarray(toxic, dtype=float), np.asarray(weight, dtype=float)
    share = min(max(float((w * y).sum() / max(w.sum(), 1e-9)), 1e-9), 1 - 1e-9)
    flat = (math.log(share / (1 - share)), 0.0)
    if not 0 < y.sum() < len(y):
        return flat
    a = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.array([flat[0], 0.0]), np.diag([1e-9, 1e-3])

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + b @ ridge @ b / 2)

    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * q * (1 - q) + 1e-12)[:, None]).T @ a + ridge, a.T @ (w * (y - q)) - ridge @ b)
        size = 1.0
        while size > 1e-6 and loss(b + size * step) > loss(b):
            size /= 2
        b = b + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return (float(b[0]), float(b[1])) if b[1] > 0 else flat


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def counted(sample: DataFrame, max_words: int) -> Counts:
    """The counts of the sample's rows (toxic, fold, text). Each task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            cols = [*zip(*counts, strict=True)] or [[]] * 2
            out = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(counts.values(), pa.int64())], names=["cell", "word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for toxic, fold, text in zip(*(c.to_pylist() for c in batch.slice(k, SLICE).columns), strict=True):
                    cell = fold if toxic else FOLDS + fold
                    counts.update((cell, x) for x in words(text))
                    if len(counts) >= REMEMBERED:
                        yield flush()
        yield flush()

    cells = [F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * FOLDS)]
    by_word = sample.select("toxic", "fold", "text").mapInArrow(run, "cell int, word string, n long").groupBy("word").agg(*cells, F.sum("n").alias("n"))
    got = by_word.orderBy(F.desc("n"), "word").limit(max_words).toArrow()
    return Counts([(w, n) for w, *n in zip(*(got[c].to_pylist() for c in ("word", *(f"n{k}" for k in range(2 * FOLDS)))), strict=True)])


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_ordinary: int = 2000, max_words: int = 500_000) -> Model:
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model({}, {}, 30.0 if n.get(1) else -30.0)
    chosen = hash_sample(known.where("toxic = 1"), "doc_id", max_toxic, n[1]).unionByName(hash_sample(known.where("toxic = 0"), "doc_id", max_ordinary, n[0]))
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen.collect()], "_id long, _toxic int")
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)).cast("int")
    x = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select(F.col("_toxic").alias("toxic"), fold.alias("fold"), "text")
    sample = write_table(x, "labelled")
    counts = counted(sample, max_words)
    sent = docs.sparkSession.sparkContext.broadcast([(m.gram, m.back) for m in map(counts.model, range(FOLDS))])

    def make():
        models = [Model(*m) for m in sent.value]
        return lambda toxic, folds, texts: [toxic, [models[k].evidence(t) for k, t in zip(folds, texts, strict=True)]]

    seen = map_rows(sample.select("toxic", "fold", "text"), make, "toxic int, evidence double").collect()
    model = counts.model()
    if not seen:
        model.intercept = math.log(n[1] / n[0])
        return model
    toxic = np.array([r["toxic"] for r in seen])
    rows = {t: max(1, int((toxic == t).sum())) for t in (0, 1)}
    model.intercept, model.slope = calibrated(np.array([r["evidence"] for r in seen]), toxic, np.array([n[t] / rows[t] * len(seen) / (n[0] + n[1]) for t in toxic.tolist()]))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.gram, model.back, model.intercept, model.slope))

    def make():
        m = Model(*sent.value)

        def f(ids, held, texts):
            s = [m.score(t) for t in texts]
            return [ids, held, s, [int(x >= threshold) for x in s]]

        return f

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_rows(x, make, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
