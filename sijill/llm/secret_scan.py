"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

What the fixed patterns leave of a run of key characters (before, between and after their spans) is a secret when its log-likelihood ratio per character, random model
against ordinary model, is above a threshold. Both models are first-order over characters with add-one smoothing. They are
trained from labelled samples: random strings drawn by a seeded generator over the usual key alphabets, and ordinary
identifiers, which are the most frequent words of the whole corpus (``max_words``, as the driver holds them) and their compounds. The threshold is the one that the held-out ordinary identifiers stay under.

Defined cases: a null text is empty and has no span; an empty corpus trains the ordinary model on its built-in words alone;
repeated rows are scanned row by row; other columns are not looked at (``redact`` passes them on).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, map_rows, read_table

KINDS = ("assign", "access", "hex", "random")
MASK = "[SECRET]"

#: The base patterns. Letters of the words in either case; group 1 has the value.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Holds every access and hex span whole.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters that are scored at least.
LEAST = 16

ORDINARY = "get set user name value index count total number string list table column response request handler manager service client server config default version update delete create insert select module package import export function method class object static public private http https www com org net html json data file path home usr local share lib bin tmp var log test example sample result error message status code type size length width height color background image link button label title header footer content".split()


@dataclass(frozen=True)
class Model:
    """ratio[a + b]: log-likelihood ratio of b after a; other: that of pairs that neither sample had."""

    ratio: dict[str, float]
    other: float
    threshold: float

    def score(self, s: str) -> float:
        """Mean log-likelihood ratio per character."""
        s = "\n" + s
        return sum(self.ratio.get(s[i : i + 2], self.other) for i in range(len(s) - 1)) / (len(s) - 1)


def random_strings(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = (digits + "abcdef", digits + "ABCDEF", digits + lower, digits + upper, digits + lower + upper, digits + lower + upper + "+/", digits + lower + upper + "-_")
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(16, 64))) for k in range(n)]


def identifiers(words: list[str], n: int, seed: int = 2) -> list[str]:
    """Words, and compounds of them as they are written in code, paths and addresses."""
    rng, out = random.Random(seed), []
    for k in range(n):
        w = rng.choices(words, k=rng.randint(1, 4))
        joined = (w[0], "_".join(w), "-".join(w), "/".join(w), w[0] + "".join(x.capitalize() for x in w[1:]), "".join(x.capitalize() for x in w), "".join(w).upper(), "=" * 16 + w[0], "-" * 16 + w[0])[k % 9]
        out.append(joined + (str(rng.randint(1, 2030)) if rng.random() < 0.1 else ""))
    return out


def train(words: list[str], n: int = 20_000) -> Model:
    words = sorted({*words, *ORDINARY})
    ordinary, rand = identifiers(words, n), random_strings(n)
    chars = sorted(set("".join(ordinary + rand)))
    counts = []
    for sample in (rand, ordinary[: n * 3 // 4]):
        c: dict[str, int] = defaultdict(int)
        after: dict[str, int] = defaultdict(int)
        for s in sample:
            s = "\n" + s
            for i in range(len(s) - 1):
                c[s[i : i + 2]] += 1
                after[s[i]] += 1
        counts.append((c, after))
    (rc, ra), (oc, oa) = counts
    size = len(chars)
    ratio = {a + b: math.log((rc[a + b] + 1) / (ra[a] + size)) - math.log((oc[a + b] + 1) / (oa[a] + size)) for a in [*chars, "\n"] for b in chars}
    model = Model(ratio, 0.0, 0.0)
    held = [model.score(s) for s in ordinary[n * 3 // 4 :] if len(s) >= 16]
    return Model(ratio, 0.0, max([0.0, *held]) + 0.05)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int | None = None, max_words: int = 20_000) -> Model:
    """Words are counted over all texts; ``max_docs`` asks for about that many ids with one text each instead, which no query does."""
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if max_docs is not None:
        x = some.where("doc_id is not null")
        some = hash_sample(x, "doc_id", max_docs, x.count()).groupBy("doc_id").agg(F.min("text").alias("text"))
    plain = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("word"))
    top = plain.groupBy("word").count().orderBy(F.desc("count"), "word").limit(max_words)
    return train([r["word"] for r in top.collect()])


def _random(text: str, s: int, e: int, a: int, b: int, model: Model) -> bool:
    """Is text[s:e] of the run text[a:b] random? A rest under LEAST characters must be so itself and with its neighbours in the run."""
    if e - s < LEAST:
        if not text[s:e].strip("+/_=-") or model.score(text[s:e]) <= model.threshold:
            return False
        s = max(a, min(s - (LEAST - e + s) // 2, b - LEAST))
        e = max(e, s + LEAST)
    return model.score(text[s:e]) > model.threshold


def find(text: str | None, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span of the text, by start and kind; code points, end exclusive."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_MIN]
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    for a, b in runs:
        if "AKIA" in text[a:b]:
            out += [(*m.span(), 1) for m in ACCESS.finditer(text, a, b)]
        out += [(*m.span(), 2) for m in HEX.finditer(text, a, b)]
    out.sort()
    base, i, covered = len(out), 0, 0
    for a, b in runs:
        left = []
        at = max(a, covered)
        while i < base and out[i][0] < b:
            left.append((at, out[i][0]))
            covered = max(covered, out[i][1])
            at = max(at, covered)
            i += 1
        left.append((at, b))
        out += [(s, e, 3) for s, e in left if s < e and _random(text, s, e, a, b, model)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out)]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def f(ids, texts):
            found = [find(t, m) for t in texts]
            n = [[sum(k == kind for _, _, k in s) for s in found] for kind in KINDS]
            said = [[f"{k}:{a}:{b}" for a, b, k in s] for s in found]
            base = [hashlib.sha256(",".join(x for x in s if x[:6] != "random").encode()).hexdigest() for s in said]
            return [ids, *n, base, [",".join(s) for s in said]]

        return f

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(x, make, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def masked(text: str | None, model: Model) -> str | None:
    spans = find(text, model)
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by MASK; overlapping spans by one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts):
        m = sent.value
        return texts.map(lambda t: masked(t, m))

    return docs.withColumn(text_col, clean.asNondeterministic()(F.col(text_col)))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 counts by its fixed patterns, which SQL can express; the models' spans cannot be."""
    return scan(read_table(spark, sf_dir, "documents"), train([], 400)).select("doc_id", "n_assign", "n_access", "n_hex")


def _counts_sql() -> str:
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
    quote = "[\"'']?"
    assign = rf"(?:{words}){quote}\x20*[:=]\x20*{quote}([A-Za-z0-9+/_.=-]+)"
    count = lambda pattern, group, least: f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda x: length(x) >= {least}))::BIGINT"
    return f"SELECT doc_id, {count(assign, 1, ASSIGN_MIN)} AS n_assign, {count('AKIA[A-Z0-9]+', 0, 18)} AS n_access, {count('[0-9a-f]+', 0, 16)} AS n_hex FROM documents"


COUNTS_SQL = _counts_sql()
