"""Quality rules: a learned decision list over text statistics.

Sequential covering grows and prunes conjunctions of thresholds from labelled statistics; the ordered rules are emitted as
one Spark conditional expression. The main path holds DataFrame functions only. All labelled rows teach: their statistics are
a table of a few numbers a row, and each step of the learner is an aggregate of it; the driver sees counts of bins, never rows.

Defined cases: a null text has no words, so all its counts are 0 and it fails the base rule; an empty table gives an empty
result; repeated rows and repeated ids are judged row by row; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Sieve, keep_where, read_table, write_table

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Name and expression of what the rules compare. Ratios are 0 where the divisor is 0.
FEATURES: dict[str, str] = {
    "words": "double(n_words)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbols": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "upper": "coalesce(try_divide(n_upper, word_chars), 0D)",
    "exclaims": "coalesce(try_divide(n_exclaims, n_words), 0D)",
    "dup_lines": "coalesce(try_divide(n_dup_lines, n_lines), 0D)",
    "repeats": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is it at least, threshold) that rejects a document."""

    terms: tuple[tuple[str, bool, float], ...]

    def fires(self, row: dict[str, float]) -> bool:
        return all((row[f] >= t) == at_least for f, at_least, t in self.terms)

    def column(self) -> Column:
        out = F.lit(True)
        for f, at_least, t in self.terms:
            x = F.expr(FEATURES[f])
            out = out & (x >= t if at_least else x < t)
        return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the row itself as the struct ``row``, and the counts of its text. A repeated word is one inside a window of eight words found twice or more."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    x = x.withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    x = x.select(
        "doc_id",
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split("text", r"\p{Lu}", -1)) - 1).cast("long").alias("n_upper"),
        (F.size(F.split("text", "!", -1)) - 1).cast("long").alias("n_exclaims"),
        F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("w", lambda s: F.xxhash64(s)).alias("h"),
    )
    x = x.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        # h is named twice here, so that no rule inlines it into the lambda
        "win": F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))),
    })
    x = x.withColumn("pairs", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    x = x.withColumn("starts", F.sort_array(F.transform(F.filter("pairs", lambda p, k: (F.get("pairs", k - 1)["v"] == p["v"]) | (F.get("pairs", k + 1)["v"] == p["v"])), lambda p: p["i"])))
    steps = F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW))))
    repeats = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return x.select("doc_id", "row", "n_words", "word_chars", "n_symbols", "n_upper", "n_exclaims", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _cuts(rows: list[dict[str, float]], most: int) -> dict[str, list[float]]:
    out = {}
    for f in FEATURES:
        v = sorted({r[f] for r in rows})
        out[f] = v if len(v) <= most else sorted({v[k * (len(v) - 1) // most] for k in range(1, most + 1)})
    return out


def _grow(pos: list[dict], neg: list[dict], cuts: dict[str, list[float]], most_terms: int) -> list[tuple[str, bool, float]]:
    terms: list[tuple[str, bool, float]] = []
    while neg and len(terms) < most_terms:
        best = (0.0, None)
        for f, values in cuts.items():
            ps, ns = sorted(r[f] for r in pos), sorted(r[f] for r in neg)
            i = j = 0
            for t in values:
                while i < len(ps) and ps[i] < t:
                    i += 1
                while j < len(ns) and ns[j] < t:
                    j += 1
                for at_least, p, n in ((True, len(ps) - i, len(ns) - j), (False, i, j)):
                    g = _gain(len(pos), len(neg), p, n)
                    if g > best[0] + 1e-12:
                        best = (g, (f, at_least, t))
        if best[1] is None:
            break
        f, at_least, t = best[1]
        low, high = [r[f] for r in pos + neg if r[f] < t], [r[f] for r in pos + neg if r[f] >= t]
        terms.append((f, at_least, (max(low) + min(high)) / 2 if low and high else t))  # the middle of the gap parts them alike
        r = Rule(tuple(terms[-1:]))
        pos, neg = [x for x in pos if r.fires(x)], [x for x in neg if r.fires(x)]
    return terms


def learn(rows: list[dict], most_rules: int = 16, most_terms: int = 4, cuts: int = 64, precision: float = 0.9) -> list[Rule]:
    """Sequential covering over rows with FEATURES, ``bad`` and ``fold``: fold 0 grows, fold 1 prunes; a rule that is not precise on the pruning fold ends the list."""
    pos, neg = [r for r in rows if r["bad"]], [r for r in rows if not r["bad"]]
    all_cuts, out = _cuts(rows, cuts), []
    while len(out) < most_rules:
        gp, gn = [r for r in pos if not r["fold"]], [r for r in neg if not r["fold"]]
        pp, pn = [r for r in pos if r["fold"]], [r for r in neg if r["fold"]]
        if not gp:
            break
        terms = _grow(gp, gn, all_cuts, most_terms)
        best = None
        for k in range(len(terms), 0, -1):
            r = Rule(tuple(terms[:k]))
            p, n = sum(map(r.fires, pp)), sum(map(r.fires, pn))
            worth = (p - n) / (p + n) if p + n else -1.0
            if best is None or worth >= best[0]:
                best = (worth, r, p, n)
        if best is None or best[2] == 0 or best[2] / (best[2] + best[3]) < precision:
            break
        out.append(best[1])
        pos, neg = [r for r in pos if not best[1].fires(r)], [r for r in neg if not best[1].fires(r)]
    return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """bad, fold and FEATURES of every labelled row. Rows without a label or an id teach nothing."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 0).alias("bad"))
    some = Sieve(known, "doc_id").marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "known").where("known").drop("known")
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(3)) == 0
    return statistics(some).drop("row").join(known, "doc_id").select("bad", fold.alias("fold"), *(F.expr(e).alias(f) for f, e in FEATURES.items()))


def _each(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each feature of each row: f, its name, and v, its value, beside ``more``; columns b_<feature> give bin."""
    binned = f"b_{next(iter(FEATURES))}" in rows.columns
    told = [F.struct(F.lit(f).alias("f"), F.col(f).alias("v"), (F.col(f"b_{f}") if binned else F.lit(0)).alias("bin")) for f in FEATURES]
    return rows.select(*more, F.explode(F.array(*told)).alias("s")).select(*more, "s.*")


def _all_cuts(rows: DataFrame, most: int) -> dict[str, list[float]]:
    """_cuts() of a table: only the values at the places that it takes reach the driver."""
    every = _each(rows).select("f", "v").distinct()
    n = {r["f"]: r["count"] for r in every.groupBy("f").count().collect()}
    taken = [(f, p) for f, m in n.items() for p in (range(m) if m <= most else sorted({k * (m - 1) // most for k in range(1, most + 1)}))]
    if not taken:
        return {f: [] for f in FEATURES}
    places = rows.sparkSession.createDataFrame(taken, "f string, place int")
    got = every.withColumn("place", F.row_number().over(Window.partitionBy("f").orderBy("v")) - 1).join(F.broadcast(places), ["f", "place"]).collect()
    return {f: sorted({r["v"] for r in got if r["f"] == f}) for f in FEATURES}


def _grow_all(rows: DataFrame, cuts: dict[str, list[float]], most_terms: int) -> list[tuple[str, bool, float]]:
    """_grow() of a table with bins: an aggregate for each term."""
    terms: list[tuple[str, bool, float]] = []
    while len(terms) < most_terms:
        cells = _each(rows, "bad").groupBy("f", "bin", "bad").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        first = [c for c in cells if c["f"] == next(iter(FEATURES))]
        pos, neg = (sum(c["n"] for c in first if c["bad"] == bad) for bad in (True, False))
        if not pos or not neg:
            break
        best = (0.0, None)
        for f, values in cuts.items():
            for k, t in enumerate(values, 1):
                p, n = (sum(c["n"] for c in cells if c["f"] == f and c["bad"] == bad and c["bin"] < k) for bad in (True, False))
                for at_least, a, b in ((True, pos - p, neg - n), (False, p, n)):
                    g = _gain(pos, neg, a, b)
                    if g > best[0] + 1e-12:
                        best = (g, (f, at_least, t, k))
        if best[1] is None:
            break
        f, at_least, t, k = best[1]
        low, high = [c["hi"] for c in cells if c["f"] == f and c["bin"] < k], [c["lo"] for c in cells if c["f"] == f and c["bin"] >= k]
        terms.append((f, at_least, (max(low) + min(high)) / 2 if low and high else t))
        rows = rows.where(_fires(terms[-1:]))
    return terms


def _fires(terms) -> Column:
    out = F.lit(True)
    for f, at_least, t in terms:
        out = out & (F.col(f) >= t if at_least else F.col(f) < t)
    return out


def learn_all(rows: DataFrame, most_rules: int = 16, most_terms: int = 4, cuts: int = 64, precision: float = 0.9) -> list[Rule]:
    """learn() of a table of labelled rows, all of them."""
    all_cuts, out = _all_cuts(rows, cuts), []
    bin_of = lambda f, v: F.size(F.filter(F.array(*map(F.lit, v)), lambda t: t <= F.col(f))) if v else F.lit(0)
    bins = {f"b_{f}": bin_of(f, v) for f, v in all_cuts.items()}
    left = write_table(rows.withColumns(bins), "binned")
    while len(out) < most_rules:
        terms = _grow_all(left.where("not fold"), all_cuts, most_terms)
        if not terms:
            break
        counts = [F.count(F.when(_fires(terms[:k]) & (F.col("bad") == bad), 1)).alias(f"{kind}{k}") for k in range(1, len(terms) + 1) for kind, bad in (("p", True), ("n", False))]
        seen, best = left.where("fold").agg(*counts).first(), None
        for k in range(len(terms), 0, -1):
            p, n = seen[f"p{k}"], seen[f"n{k}"]
            worth = (p - n) / (p + n) if p + n else -1.0
            if best is None or worth >= best[0]:
                best = (worth, terms[:k], p, n)
        if best[2] == 0 or best[2] / (best[2] + best[3]) < precision:
            break
        out.append(Rule(tuple(best[1])))
        left = left.where(~_fires(best[1]))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learns from all labelled rows."""
    return learn_all(write_table(labelled(docs, labels), "labelled"))


def verdict(rules: list[Rule]) -> Column:
    """The ordered rules as one conditional: the first that fires rejects."""
    out = F.when(base_failed(), F.lit(False))
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept of each row of docs."""
    rules = fit(docs, labels)
    return statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, as they are, that the rules keep."""
    judged = statistics(docs).select("row", verdict(fit(docs, labels)).alias("kept"))
    return keep_where(judged, F.col("kept")).select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op3 compares and its base rule, which SQL can express; the verdict it learns cannot be."""
    got = statistics(read_table(spark, sf_dir, "documents")).drop("row")
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"))


STATISTICS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
again AS (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM again GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ws) < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {MAX_REPEAT_PERCENT} * len(ws) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)"""
