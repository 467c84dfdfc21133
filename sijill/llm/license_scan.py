"""License scans: an exact set-similarity join of text blocks with license templates.

Words become their rank in one global order (document frequency in the corpus, rarest first, restricted to the templates'
vocabulary). A block matches a template when it holds at least ``threshold`` of the template's distinct words. An inverted
index from each template's prefix (its |T| - need + 1 rarest words) gives a block the templates that share a prefix word with
it; the length filter and the positional filter follow, and only what passes is counted out. None that matches can fail those.
Blocks are overlapping windows of words, half a window apart; a template's half window is at least as long as its text, so a
copy lies whole in one of them whatever the line breaks. A template whose words all belong to a wider one gives way to it in
a block that both match, but where the narrower one stands apart: in a window of its own length without the wider one's further
words, or in what the wider one's own windows leave of the block. OP1_SQL knows no places and lets it give way there too.

Templates are a parameter of the plan, hence bounded; they travel as one literal, whatever their number, and each row is
joined where it is read, without a shuffle.

Defined cases: a null text is empty: no words, no labels, score 0, null positions; an empty table gives an empty result;
repeated rows are scanned row by row; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.92
#: Half a block, in words, is a power of STEP and LEAST_HALF at least.
LEAST_HALF, STEP = 16, 4

#: Phrases whose every place is reported, their labels, and a word of each that few texts hold.
BASE = (("under the mit license", "mit", "mit"), ("apache license version 2", "apache-2", "apache"), ("cc by nc", "cc-by-nc", "cc"))

#: Notices of well-known licenses, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced or transmitted in any form"),
)


@dataclass(frozen=True)
class Template:
    """A template's words as ranks in the global order, how many of them a block must hold, and the words of its text."""

    label: str
    ranks: list[int]
    need: int
    length: int

    @property
    def prefix(self) -> list[int]:
        return self.ranks[: len(self.ranks) - self.need + 1]


def half_of(length: int) -> int:
    """Half the block, in words, that a template of this length is looked for in."""
    half = LEAST_HALF
    while half < length:
        half *= STEP
    return half


def words(text: Column) -> Column:
    """Words after lower-casing A-Z. lower() also folds other letters, none of them to a word of the templates but for the Kelvin sign, which is replaced first."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by document frequency over the whole corpus, rarest first, ties by word."""
    found = docs.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word")).groupBy("word").count().collect()
    n = {r["word"]: r["count"] for r in found}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template's words found in a block that matches it, 1 where a base phrase stands, else 0.
    """
    x = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    sets = [(label, sorted(set(text.split())), len(text.split())) for label, text in templates]
    order = global_order(x, sorted({w for _, s, _ in sets for w in s}))
    rank = {w: k + 1 for k, w in enumerate(order)}
    by_scale: dict[int, list[Template]] = {}
    for label, s, length in sets:
        by_scale.setdefault(half_of(length), []).append(Template(label, sorted(rank[w] for w in s), math.ceil(threshold * len(s) - 1e-9), length))
    prefixes = sorted({r for ts in by_scale.values() for t in ts for r in t.prefix})

    x = x.withColumn("n_words", F.size("words").cast("long"))
    near = F.col("n_words") > 0
    x = x.withColumns({
        "seen": near & F.arrays_overlap("words", _strings([order[r - 1] for r in prefixes])),
        "places": F.when(near & F.arrays_overlap("words", _strings([k for _, _, k in BASE])), F.array(*(_places(p) for p, _, _ in BASE))),
    })
    x = x.withColumn("ranks", F.when(F.col("seen"), F.transform("words", lambda w: F.array_position(_strings(order), w).cast("int"))))
    x = x.withColumns({f"blocks{h}": F.when(F.col("seen"), _blocks(h)) for h in by_scale})
    x = x.withColumn("found", F.when(F.col("seen"), F.concat(*(_matches(h, ts, len(order)) for h, ts in by_scale.items()))))
    flat = F.flatten("places")
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.size(F.get("places", F.lit(k))) > 0, F.lit(label)) for k, (_, label, _) in enumerate(BASE)))))
    x = x.withColumns({"flat": F.coalesce(flat, F.array().cast("array<int>")), "base": base, "own": F.coalesce(F.transform("found", lambda m: m["label"]), F.array().cast("array<string>"))})
    return x.select(
        "doc_id",
        "n_words",
        F.size("flat").cast("long").alias("n_base"),
        F.array_min("flat").cast("long").alias("first_word"),
        F.array_max("flat").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", "own"))), ",").alias("labels"),
        F.when(F.size("flat") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0))).alias("score"),
    )


def _blocks(half: int) -> Column:
    """Windows of 2 * half words, half a window apart; each as the sorted ranks of its distinct vocabulary words."""
    return F.transform(F.sequence(F.lit(0), F.size("ranks") - 1, F.lit(half)), lambda s: F.sort_array(F.array_distinct(F.filter(F.slice("ranks", s + 1, 2 * half), lambda r: r > 0))))


def _places(phrase: str) -> Column:
    """Starts, in words, of the places where the phrase's words stand consecutively."""
    p = phrase.split()

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, w in enumerate(p):
            out = out & F.coalesce(F.get("words", i + k) == w, F.lit(False))
        return out

    return F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)


def _table(rows: list[list[int]]) -> Column:
    """A literal array of arrays of ints."""
    return F.array(*(F.array(*map(F.lit, r)).cast("array<int>") for r in rows))


def _matches(half: int, templates: list[Template], n_ranks: int) -> Column:
    """Label and share of each template that a block holds enough of, without enough of a wider one or apart from it. Templates are named by place."""
    ranks, need, length = _table([t.ranks for t in templates]), F.array(*(F.lit(t.need) for t in templates)), F.array(*(F.lit(t.length) for t in templates))
    label, prefix = F.array(*(F.lit(t.label) for t in templates)), _table([t.prefix for t in templates])
    index: list[list[int]] = [[] for _ in range(n_ranks)]
    for k, t in enumerate(templates):
        for r in t.prefix:
            index[r - 1].append(k)
    by_rank = _table(index)
    above = [[j for j, w in enumerate(templates) if set(t.ranks) < set(w.ranks)] for t in templates]
    wider, extra = _table(above), _table([sorted({r for j in ws for r in templates[j].ranks} - set(t.ranks)) for t, ws in zip(templates, above, strict=True)])

    def holds(words: Column, t: Column) -> Column:
        return F.size(F.array_intersect(words, F.get(ranks, t))) >= F.get(need, t)

    def alone(words: Column, t: Column) -> Column:
        return holds(words, t) & ~F.exists(F.get(wider, t), lambda w: holds(words, w))

    def apart(i: Column, t: Column) -> Column:
        raw = F.slice("ranks", i * half + 1, 2 * half)
        starts = F.sequence(F.lit(0), F.size(raw) - 1)
        window = lambda s, n: F.slice(raw, s + 1, n)
        own = F.exists(starts, lambda s: holds(window(s, F.get(length, t)), t) & ~F.arrays_overlap(window(s, F.get(length, t)), F.get(extra, t)))

        def places(w: Column) -> Column:
            return F.transform(F.filter(starts, lambda s: holds(window(s, F.get(length, w)), w)), lambda s: F.struct(s.alias("a"), (s + F.get(length, w)).alias("b")))

        taken = F.flatten(F.transform(F.get(wider, t), places))
        rest = F.filter(raw, lambda r, p: ~F.exists(taken, lambda m: (m["a"] <= p) & (p < m["b"])))
        return own | alone(rest, t)

    def may(b: Column, t: Column) -> Column:
        own = F.get(ranks, t)
        first = F.array_min(F.array_intersect(b, F.get(prefix, t)))
        left = F.least(F.size(own) - F.array_position(own, first), F.size(b) - F.array_position(b, first)) + 1
        return (F.size(b) >= F.get(need, t)) & (left >= F.get(need, t)) & holds(b, t)

    def found(b: Column, i: Column) -> Column:
        candidates = F.array_distinct(F.flatten(F.transform(b, lambda r: F.get(by_rank, r - 1))))
        kept = F.filter(candidates, lambda t: may(b, t) & ((F.size(F.get(wider, t)) == 0) | alone(b, t) | apart(i, t)))
        return F.transform(kept, lambda t: F.struct(F.get(label, t).alias("label"), (F.size(F.array_intersect(b, F.get(ranks, t))) / F.size(F.get(ranks, t))).alias("share")))

    return F.flatten(F.transform(f"blocks{half}", found))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    quoted = lambda s: "'" + s + "'"
    rows, sets = [], [set(text.split()) for _, text in TEMPLATES]
    scale = [half_of(len(text.split())) for _, text in TEMPLATES]
    pairs = ", ".join(f"({i}, {j})" for i, a in enumerate(sets) for j, b in enumerate(sets) if a < b and scale[i] == scale[j])
    for k, (label, text) in enumerate(TEMPLATES):
        s = sorted(set(text.split()))
        rows += [f"({k}, {quoted(label)}, {scale[k]}, {len(s)}, {math.ceil(THRESHOLD * len(s) - 1e-9)}, {quoted(w)})" for w in s]
    phrases = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM pos WHERE " + " AND ".join(f"ws[i + {j + 1}] = '{w}'" for j, w in enumerate(p.split())) for p, label, _ in BASE)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t(tid, label, half, n, need, word) AS (VALUES {", ".join(rows)}),
pos AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d),
base AS ({phrases}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
hit AS (SELECT pos.doc_id, t.tid, t.label, t.half, t.n, t.need, t.word, pos.i FROM pos JOIN t ON pos.ws[pos.i + 1] = t.word),
blk AS (SELECT doc_id, tid, label, n, need, word, i // half AS block FROM hit UNION ALL SELECT doc_id, tid, label, n, need, word, i // half - 1 AS block FROM hit WHERE i >= half),
every AS (SELECT doc_id, tid, label, n, block, count(DISTINCT word) AS k FROM blk GROUP BY doc_id, tid, label, n, need, block HAVING count(DISTINCT word) >= need),
wider(tid, other) AS (VALUES {pairs}),
m AS (SELECT * FROM every a WHERE NOT EXISTS (SELECT 1 FROM wider w JOIN every b ON b.tid = w.other WHERE w.tid = a.tid AND b.doc_id = a.doc_id AND b.block = a.block)),
o AS (SELECT doc_id, label, max(k / n::DOUBLE) AS share FROM m GROUP BY doc_id, label),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM o UNION ALL SELECT doc_id, label FROM base) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM o GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(s.share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


OP1_SQL = _op1_sql()
