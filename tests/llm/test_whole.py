"""What the pipeline's stages learn comes from all rows."""

import random

from sijill.llm import quality_rules as qr
from sijill.llm import secret_scan as ss


def test_rules_are_learned_from_all_labelled_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["aa", "bbb", "C", "d!", "#"], [5, 5, 1, 1, 4 * (i % 3 == 0) + 1], k=rng.randint(20, 60))) for i in range(20_500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(len(texts))] + [(None, 1)], "doc_id long, quality int")
    rows = qr.labelled(docs, labels).toPandas().to_dict("records")
    assert len(rows) == len(texts)
    rules = qr.fit(docs, labels)
    assert rules and rules == qr.learn(rows)


def test_words_of_secrets_come_from_all_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ss, "train", lambda words: seen.extend(words))
    a, b = "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"
    docs = spark.createDataFrame([(k, f"q{a[k % 26]}{b[k // 26 % 26]}{a[k // 676]}") for k in range(1500)], "doc_id long, text string")
    ss.fit(docs)
    assert len(seen) == len(set(seen)) == 1500
