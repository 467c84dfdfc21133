"""The corpus pipeline on a small folder of tables, against what each stage is for."""

import random

import corpus_pipeline
from sijill.llm import packing as pk
from sijill.llm import secret_scan as ss


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    item = " ".join(f"b{rng.randrange(900)}" for _ in range(30))
    clean = [prose(rng, rng.randint(80, 200)) for _ in range(60)]
    junk = [" ".join(w + "###" for w in prose(rng, rng.randint(80, 200)).split()) for _ in range(30)]
    copy = clean[0].split()
    copy[70] = "changed"
    extra = [" ".join(copy), prose(rng, 90) + " " + item, prose(rng, 120) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', None, "few words"]
    texts = [*clean, *junk, *extra]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    seen, x = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        x = pk.write_table(stage(spark, x, str(tmp_path)), "stage")
        assert x.columns == docs.columns
        seen.append({r["doc_id"]: r["text"] for r in x.collect()})
    assert set(seen[0]) == {*range(60), 90, 91, 92}
    assert set(seen[1]) == {*range(60), 91, 92}
    assert set(seen[2]) == {*range(60), 92}
    assert set(seen[3]) == set(seen[2]) and ss.MASK in seen[3][92] and "24be" not in seen[3][92]
    assert all(seen[3][i] == texts[i] for i in range(60))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == set(seen[3]) and packed.groupby("sequence_id").length.sum().max() <= pk.CAPACITY


def test_stages_on_awkward_tables(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, ties, empty texts, clashing extra columns; and empty tables."""
    rng = random.Random(22)
    clean = [prose(rng, 90) for _ in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _h string, root string, node string, words string"
    more = (None, None, None, 0, "a", "b", "c", "d", "e")
    rows = [(i, t, "en", "s", 1, "r", "h", "o", "n", "w") for i, t in enumerate(clean)]
    rows += [rows[0], (0, clean[1] + " other", *rows[0][2:]), (None, clean[2] + " more words", *rows[0][2:]), (None, None, None, None, None, None, None, None, None, None), (50, "", *more[1:]), (51, clean[3], *rows[0][2:])]
    for name, kept in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(kept, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, None if i == 3 else 1, None) for i in [*range(9), None]] if kept else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(0, None), (None, ""), (1, "qq zz")] if kept else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        x, seen = docs, []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            x = pk.write_table(stage(spark, x, folder), "stage")
            assert x.columns == docs.columns
            seen.append(sorted(((r["doc_id"], r["text"]) for r in x.collect()), key=str))
        packed = corpus_pipeline.run(spark, folder)
        if not kept:
            assert seen == [[]] * 4 and packed.count() == 0
            continue
        assert len(seen[0]) == 16 and all(t for _, t in seen[0])
        # the copy of a row, the near copies (of the null id and of id 0) and the exact copy (51) go to the least id, null first
        assert len(seen[1]) == 12 and (None, clean[2] + " more words") in seen[1] and not any(d in (2, 51) for d, _ in seen[1])
        assert seen[2] == seen[1] == seen[3] and packed.select("doc_id").distinct().count() == 12 - sum(d == 0 for d, _ in seen[1]) + 1
