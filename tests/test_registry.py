"""Every registered query over the smallest tables, against DuckDB where it has SQL; plans; the streaming intake."""

import json

import duckdb
import pytest

import __spark_entry__ as entry
from sijill.plans import registry
from sijill.streaming import intake

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Has a test of its own.
COMPOSED = {"ground_documents"}


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((tuple(show(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - COMPOSED))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(cur.fetchall(), columns)


def test_entry_and_no_cartesian(spark):
    assert entry.entry(spark).columns == ["doc_id", "text", "chars", "sha256", "version"]
    for name in ("phrase_match", "lexeme_overlap", "document_year", "autofill_top1"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_streaming_intake_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"job": f"j{k}", "raw": json.dumps({"text": f"t{k}"} if k else {})}))
    intake.write_requests(intake.normalized(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted((r["job"], r["text"], r["error"] is None) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("j0", None, False), ("j1", "t1", True), ("j2", "t2", True)]


def test_discovery_reads_the_documents(spark, tmp_path):
    text = registry.REPORTS[3][1]
    spark.createDataFrame([(7, text), (8, None), (9, "plain words\n" * 300 + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "lace plum", 3)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {}
    for r in registry.queries()["discover_structure"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], set()).add(r["title"])
    assert got["7"] == got["9"] == got["english"] and {"Youth Skills", "Family Support"} <= got["7"] and got["part 1"] == {"Lace Plum", "Family Support"}


def test_grounded_documents_say_what_their_texts_say(spark):
    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    flat = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    got = registry.queries()["ground_documents"](spark, SF).collect()
    assert len({r["doc_id"] for r in got}) > 0.9 * len(texts)
    for r in got:
        text = flat(texts[r["doc_id"]])
        assert flat(r["name"]) in text and r["name"] != "second" or "second" in texts[r["doc_id"]].lower()
        # the text of a section may run over lines that are left out, such as page labels
        assert all(flat(w) in text for w in (r["description"] or "").split())
