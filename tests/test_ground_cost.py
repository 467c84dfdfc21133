"""What grounding must not carry or shuffle: a section's lines beyond the step that reads them, tokens that no name asks for."""

import inspect
import unicodedata

from pyspark.sql import functions as F

from sijill.functions import json_items
from sijill.functions import text as tx
from sijill.operators import grounding


def test_only_asked_tokens_are_told(spark):
    lines = spark.createDataFrame([("a", i, f"w{i} x{i} name") for i in range(300)] + [("b", 0, "name")], "doc_id string, line_no int, norm string")
    asked = spark.createDataFrame([("a", "name"), ("a", "w7")], "doc_id string, token string")
    told = grounding.told_tokens(asked, lines, F.split("norm", " "))
    got = {tuple(r) for r in told.collect()}
    assert {("a", i, "name") for i in range(300)} | {("a", 7, "w7")} <= got and len(got) < 400


def test_sections_are_read_before_their_lines_go():
    """No step after the sections names their lines."""
    rest = inspect.getsource(grounding.ground).split("read_sections(")[1]
    assert '"context"' not in rest and '"near"' not in rest


def test_stable_characters_are_their_own_normal_form(spark):
    stable = [chr(c) for c in [*range(128), 0xAB, 0xBB, *range(0xC0, 0x100), *range(0x621, 0x64B), 0x2013, 0x2014, *range(0x2018, 0x201E)]]
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in stable for b in stable)
    texts = ["".join(stable[1:]), "ﬁ", "é", "²", "آ", "²é", "x…"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.nfkc(F.col("t"))).collect()]
    assert got == [unicodedata.normalize("NFKC", t) for t in texts] and tx.STABLE


def test_long_broken_answers_are_read_in_parts():
    text = '[{"name": "a", "description": "' + 'x\\" {[ ' * 50_000 + '"}, {"name": "cut'
    assert [i["name"] for i in json_items.mended(text, True)] == ["a"]
    assert len(list(json_items._PART.finditer(text))) < 20


def test_colons_are_found_without_walking_the_line(spark):
    texts = ["a: b", ":a", "a:", "a:b：c: d", "::", "é：x : y" * 3, "no colon", "w " * 20_000 + ": tail"]
    x = spark.createDataFrame([(t,) for t in texts], "raw string")
    pairs = tx.scored_pairs(F.col("raw"), F.col("raw"))
    assert "sequence(1, length(" not in x.select(pairs)._jdf.queryExecution().analyzed().toString()
    for text, found in x.select("raw", pairs.alias("p")).collect():
        sides = {s for i, c in enumerate(text) if c in ":：" for s in (text[:i].strip(" "), text[i + 1 :].strip(" "))} | {None}
        assert (found is None) == (not set(text) & set(":：")) and all(p["desc"] in sides for p in found or [])
    assert len(x.select(pairs.alias("p")).collect()[0]["p"]) == 2


def test_the_last_step_is_not_written_out_in_its_own_arguments(spark, monkeypatch):
    """The driver plans each step, again whenever a stage ends: what the optimizer makes of a step may not be a multiple of it. Plans only, nothing runs."""
    told = {}

    def planned(df, name):
        plan = df._jdf.queryExecution()
        told[name] = len(plan.analyzed().toString()), len(plan.optimizedPlan().toString())
        return df.sparkSession.createDataFrame(df.sparkSession.sparkContext.emptyRDD(), df.schema)

    monkeypatch.setattr(grounding, "settle", planned)
    fields = "type string, name string, year int, description string, beneficiaries_count double, budget double, beneficiary_value string, target_audience string, delivery_method string, notes string"
    candidates = spark.createDataFrame(spark.sparkContext.emptyRDD(), f"doc_id string, item_no int, {fields}")
    grounding.ground(candidates, spark.createDataFrame(spark.sparkContext.emptyRDD(), "doc_id string, document string"))
    assert {"sections", "grounded"} <= set(told) and all(after < 2 * before for before, after in told.values())


def test_label_rules_fold_a_line_once(spark):
    """Not once more for each label that is looked for in it."""
    x = spark.createDataFrame([], "context array<struct<raw:string,norm:string,pipe:boolean,artifact:boolean,hint:boolean>>")
    two, all_ = (x.select(grounding.label_numbers(F.col("context"), labels))._jdf.queryExecution().analyzed().toString().count("translate(") for labels in (grounding.lx.BENEFICIARY_LABELS[:2], grounding.lx.BENEFICIARY_LABELS))
    assert len(grounding.lx.BENEFICIARY_LABELS) > 2 and two == all_
