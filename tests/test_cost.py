"""What a plan must not repeat: parsers name the normal form of a fragment once, and frames of many lines are not walked for each line."""

import re

from pyspark.sql import functions as F

from sijill.functions import text as tx
from sijill.operators import lines


def test_a_fragment_is_normalised_once(spark):
    plan = spark.createDataFrame([("a",)], "raw string").select(tx.standalone(F.col("raw")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") == 1


def test_no_wide_frames_but_for_the_evidence(spark):
    docs = spark.createDataFrame([("a", "x\ny")], "doc_id string, document string")
    plan = lines.line_table(docs)._jdf.queryExecution().analyzed().toString()
    walked = [(int(a), int(b)) for a, b in re.findall(r"specifiedwindowframe\(RowFrame, (-?\d+), (-?\d+)\)", plan)]
    assert all(b - a <= 2 or (a, b) == (0, lines.EVIDENCE - 1) for a, b in walked)


def test_line_forms_equal_the_general_ones(spark):
    texts = ["", " a  b ", "a\tb", "é À  x", "أحمد  ١٢", "- \t- x", "1. 2. x", " • x", "Kİ x", "a b "]
    x = spark.createDataFrame([(t,) for t in texts], "raw string").select(tx.squash(F.col("raw")), tx.squash_line(F.col("raw")), tx.norm(F.col("raw")), tx.norm_line(F.col("raw")))
    assert all(r[0] == r[1] and r[2] == r[3] for r in x.collect())
    docs = spark.createDataFrame([("a", "x\r\ny\x0bz \n"), ("b", "\n"), ("c", ""), ("d", "x")], "doc_id string, document string")
    assert sorted(map(tuple, lines.explode_lines(docs).collect())) == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("a", 3, ""), ("b", 0, ""), ("d", 0, "x")]
