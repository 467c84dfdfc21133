"""Queries over the driver's tables, by operator of the engine, and DuckDB SQL of the same rows where SQL can express it.

The tables hold no Arabic; operators whose meaning is Arabic run over inline rows, the same ones in Spark and in SQL.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions import columns_split, json_items
from sijill.functions import lexicon as lx
from sijill.functions import text as tx
from sijill.functions import values as vx
from sijill.operators import documents as docs_
from sijill.operators import grounding, lines, records, structure
from sijill.options import Options
from sijill.plans import pipeline
from sijill.sources import candidates as cand
from sijill.sources import files as files_
from sijill.sources import requests as req
from sijill.storage import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({names})"


def sql_norm(x: str) -> str:
    """N1 in DuckDB, for text in compatibility form."""
    return f"trim(regexp_replace(lower(translate({x}, {quoted(lx.FOLD_FROM)}, {quoted(lx.FOLD_TO)})), '[^0-9A-Za-z؀-ۿ]+', ' ', 'g'))"


def sql_squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_flat(x: str) -> str:
    """squash(unbullet())."""
    return f"ltrim({sql_squash(x)}, {quoted(lx.BULLETS)})"


def sql_begins(n: str, phrases) -> str:
    return f"regexp_matches({n}, '^{lx.alternatives(phrases)}(?: |$)')"


def sql_opens(n: str, phrases) -> str:
    return f"regexp_matches({n}, '^{lx.alternatives(phrases)}')"


def sql_words(n: str) -> str:
    return f"CASE WHEN {n} = '' THEN 0 ELSE len(string_split({n}, ' ')) END"


ARTIFACT = rf"(regexp_matches(n, 'صفح(?:ة|ه)\s*pdf\s*رقم\s*\d+|page\s*\d+(?:\s*of\s*\d+)?$') OR (regexp_matches(n, '{lx.alternatives(lx.ANNUAL_REPORT)}') AND regexp_matches(n, '\d')))"
SHORT = f"(flat <> '' AND length(flat) <= 140 AND n <> '' AND NOT {ARTIFACT} AND w <= 12 AND length(flat) - length(replace(flat, '.', '')) < 2 AND length(flat) - length(replace(flat, '؛', '')) < 2)"
PROSE = rf"(n <> '' AND ({sql_opens('n', lx.PROSE_OPENERS)} OR w >= 13 OR (regexp_matches(raw, '[،;؛]') AND w >= 6) OR regexp_matches(n, '^(?:\S+ ){{0,6}}{lx.alternatives(lx.PROSE_VERBS)}(?: |$)') OR ({sql_opens('n', [lx.COURSE_OPENER])} AND w >= 3)))"
LIST = f"CASE WHEN {SHORT} THEN CASE WHEN {sql_begins('n', lx.PROGRAM_LISTS)} THEN 'program' WHEN {sql_begins('n', lx.PROJECT_LISTS + lx.ACTIVITY_LISTS)} THEN 'project' END END"
MAJOR = f"({SHORT} AND ({LIST}) IS NULL AND (regexp_matches(squashed, '^[:：]|[:：]$') OR {sql_opens('n', lx.SECTION_STARTS)}))"
SCORE = f"""CASE WHEN flat = '' OR n = '' OR {ARTIFACT} THEN -99 ELSE
  CASE WHEN w <= 4 THEN 5 WHEN w <= 8 THEN 3 WHEN w <= 12 THEN 1 ELSE -6 END + CASE WHEN length(flat) <= 90 THEN 2 ELSE 0 END + CASE WHEN {sql_begins('n', tx.ENTITY_NOUNS)} THEN 3 ELSE 0 END
  + CASE WHEN {PROSE} THEN -7 ELSE 0 END + CASE WHEN regexp_matches(n, '^{lx.alternatives(lx.FIELD_HINTS)}$') THEN -8 ELSE 0 END + CASE WHEN regexp_matches(n, '^{lx.alternatives(lx.GENERIC_HEADINGS)}$') THEN -8 ELSE 0 END END"""
LINES = f"""raw_lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE length(text) > 0)),
lines AS (SELECT *, {sql_words('n')} AS w FROM (SELECT doc_id, line_no, raw, {sql_norm('raw')} AS n, {sql_flat('raw')} AS flat, {sql_squash('raw')} AS squashed FROM raw_lines))"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.predicates(lines.explode_lines(table(spark, sf_dir, "documents"), text="text"))


# ---------------------------------------------------------------- text and lines
@query("extract_text", r"""SELECT doc_id, t AS text, length(t)::BIGINT AS chars, sha256(t) AS sha256, 'sijill-1' AS version FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(160), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[^\S\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def extract_text(spark, sf_dir):
    """C1, O4."""
    d = table(spark, sf_dir, "documents")
    return docs_.extract_text(d.select("doc_id", docs_.clean_text(F.col("text")).alias("document")))


@query("line_explode", f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, raw FROM raw_lines")
def line_explode(spark, sf_dir):
    return lines.explode_lines(table(spark, sf_dir, "documents"), text="text").select("doc_id", "line_no", "raw")


@query("norm_text", f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def norm_text(spark, sf_dir):
    """N1."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.norm(tx.nfkc(F.col("text"))).alias("norm"))


@query("window_norm3", f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, concat_ws(' ', nullif(n, ''), nullif(lead(n, 1) OVER d, ''), nullif(lead(n, 2) OVER d, '')) AS wide FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)")
def window_norm3(spark, sf_dir):
    """N6."""
    x = document_lines(spark, sf_dir)
    part = [F.nullif(F.lead("norm", k).over(lines.by_line()) if k else F.col("norm"), F.lit("")) for k in range(3)]
    return x.select("doc_id", "line_no", F.concat_ws(" ", *part).alias("wide"))


@query("line_predicates", f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, {ARTIFACT} AS artifact, {SHORT} AS short, {LIST} AS list_type, {MAJOR} AS major, {PROSE} AS prose, ({SCORE})::INT AS title_score FROM lines")
def line_predicates(spark, sf_dir):
    """P1 to P5, P10."""
    x = document_lines(spark, sf_dir)
    return x.select("doc_id", "line_no", "artifact", "short", "list_type", "major", "prose", tx.title_score(tx.squash(tx.unbullet(F.col("raw"))), F.col("norm")).alias("title_score"))


@query("name_predicates", f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, {sql_begins('n', lx.CONNECTORS)} AS connector, {sql_begins('n', tx.ENTITY_NOUNS)} AS entity, (squashed <> '' AND (regexp_matches(squashed, '^(?:[.\\-]?\\s*\\d{{1,2}}\\s*[.)\\-:]|\\d{{1,2}}\\s+)') OR regexp_matches(squashed, '[.\\s]\\d{{1,2}}$') OR {sql_opens('n', lx.PLACES_WON)})) AS detail FROM lines")
def name_predicates(spark, sf_dir):
    """P6, P7, P9."""
    x = document_lines(spark, sf_dir)
    return x.select("doc_id", "line_no", tx.connector_prose(F.col("norm")).alias("connector"), tx.entity_noun(F.col("norm")).alias("entity"), tx.detail_start(F.col("flat"), F.col("norm")).alias("detail"))


CONTEXT_LINES = [("a", k, s) for k, s in enumerate(["Annual Report 2024", "Featured Programs", "Youth Skills", "", "page 3", "Family Support", "Governance", "Board", "Projects", "Water Wells", "Activities", "Open Day", "Contents:", "Index"])]


ALL_LINES = f"""every AS (SELECT doc_id::VARCHAR AS doc_id, line_no, raw FROM raw_lines UNION ALL SELECT doc_id, line_no, raw FROM {values(CONTEXT_LINES, 'doc_id, line_no, raw')}),
l AS (SELECT *, {sql_words('n')} AS w FROM (SELECT doc_id, line_no, raw, {sql_norm('raw')} AS n, {sql_flat('raw')} AS flat, {sql_squash('raw')} AS squashed FROM every)),
e AS (SELECT *, CASE WHEN {ARTIFACT} OR squashed = '' THEN NULL WHEN ({LIST}) IS NOT NULL THEN {LIST} WHEN {MAJOR} THEN '#stop' END AS event FROM l)"""


@query("list_context", f"WITH {LINES}, {ALL_LINES} SELECT doc_id, line_no::INT AS line_no, nullif(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING), '#stop') AS nearest_type, nullif(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '#stop') AS active_type FROM e")
def list_context(spark, sf_dir):
    """All documents, and a document with lists."""
    x = lines.explode_lines(table(spark, sf_dir, "documents"), text="text").select(F.col("doc_id").cast("string"), "line_no", "raw").unionByName(spark.createDataFrame(CONTEXT_LINES, "doc_id string, line_no int, raw string"))
    return lines.contexts(lines.predicates(x)).select("doc_id", "line_no", "nearest_type", "active_type")


NAMES = [(1, "مشروع سقيا الماء (المرحلة الأولى)"), (2, "المشروع: إفطار الصائمين"), (3, "برنامج محو الأُميّة"), (4, "Clean Water Initiative"), (5, "(بلا اسم"), (6, "مبادرة إ كرام"), (7, None), (8, "")]
KEY_SQL = "replace(regexp_replace({n}, '^" + lx.alternatives(lx.PROJECT_NOUNS + lx.PROGRAM_NOUNS) + "(?: |$)', ''), ' ', '')"
NAME_SQL = "SELECT id, " + KEY_SQL.format(n=sql_norm("regexp_replace(coalesce(name, ''), '\\s*\\(.*$', '')")) + " AS key FROM "


@query("name_key", NAME_SQL + f"(SELECT id::BIGINT AS id, name FROM {values(NAMES, 'id, name')} UNION ALL SELECT 100 + p_partkey, p_name FROM part)")
def name_key(spark, sf_dir):
    """N3."""
    own = spark.createDataFrame(NAMES, "id long, name string")
    return own.unionByName(table(spark, sf_dir, "part").select((F.col("p_partkey") + 100).alias("id"), F.col("p_name").alias("name"))).select("id", tx.name_key(F.col("name")).alias("key"))


@query("phrase_match", f"""WITH w AS (SELECT 'd' AS side, doc_id AS id, string_split({sql_norm('text')}, ' ') AS ws FROM documents UNION ALL SELECT 'b', item_id, string_split({sql_norm('text')}, ' ') FROM benchmark),
g AS (SELECT DISTINCT side, id, array_to_string(ws[i:i + 4], ' ') AS phrase FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5))
SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS phrases FROM g d JOIN g b ON d.side = 'd' AND b.side = 'b' AND d.phrase = b.phrase GROUP BY ALL""")
def phrase_match(spark, sf_dir):
    """How many of the five-word phrases of each test item a document holds: an equi-join of (id, phrase), no text travels."""

    def phrases(x: DataFrame, key: str) -> DataFrame:
        ws = F.split(tx.norm(F.col("text")), " ")
        x = x.select(key, ws.alias("ws")).where(F.size("ws") >= 5)
        at = F.sequence(F.lit(1), F.size("ws") - 4)
        return x.select(key, F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("ws", i, 5), " ")))).alias("phrase"))

    items, docs = phrases(table(spark, sf_dir, "benchmark"), "item_id"), phrases(table(spark, sf_dir, "documents"), "doc_id")
    return docs.join(items, "phrase").groupBy("doc_id", "item_id").agg(F.count("*").alias("phrases"))


@query("lexeme_overlap", f"""WITH p AS (SELECT p_partkey, list_distinct(list_filter(list_transform(list_filter(string_split({sql_norm('p_name')}, ' '), lambda t: length(t) > 2), lambda t: CASE WHEN length(t) > 4 AND t[1] IN ('و','ف','ب','ك','ل') THEN t[2:] ELSE t END), lambda t: length(t) > 2)) AS l FROM part)
SELECT a.p_partkey, len(list_intersect(a.l, b.l))::INT AS shared FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1""")
def lexeme_overlap(spark, sf_dir):
    """N10, N11, of parts with neighbouring keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", tx.lexemes(tx.norm(F.col("p_name"))).alias("l"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("l").alias("m"))
    return p.join(q, "p_partkey").select("p_partkey", tx.overlap(F.col("l"), F.col("m")).alias("shared"))


NUMBERED = [(1, "16 1.مبادرة إفطار"), (2, "3- برنامج"), (3, "570 مشروع"), (4, "* • عنوان"), (5, ".4: اسم"), (6, "34 حملة مستفيدة"), (7, "")]


@query("toc_numbering", rf"SELECT id, trim(CASE WHEN regexp_matches(s, '^\d{{1,3}}\s+\d{{1,2}}\s*[.\-:]\s*') THEN regexp_replace(s, '^\d{{1,3}}\s+\d{{1,2}}\s*[.\-:]\s*', '') WHEN regexp_matches(s, '^\.?\s*\d{{1,2}}\s*[.\-:]\s*') THEN regexp_replace(s, '^\.?\s*\d{{1,2}}\s*[.\-:]\s*', '') ELSE s END) AS title FROM (SELECT id, ltrim(trim(raw), {quoted(lx.BULLETS)}) AS s FROM {values(NUMBERED, 'id, raw')})")
def toc_numbering(spark, sf_dir):
    """N8."""
    return spark.createDataFrame(NUMBERED, "id int, raw string").select("id", tx.without_numbering(F.col("raw")).alias("title"))


# ---------------------------------------------------------------- values
NUMBERS = [(1, "1,200 مستفيد"), (2, "٤٥٬٠٠٠٫٥ ريال"), (3, "1.5 مليون"), (4, "-5"), (5, "null"), (6, "لا يوجد"), (7, "about 3 thousand"), (8, "٢٠٢٥م"), (9, "1446"), (10, "12 116"), (11, None), (12, "2 bn"), (13, "7.125"), (14, "no digits"), (15, "0.5k")]
NUMBER_SQL = f"""n AS (SELECT id, x, trim(translate(x, {quoted(lx.EASTERN_DIGITS + '٬٫')}, {quoted(lx.WESTERN_DIGITS + ',.')})) AS s FROM {values(NUMBERS, 'id, x')}),
m AS (SELECT id, s, replace(replace(nullif(regexp_extract(s, '{lx.NUMBER}'), ''), ',', ''), ' ', '')::DOUBLE AS raw, regexp_extract(s, '(?:{lx.NUMBER})((?s:.){{0,12}})', 1) AS rest FROM n WHERE NOT coalesce(lower(s) IN ({', '.join(map(quoted, lx.NULL_WORDS))}), false)),
p AS (SELECT id, raw * CASE {' '.join(f"WHEN regexp_matches(rest, '(?i)(?:^|[^[:alnum:]_ء-ي])(?:{w})(?:$|[^[:alnum:]_ء-ي])') THEN {f}" for w, f in lx.MULTIPLIERS)} ELSE 1 END AS number FROM m)"""


@query("coerce_number", f"WITH {NUMBER_SQL} SELECT v.id, number, CASE WHEN number >= 0 THEN round_even(number, 0)::BIGINT END AS whole, CASE WHEN number BETWEEN 1900 AND 2100.999 THEN floor(number)::INT END AS year, CASE WHEN number >= 0 THEN round_even(number, 2) END AS budget FROM {values(NUMBERS, 'id, x')} LEFT JOIN p USING (id)")
def coerce_number(spark, sf_dir):
    """G1 to G4."""
    x = spark.createDataFrame(NUMBERS, "id int, x string")
    c = F.col("x")
    return x.select("id", vx.parse_number(c).alias("number"), vx.to_count(c).alias("whole"), vx.to_year(c).alias("year"), vx.to_budget(c).alias("budget"))


@query("coerce_props", r"SELECT event_id, nullif(regexp_extract(props, '\d+'), '')::DOUBLE AS number, CASE WHEN nullif(regexp_extract(props, '\d+'), '')::DOUBLE BETWEEN 1900 AND 2100 THEN nullif(regexp_extract(props, '\d+'), '')::INT END AS year FROM events")
def coerce_props(spark, sf_dir):
    """G1, G4 over the events' properties."""
    return table(spark, sf_dir, "events").select("event_id", vx.parse_number(F.regexp_extract("props", r"(\d+)", 1)).alias("number"), vx.to_year(F.regexp_extract("props", r"(\d+)", 1)).alias("year"))


TEXTS = [(1, "  a   b "), (2, "N/A"), (3, "—"), (4, "غير محدد"), (5, "برنامج"), (6, "Program X"), (7, "project"), (8, None), (9, "")]


@query("coerce_text", f"SELECT id, CASE WHEN NOT lower(s) IN ({', '.join(map(quoted, lx.NULL_WORDS))}) THEN s END AS text, CASE WHEN lower(trim(coalesce(x, ''))) IN ('program', 'project') THEN lower(trim(x)) WHEN contains(lower(coalesce(x, '')), 'برنامج') OR contains(lower(coalesce(x, '')), 'program') THEN 'program' ELSE 'project' END AS type FROM (SELECT id, x, {sql_squash('x')} AS s FROM {values(TEXTS, 'id, x')})")
def coerce_text(spark, sf_dir):
    """G5, G6."""
    return spark.createDataFrame(TEXTS, "id int, x string").select("id", vx.to_text(F.col("x")).alias("text"), vx.to_type(F.col("x")).alias("type"))


@query("numbers_in_text", f"SELECT doc_id, len(regexp_extract_all(text, '{lx.NUMBER}'))::INT AS n_numbers FROM documents")
def numbers_in_text(spark, sf_dir):
    """N12."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(vx.numbers(F.col("text"))).alias("n_numbers"))


ORDER_RECORDS = "SELECT o_custkey AS doc_id, o_orderkey AS item_no, CASE WHEN o_orderstatus = 'O' THEN 'program' ELSE 'project' END AS type, o_orderpriority AS name, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS description, NULL::DOUBLE AS beneficiaries_count, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice / 100000) END AS budget FROM orders"


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of their customer's document."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("item_no"), F.when(F.col("o_orderstatus") == "O", "program").otherwise("project").alias("type"), F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("description"), F.lit(None).cast("double").alias("beneficiaries_count"), F.when(F.col("o_orderkey") % 2 == 0, F.round(F.col("o_totalprice") / 100000)).alias("budget"),
        none.alias("beneficiary_value"), none.alias("target_audience"), none.alias("delivery_method"), none.alias("notes"),
    )


@query("merge_records", f"WITH r AS ({ORDER_RECORDS}) SELECT doc_id, item_no, name, year, budget FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name), year, beneficiaries_count, budget ORDER BY item_no) AS k FROM r) WHERE k = 1")
def merge_records(spark, sf_dir):
    """G9."""
    return records.merge_records(order_records(spark, sf_dir)).select("doc_id", "item_no", "name", "year", "budget")


@query("ordered_records", f"WITH r AS ({ORDER_RECORDS}) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY (type = 'project')::INT, item_no) - 1)::INT AS place, type, name, year, budget FROM r")
def ordered_records(spark, sf_dir):
    """O2."""
    return records.order_records(order_records(spark, sf_dir)).select("doc_id", "place", "type", "name", "year", "budget")


@query("autofill_top1", f"WITH r AS ({ORDER_RECORDS}) SELECT doc_id, type, name, year, budget FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (description IS NOT NULL)::INT + (budget IS NOT NULL)::INT DESC, item_no) AS k FROM r) WHERE k = 1")
def autofill_top1(spark, sf_dir):
    """O3, G10."""
    r = order_records(spark, sf_dir)
    asked = r.select("doc_id").distinct().withColumns({"warnings": F.array().cast("array<string>"), "truncated": F.lit(False)})
    return records.autofill(r, asked).select("doc_id", "type", "name", "year", "budget")


# ---------------------------------------------------------------- documents and files
@query("pipe_cells", f"WITH {LINES}, c AS (SELECT doc_id, line_no, list_filter(list_transform(string_split(raw, '|'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS cells FROM lines WHERE contains(raw, '|')) SELECT doc_id, line_no::INT AS line_no, len(cells)::INT AS n_cells, array_to_string(cells, ' | ') AS row FROM c")
def pipe_cells(spark, sf_dir):
    """C4, S6."""
    x = lines.explode_lines(table(spark, sf_dir, "documents"), text="text").where(F.contains("raw", F.lit("|"))).withColumn("cells", tx.row_cells(F.col("raw")))
    return x.select("doc_id", "line_no", F.size("cells").alias("n_cells"), docs_.row_line(F.col("cells")).alias("row"))


@query("page_policy", r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::INT AS letters, length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 40 OR length(text) - length(replace(text, chr(65533), '')) > 0.02 * length(text) AS needs_ocr FROM documents")
def page_policy(spark, sf_dir):
    """C11 to C13."""
    return table(spark, sf_dir, "documents").select("doc_id", docs_.letters(F.col("text")).alias("letters"), docs_.needs_ocr(F.col("text")).alias("needs_ocr"))


@query("truncate_doc", "SELECT doc_id, substr(text, 1, 1000) AS document, (length(text) > 1000)::INT AS warned FROM documents")
def truncate_doc(spark, sf_dir):
    """D2."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"), F.array().cast("array<string>").alias("warnings"))
    return docs_.truncate(d, 1000).select("doc_id", "document", F.size("warnings").alias("warned"))


@query("chunk_lines", r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS line, unnest(string_split(t, chr(10))) AS s FROM d WHERE length(t) > 2000),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, piece) AS k, substr(s, piece * 2000 + 1, 2000) AS s FROM (SELECT *, unnest(range(greatest(1, (length(s) + 1999) // 2000))) AS piece FROM l)),
r AS (SELECT doc_id, k, 0 AS chunk_no, s AS open FROM p WHERE k = 1 UNION ALL
SELECT p.doc_id, p.k, r.chunk_no + (length(r.open) + 1 + length(p.s) > 2000)::INT, CASE WHEN length(r.open) + 1 + length(p.s) > 2000 THEN p.s ELSE r.open || chr(10) || p.s END FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1)
SELECT doc_id, 0 AS chunk_no, t AS text FROM d WHERE length(t) <= 2000 UNION ALL SELECT doc_id, chunk_no, arg_max(open, k) AS text FROM r GROUP BY doc_id, chunk_no""")
def chunk_lines(spark, sf_dir):
    """D3, D4."""
    return docs_.chunks(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document")), 2000)


@query("document_year", rf"""WITH {LINES}, y AS (SELECT doc_id, line_no, sum(CASE WHEN squashed <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS place, squashed, CASE WHEN {sql_opens('n', lx.BANK_STARTS)} THEN [] ELSE list_filter(regexp_extract_all(raw, '\d+'), lambda x: regexp_matches(x, '^(19|20)\d\d$')) END AS ys FROM lines),
e AS (SELECT doc_id, place, line_no, generate_subscripts(ys, 1) AS k, unnest(ys)::INT AS year FROM y WHERE squashed <> ''),
c AS (SELECT doc_id, year, count(*) AS n, min(line_no * 1000 + k) AS seen FROM e GROUP BY doc_id, year),
r AS (SELECT doc_id, year, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS k, count(*) OVER (PARTITION BY doc_id) AS kinds, lead(n) OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS second FROM c),
early AS (SELECT doc_id, min(year) AS year FROM e WHERE place <= 20 GROUP BY doc_id HAVING count(DISTINCT year) = 1)
SELECT d.doc_id, coalesce(early.year, CASE WHEN r.kinds = 1 OR (r.n >= 3 AND r.n >= 2 * r.second) THEN r.year END) AS doc_year FROM documents d LEFT JOIN early USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id AND r.k = 1""")
def document_year(spark, sf_dir):
    """R2."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))
    return grounding.document_years(d, lines.predicates(lines.explode_lines(d)))


@query("detect_kind", r"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN CASE WHEN regexp_matches(text, '^\s*[\[{]') THEN 'json' ELSE 'text' END ELSE 'text' END AS kind FROM documents")
def detect_kind(spark, sf_dir):
    """Texts with names of several kinds; PDF's extension does not make a text one."""
    d = table(spark, sf_dir, "documents")
    name = F.element_at(F.array(F.lit("a.csv"), F.lit("b.JSON"), F.lit("c.pdf"), F.lit(None).cast("string")), (F.col("doc_id") % 4 + 1).cast("int"))
    mime = F.when(F.col("doc_id") % 4 == 3, "text/plain; charset=utf-8")
    return d.select("doc_id", files_.detect_kind(F.col("text").cast("binary"), name, mime).alias("kind"))


@query("base64_files", "SELECT doc_id, strlen(text)::INT AS size, sha256(text) AS sha256 FROM documents WHERE length(text) > 0")
def base64_files(spark, sf_dir):
    """Texts that come as base64, with and without a data: header."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    data = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("data:text/plain;base64,")).otherwise(F.lit("")), F.base64(F.col("text").cast("binary")))
    spec = F.struct(F.lit(1).alias("index"), F.lit("a.txt").alias("name"), data.alias("data"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("mime_type"))
    files = req.materialize(d.select("doc_id", F.array(spec).alias("files"), F.lit(None).cast("string").alias("error")), key="doc_id").where("error is null")
    return files.select("doc_id", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


@query("normalize_requests", r"SELECT doc_id AS job, doc_id::VARCHAR AS run_id, CASE WHEN doc_id % 2 = 0 THEN 'extract_text' ELSE 'program_extract' END AS type, nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS text, (doc_id % 3 = 0)::INT AS n_files FROM documents")
def normalize_requests(spark, sf_dir):
    """Envelopes of two shapes, made from the documents."""
    d = table(spark, sf_dir, "documents")
    files = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("a.txt").alias("name"), F.lit("aGk=").alias("data"))))
    inner = F.struct(F.col("doc_id").alias("run_id"), "text", F.when(F.col("doc_id") % 2 == 0, "EXTRACT_TEXT ").alias("type"), files.alias("files"))
    raw = F.when(F.col("doc_id") % 5 == 0, F.to_json(F.struct(F.to_json(inner).alias("input")))).otherwise(F.to_json(inner))
    n = req.normalize(d.select(F.col("doc_id").alias("job"), raw.alias("raw")))
    return n.select("job", "run_id", "type", "text", F.size("files").alias("n_files"))


# ---------------------------------------------------------------- inline documents
REPORTS = [
    ("list", "التقرير السنوي 2024\nأبرز البرامج\nمسابقة قرآنية لتشجيع الطلاب على الحفظ والتنافس :مسابقة نور\nبرنامج الرعاية\nيقدم جلسات إرشادية للأسر وورش عمل شهرية في المدينة.\nمنجزات الجمعية\nمسابقة محلية"),
    ("sections", "أولا: برامج السقيا\nوصف عام للبرنامج.\nمبادرة سقيا الحجاج\nتوزيع عبوات الماء البارد\nعدد المستفيدين\n1200\nالفئة المستهدفة مكان التنفيذ\nضيوف الرحمن من الرجال ساحات الحرم\nثانيا: برامج التعليم\nمشروع تعليم الكبار\nعدد المستفيدين\n45"),
    ("table", "اسم المشروع | عدد المستفيدين | الميزانية\nكسوة الشتاء | 300 | 15000"),
    ("english", "Annual Report 2025\nFeatured Programs\nYouth Skills: Provides practical training for young adults.\nFamily Support\nProvides counseling and referral support for families."),
]
ANSWERS = [("table", 0, '{"programs": [{"type": "مشروع", "name": "كسوة الشتاء", "year": 2019, "beneficiaries_count": "300", "budget": "15 ألف"}]}', False), ("list", 0, '```json\n[{"name": "مسابقة نور", "type": "project"},]\n```', False), ("english", 0, '{"programs": [{"name": "Youth Skills"}, {"name": "Fam', True)]


def reports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPORTS, "doc_id string, document string")


def answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANSWERS, "doc_id string, chunk_no int, raw string, truncated boolean")


def document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer of a model to the first chunk of each document, in four shapes: whole, fenced with a trailing comma, broken off, one value after the other."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    item = F.to_json(F.struct(F.lit("program").alias("type"), F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0).alias("name"), F.col("text").alias("description")))
    shape = F.col("doc_id") % 4
    raw = (
        F.when(shape == 0, F.concat(F.lit('{"programs": ['), item, F.lit("]}")))
        .when(shape == 1, F.concat(F.lit("<think>hm [</think>```json\n["), item, F.lit(",]\n```")))
        .when(shape == 2, F.concat(F.lit('{"programs": ['), item, F.lit(', {"name": "cut')))
        .otherwise(F.concat(item, F.lit(', {"name": "second", "year": 2020}')))
    )
    return d.select(F.col("doc_id").cast("string"), F.lit(0).alias("chunk_no"), raw.alias("raw"), (shape == 2).alias("truncated"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("document"))


def part_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on each part: a list of programs that has the part's name."""
    text = F.concat(F.lit("Annual Report "), (F.col("p_size") % 20 + 2001).cast("string"), F.lit("\nFeatured Programs\n"), F.initcap("p_name"), F.lit(": Provides practical training for young adults.\nFamily Support\nProvides counseling and referral support for families."))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("doc_id"), text.alias("document"))


ITEM_FIELDS = ("type", "name", "year", "description", "beneficiaries_count", "budget", "beneficiary_value", "target_audience", "delivery_method", "notes")
SAID = [("english", 0, None, "Youth Skills", None, None, None, None, None, None, None, None), ("list", 0, "project", "مسابقة نور", None, None, None, None, None, None, None, None), ("table", 0, "مشروع", "كسوة الشتاء", "2019", None, "300", "15 ألف", None, None, None, None)]
FIRST_WORD = r"regexp_extract(text, '[^\x20\x09-\x0D]+')"
NO_MORE = ", ".join(f"NULL::VARCHAR AS {f}" for f in ITEM_FIELDS[4:])


@query("json_items", f"""SELECT doc_id, item_no::INT AS item_no, {", ".join(f"{f}::VARCHAR AS {f}" for f in ITEM_FIELDS)} FROM {values(SAID, "doc_id, item_no, " + ", ".join(ITEM_FIELDS))}
UNION ALL SELECT doc_id::VARCHAR, 0, 'program', {FIRST_WORD}, NULL, text, {NO_MORE} FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id::VARCHAR, 1, NULL, 'second', '2020', NULL, {NO_MORE} FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 3""")
def items(spark, sf_dir):
    """F1 to F5, E4, over all documents and the inline reports."""
    source = cand.StaticSource(answers(spark).unionByName(document_answers(spark, sf_dir)))
    return cand.items(source.generate(docs_.chunks(documents(spark, sf_dir).unionByName(reports(spark)), 35_000), 8192))


FOUND = [
    ("english", "youthskills", "Youth Skills", "program", 2, 5, None, 0), ("english", "familysupport", "Family Support", "program", 3, 5, None, 1), ("list", "نور", "مسابقة نور", "program", 2, 5, None, 0), ("list", "الرعاية", "برنامج الرعاية", "program", 3, 5, None, 1),
    ("sections", "السقيا", "برامج السقيا", "program", 0, 5, 1, 0), ("sections", "التعليم", "برامج التعليم", "program", 8, 5, 2, 1), ("sections", "سقياالحجاج", "مبادرة سقيا الحجاج", "project", 2, 4, None, 2), ("sections", "تعليمالكبار", "مشروع تعليم الكبار", "project", 9, 4, None, 3),
]
PART_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"


@query("discover_structure", f"""SELECT doc_id, key, title, type, line_no::INT AS line_no, confidence::INT AS confidence, rank::INT AS rank, ord::INT AS ord FROM {values(FOUND, "doc_id, key, title, type, line_no, confidence, rank, ord")}
UNION ALL SELECT 'part ' || p_partkey, replace(lower(p_name), ' ', ''), {PART_TITLE}, 'program', 2, 5, NULL, 0 FROM part
UNION ALL SELECT 'part ' || p_partkey, 'familysupport', 'Family Support', 'program', 3, 5, NULL, 1 FROM part""")
def discover_structure(spark, sf_dir):
    """S1 to S11, over all documents (none of which declares an entity), a report on each part and the inline reports."""
    every = documents(spark, sf_dir).unionByName(part_reports(spark, sf_dir)).unionByName(reports(spark))
    return structure.discover(settle(lines.line_table(every), "lines"))


KEPT = [
    ("english", 0, "program", "Youth Skills", 2025, "Provides practical training for young adults.", None, None, None, None, None, None), ("english", 1, "program", "Family Support", 2025, "Provides counseling and referral support for families.", None, None, None, None, None, None),
    ("list", 0, "program", "مسابقة نور", 2024, "مسابقة قرآنية لتشجيع الطلاب على الحفظ والتنافس", None, None, None, None, None, None), ("list", 1, "program", "برنامج الرعاية", 2024, "يقدم جلسات إرشادية للأسر وورش عمل شهرية في المدينة.", None, None, None, None, None, None),
    ("sections", 0, "program", "برامج السقيا", None, "وصف عام للبرنامج.", None, None, None, None, None, None), ("sections", 1, "program", "برامج التعليم", None, None, None, None, None, "ضيوف الرحمن من الرجال", "ساحات الحرم", None),
    ("sections", 2, "project", "مبادرة سقيا الحجاج", None, "توزيع عبوات الماء البارد", 1200, None, None, "ضيوف الرحمن من الرجال", "ساحات الحرم", None), ("sections", 3, "project", "مشروع تعليم الكبار", None, None, 45, None, None, None, None, None),
    ("table", 0, "project", "كسوة الشتاء", None, None, 300, 15000, None, None, None, None),
]
NONE_GROUNDED = "NULL, NULL, NULL, NULL, NULL, NULL, 0"


@query("ground_records", f"""SELECT doc_id, item_no::INT AS item_no, type, name, year::INT AS year, description::VARCHAR AS description, beneficiaries_count::DOUBLE AS beneficiaries_count, budget::DOUBLE AS budget, beneficiary_value::VARCHAR AS beneficiary_value, target_audience::VARCHAR AS target_audience, delivery_method::VARCHAR AS delivery_method, notes::VARCHAR AS notes, 0 AS nulled
FROM {values(KEPT, "doc_id, item_no, " + ", ".join(ITEM_FIELDS))}
UNION ALL SELECT 'part ' || p_partkey, 0, 'program', {PART_TITLE}, p_size % 20 + 2001, 'Provides practical training for young adults.', {NONE_GROUNDED} FROM part
UNION ALL SELECT 'part ' || p_partkey, 1, 'program', 'Family Support', p_size % 20 + 2001, 'Provides counseling and referral support for families.', {NONE_GROUNDED} FROM part""")
def ground_records(spark, sf_dir):
    """R1 to R20, S10, S12, S13, over a report on each part and the inline reports."""
    found = cand.items(cand.StaticSource(answers(spark)).generate(docs_.chunks(reports(spark), 35_000), 8192))
    return grounding.ground(records.clean_items(found), part_reports(spark, sf_dir).unionByName(reports(spark)))[0]


@query("ground_documents")
def ground_documents(spark, sf_dir):
    """R1 to R20 over all documents, with candidates that name a document's first word: SQL has no such thing."""
    return grounding.ground(records.clean_items(items(spark, sf_dir)), documents(spark, sf_dir))[0]


COLUMNS = [(1, ["مكان التنفيذ الفئة المستهدفة", "مقر الجمعية ، ضيوف الرحمن من", "12 116 الفنادق الرجال والنساء."]), (2, ["الفئة المستهدفة", "الأيتام"]), (3, [])]


SPLIT = [(1, "ضيوف الرحمن من الرجال والنساء.", "مقر الجمعية الفنادق"), (2, None, None), (3, None, None)]


@query("multicolumn_split", f"SELECT id, target, delivery FROM {values(SPLIT, 'id, target, delivery')}")
def multicolumn_split(spark, sf_dir):
    """R11 to R14."""
    return spark.createDataFrame(COLUMNS, "id int, context array<string>").select("id", columns_split.split_columns_udf("context").alias("s")).select("id", "s.target", "s.delivery")


DISPLAYED = [(1, "وتوز يع حلوى العيد"), (2, "تتضمن(:أرًزا مع الدجاج)"), (3, "مبادرة ُسلوان"), (4, "  "), (5, "الحفاوةبالزائرات"), (6, None)]


SHOWN = [(1, "وتوزيع حلوى العيد"), (2, "تتضمن: (أرزًا مع الدجاج)"), (3, "مبادرة سلوان"), (4, None), (5, "الحفاوة بالزائرات"), (6, None)]


@query("display_clean", f"SELECT id, text, text AS place FROM {values(SHOWN, 'id, text')}")
def display_clean(spark, sf_dir):
    """R18, R19."""
    return spark.createDataFrame(DISPLAYED, "id int, x string").select("id", tx.display(F.col("x")).alias("text"), tx.display_delivery(F.col("x")).alias("place"))


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def sample_files() -> list[tuple[str, str | None, str | None, bytes]]:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>تقرير</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>كفالة</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1200</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    xlsx = {
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="المشاريع" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="inlineStr"><is><t>كفالة يتيم</t></is></c><c r="B1"><v>2024</v></c><c r="D1"><v>0.5</v></c></row><row/></sheetData></worksheet>',
    }
    return [("docx", "report.docx", None, _zip({"word/document.xml": docx})), ("xlsx", "wrong.docx", None, _zip(xlsx)), ("csv", "a.csv", None, "الاسم;العدد\nتدريب;50\n".encode("cp1256")), ("json", None, "application/json", json.dumps({"a": [1]}).encode()), ("pptx", "deck.pptx", None, _zip({"ppt/presentation.xml": "<x/>"})), ("binary", None, None, b"\x00\x01")]


READ = [
    ("docx", "تقرير\n===== TABLE START =====\nكفالة | 1200\n===== TABLE END =====", "docx", "docx-xml", None), ("xlsx", "===== SHEET: المشاريع =====\n===== TABLE START =====\nكفالة يتيم | 2024 | | 0.5\n===== TABLE END =====", "xlsx", "xlsx-xml", None),
    ("csv", "الاسم | العدد\nتدريب | 50", "csv", "text", None), ("json", '{\n"a": [\n1\n]\n}', "json", "text", None),
    ("pptx", None, "error", None, f"PowerPoint files are not supported. Supported: {lx.SUPPORTED}."), ("binary", None, "error", None, f"Unsupported file type (unknown). Supported: {lx.SUPPORTED}."),
]


@query("extract_files", f"SELECT id, text, kind, method, error FROM {values(READ, 'id, text, kind, method, error')}")
def extract_files(spark, sf_dir):
    """C3, C5 to C7, C9, C16."""
    f = spark.createDataFrame(sample_files(), "id string, name string, mime_type string, content binary")
    return files_.extract_files(f).select("id", "text", "kind", "method", "error")


DONE = [("list", None, None, None, 2, "مسابقة نور"), ("xlsx", None, 99, hashlib.sha256(READ[1][1].encode()).hexdigest(), None, None), ("table", None, None, None, None, "كسوة الشتاء"), ("empty", "nothing to process: send text or a file", None, None, None, None)]


@query("process_requests", rf"""WITH d AS (SELECT doc_id, nullif(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '') AS t, {FIRST_WORD} AS word FROM documents),
e AS (SELECT *, '===== USER TEXT =====' || chr(10) || t AS document FROM d)
SELECT job, error, chars::BIGINT AS chars, sha256, n_records::INT AS n_records, first_name FROM {values(DONE, 'job, error, chars, sha256, n_records, first_name')}
UNION ALL SELECT doc_id::VARCHAR, CASE WHEN t IS NULL THEN 'nothing to process: send text or a file' END, CASE WHEN doc_id % 2 = 0 THEN length(document) END, CASE WHEN doc_id % 2 = 0 THEN sha256(document) END,
CASE WHEN doc_id % 2 = 1 AND t IS NOT NULL THEN CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END END, CASE WHEN doc_id % 2 = 1 AND t IS NOT NULL THEN word END FROM e""")
def process_requests(spark, sf_dir):
    """From intake to results. Inline envelopes of all three types and bad ones, grounded; and one for each document, with what a model says of it."""
    b64 = lambda b: base64.b64encode(b).decode()
    jobs = {"list": {"text": REPORTS[0][1]}, "table": {"type": "program_autofill", "input": json.dumps({"files": ["t.txt"]}), "attachments": [b64(REPORTS[2][1].encode())]}, "xlsx": {"type": "extract_text", "files": [{"name": "b.xlsx", "data": b64(sample_files()[1][3])}]}, "empty": {"input": "{}"}}
    raw = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in jobs.items()], "job string, raw string")
    few = pipeline.process(raw, cand.StaticSource(answers(spark)))
    sent = F.to_json(F.struct("text", F.when(F.col("doc_id") % 2 == 0, "extract_text").otherwise("program_extract").alias("type")))
    many = pipeline.process(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job"), sent.alias("raw")), cand.StaticSource(document_answers(spark, sf_dir)), Options(strict_grounding=False))
    told = lambda path: F.get_json_object("result", path)
    return few.unionByName(many).select("job", "error", told("$.chars").cast("long").alias("chars"), told("$.sha256").alias("sha256"), F.json_array_length("result").alias("n_records"), F.coalesce(told("$[0].name"), told("$.name")).alias("first_name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
