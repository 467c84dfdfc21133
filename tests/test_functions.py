"""Text and value functions, request intake, files, documents and records."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sijill.functions import columns_split, json_items
from sijill.functions import lexicon as lx
from sijill.functions import text as tx
from sijill.functions import values as vx
from sijill.operators import documents as docs_
from sijill.operators import records
from sijill.options import Options
from sijill.plans.registry import sample_files
from sijill.sources import files as files_
from sijill.sources import requests as req


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_normal_form(spark):
    given = ["ٱلبَرنامَج ١٢", "إكـــرام أُسرة؛ آل مصطفى", "Déjà-vu 3", "  ", "قال، نعم؟", "أ،ب"]
    got = column(spark, given, lambda c: tx.norm(tx.nfkc(c)))
    assert got == [lx.normal(x) for x in given]
    assert got[1] == "اكرام اسره؛ ال مصطفي".replace("اسره", "اسرة") and got[2] == "d j vu 3"
    assert column(spark, got, tx.norm) == got


def test_presentation_forms_and_white_space(spark):
    got = column(spark, ["ﺍﻟﺒﺮﻧﺎﻣﺞ", "a  b \r\n\r\n\r\n\r\n c‏", None], docs_.clean_text)
    assert got == ["البرنامج", "a b\n\nc", ""] == [files_.clean(x) for x in ("ﺍﻟﺒﺮﻧﺎﻣﺞ", "a  b \r\n\r\n\r\n\r\n c‏", None)]
    assert column(spark, ["عنوان أول          عنوان ثان", "a\tb"], docs_.clean_paragraph) == ["عنوان أول | عنوان ثان", "a | b"]


def test_names(spark):
    assert column(spark, ["مشروع السقيا (المرحلة", "إ كرام", "إكرام", "(x", None], tx.name_key) == ["السقيا", "اكرام", "اكرام", "", ""]
    assert column(spark, ["مشروع السقيا", "السقيا"], tx.name_forms) == [["مشروع السقيا", "السقيا"], ["السقيا"]]
    assert column(spark, ["16 1.مبادرة سقيا", "570 مشروع", "* 3- x"], tx.without_numbering) == ["مبادرة سقيا", "570 مشروع", "x"]


def test_numbers(spark):
    assert column(spark, ["12 116 و 3 آلاف", "2.5 مليون", "", None, "٧ x 8"], vx.numbers) == [[12116.0 * 1e3, 3000.0], [2.5e6], [], [], [7.0, 8.0]]
    assert column(spark, ["1,200 مستفيد", "-5", "n/a", "1.5 مليون", None], vx.to_count) == [1200, 5, None, 1500000, None]
    assert column(spark, ["2025م", "1446", "٢٠٢٤"], vx.to_year) == [2025, None, 2024]
    assert column(spark, ["2.675", "0.125", "٤٥٬٠٠٠٫٥"], vx.to_budget) == [2.68, 0.12, 45000.5]


def test_display_repairs(spark):
    pairs = {"تأهيل وتدر يب فرق": "تأهيل وتدريب فرق", "لتعز يز الأثر": "لتعزيز الأثر", "القرآن الكر يم": "القرآن الكريم", "شملت(:سجادة)": "شملت: (سجادة)", "انتهى.بدأ": "انتهى. بدأ", "الحفاوةبالزائرات": "الحفاوة بالزائرات", " ؛ x": "x"}
    assert column(spark, list(pairs), tx.display) == list(pairs.values())
    assert column(spark, ["مقر الجمعية الفنادق"], tx.display_delivery) == ["مقر الجمعية، الفنادق"]


def test_reversed_arabic(spark):
    words = ["البستان", "المكتبة", "الطريق", "المدينة"] * 6
    assert column(spark, [" ".join(words), " ".join(w[::-1] for w in words), "x"], docs_.looks_reversed) == [False, True, False]


@pytest.mark.parametrize("lines, audience, place", [
    (["مكان التنفيذ الفئة المستهدفة", "مقر الجمعية ، ضيوف الرحمن من", "12 116 الفنادق الرجال والنساء."], "ضيوف الرحمن من الرجال والنساء.", "مقر الجمعية الفنادق"),
    (["مكان التنفيذ الفئة المستهدفة", "العاملون والمهتمون", "2 12 غرفة جدة", "بالقطاع غير الربحي"], "العاملون والمهتمون بالقطاع غير الربحي", "غرفة جدة"),
    (["مكان التنفيذ الفئة المستهدفة", "مشرفات اللجان", "5 60 عن بعد", "في حملات الحج"], "مشرفات اللجان في حملات الحج", "عن بعد"),
    (["مكان التنفيذ الفئة المستهدفة", "مستشفى السلام المر يضات من ضيفات", "3 6 التخصصي بجدة الرحمن", "المكرمة"], "المر يضات من ضيفات الرحمن", "مستشفى السلام التخصصي بجدة المكرمة"),
    (["الفئة المستهدفة", "الأيتام"], None, None),
    ([], None, None),
])
def test_two_wrapped_columns(lines, audience, place):
    assert columns_split.split_columns(lines) == (audience, place)


def test_json_items():
    names = lambda raw, cut=False: [i.get("name") for i in json_items.parse_items(raw, cut)[0]]
    assert names('```json\n{"programs":[{"name":"a"},]}\n```') == ["a"]
    assert names('{"programs":[{"name":"a"},{"name":"b","year":1},{"name":"c","descr', True) == ["a", "b"]
    assert names('<think>{</think>{"name":"a"}\n{"name":"b"},\n{"r":{"programs":[{"name":"c"}]}}') == ["a", "b", "c"]
    assert json_items.parse_items('{"programs":[]}') == ([], None)
    assert json_items.parse_items("prose")[1] and json_items.parse_items(None)[1]


def envelope(spark, *jobs):
    raw = spark.createDataFrame([(i, None if j is None else j if isinstance(j, str) else json.dumps(j)) for i, j in enumerate(jobs)], "job int, raw string")
    return req.normalize(raw).orderBy("job").collect()


def test_request_shapes(spark):
    data = base64.b64encode(b"hello").decode()
    got = envelope(spark,
        {"run_id": 42, "type": "program_autofill", "input": json.dumps({"text": " t ", "files": ["a.txt"]}), "attachments": [data]},
        {"input": '{"files":["a","a"]}', "files": [{"data": data}, {"base64": data}]},
        {"file_url": "https://x/y.pdf", "name": "y.pdf"},
        {"files": [{"filename": "b.txt", "content": data, "mimeType": "text/plain"}, "https://x/z"]},
        {"input": "{}"}, {"input": '{"files":["a.pdf"]}'}, None, "not json", "[1]", {"files": [3]}, {"files": [{"data": data}] * 6}, {"type": "other", "text": "x"}, {"input": "{", "text": "x"})
    assert (got[0]["run_id"], got[0]["type"], got[0]["text"]) == ("42", "program_autofill", "t") and got[0]["files"][0]["name"] == "a.txt" and got[0]["files"][0]["data"] == data
    assert [f["name"] for f in got[1]["files"]] == ["a", "a"] and all(f["data"] == data for f in got[1]["files"])
    assert got[2]["files"][0]["url"] == "https://x/y.pdf" and got[2]["type"] == "program_extract"
    assert got[3]["files"][0]["mime_type"] == "text/plain" and got[3]["files"][1]["url"] == "https://x/z"
    assert all(r["error"] is None for r in got[:4]) and all(r["error"] for r in got[4:])


def test_base64(spark):
    raw = bytes(range(250, 256)) * 3
    given = [base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("="), "data:x/y;base64," + base64.b64encode(raw).decode(), "a b\nGk=", "!!!"]
    got = [None if x is None else bytes(x) for x in column(spark, given, req.decode_base64)]
    assert got[:3] == [raw] * 3 and got[4] is None
    assert column(spark, ["a/b.PDF", "x", "a.verylongsuffix", None], req.safe_suffix) == [".pdf", "", "", ""]


def test_files(spark):
    rows = {r["id"]: r for r in files_.extract_files(spark.createDataFrame(sample_files(), "id string, name string, mime_type string, content binary")).collect()}
    assert rows["docx"]["text"] == "تقرير\n===== TABLE START =====\nكفالة | 1200\n===== TABLE END ====="
    assert rows["xlsx"]["kind"] == "xlsx" and "كفالة يتيم | 2024 |  | 0.5".replace("|  |", "| |") in rows["xlsx"]["text"] and "SHEET: المشاريع" in rows["xlsx"]["text"]
    assert rows["csv"]["text"] == "الاسم | العدد\nتدريب | 50" and rows["json"]["text"] == '{\n"a": [\n1\n]\n}'
    assert "PowerPoint" in rows["pptx"]["error"] and rows["binary"]["error"]


def test_cells_and_merged_cells():
    assert files_.row_text(["a", "3000", "3000", None]) == "a | 3000 | 3000" and files_.row_text([True, 2.0, 1234567.5, 0.5, None, ""]) == "TRUE | 2 | 1.23457e+06 | 0.5"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:tbl><w:tr>{cell("title")}</w:tr><w:tr>{cell("a")}{cell("1")}{cell("1")}</w:tr></w:tbl><w:p><w:r><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    assert files_.read_docx(out.getvalue(), Options()) == "===== TABLE START =====\ntitle\na | 1 | 1\n===== TABLE END =====\n===== TEXT BOXES =====\nboxed"


def test_pdf_policy():
    good, o = "A page with well over forty letters in its text layer, surely.", Options()
    assert files_.assemble_pages([good], o) == (f"===== PAGE 1 =====\n{good}", "pdf-text-layer", [])
    text, method, warnings = files_.assemble_pages([good, ""], o, lambda k: "seen by recognition")
    assert method == "pdf-text-layer+tesseract-ocr" and "===== PAGE 2 =====\nseen by recognition" in text and not warnings
    assert files_.assemble_pages([""], o)[2] and files_.assemble_pages([good] * 3, Options(max_pdf_pages=2))[2]


def test_options_from_env():
    assert Options.from_env({"MAX_FILES": "7", "STRICT_GROUNDING": "off", "CHUNK_CHARS": "x"}) == Options(max_files=7, strict_grounding=False)


def test_chunks_lose_no_line(spark):
    text = "\n".join(["===== FILE 1: a =====", *(f"line {k} " + "x" * (k % 40) for k in range(60)), "===== PAGE 2 =====", "y" * 130, "end"])
    got = [r["text"] for r in docs_.chunks(spark.createDataFrame([("a", text), ("b", "short")], "doc_id string, document string"), 100).where("doc_id = 'a'").orderBy("chunk_no").collect()]
    assert all(len(c) <= 100 for c in got)
    assert "".join(got).replace("\n", "") == text.replace("\n", "")


def test_records(spark):
    fields = ", ".join(f"{f} string" for f in lx.FIELDS)
    items = [("d", 0, "مشروع", "  سقيا   الماء ", "٢٠٢٥م", "", "1,200", "٤٥٬٠٠٠٫٥ ريال", None, "أسر، أيتام", None, "null"), ("d", 1, "program", "", *[None] * 8), ("d", 2, "برنامج", "b", *[None] * 8), ("d", 3, "program", "B", *[None] * 8)]
    clean = records.clean_items(spark.createDataFrame(items, f"doc_id string, item_no int, {fields}"))
    first = clean.orderBy("item_no").first()
    assert (first["type"], first["name"], first["year"], first["description"], first["beneficiaries_count"], first["budget"], first["notes"]) == ("project", "سقيا الماء", 2025, None, 1200.0, 45000.5, None)
    merged = records.merge_records(clean)
    assert [r["item_no"] for r in merged.orderBy("item_no").collect()] == [0, 2]
    assert [r["name"] for r in records.order_records(merged).orderBy("place").collect()] == ["b", "سقيا الماء"]
    asked = spark.createDataFrame([("d", ["w"], True), ("e", [], False)], "doc_id string, warnings array<string>, truncated boolean")
    best = {r["doc_id"]: r for r in records.autofill(merged, asked).collect()}
    assert best["d"]["name"] == "سقيا الماء" and "تم العثور على 2" in best["d"]["notes"] and best["d"]["notes"].endswith(lx.SAID_CUT) and "\nw\n" in best["d"]["notes"]
    assert best["e"]["name"] is None and best["e"]["notes"] == lx.SAID_NONE
