"""Plug-ins: a fetcher, readers that need tools, a model host and the lookup of weights, all with stand-ins."""

import json
import os
import sys
import types

import pytest

from sijill.options import Options
from sijill.plans import pipeline

from sijill.sources import candidates as cand
from sijill.sources import files as files_
from sijill.sources import plugins
from sijill.sources import requests as req
from sijill.storage import settle


def test_fetch(spark):
    def fetcher(url, limit):
        if "bad" in url:
            raise OSError("no route")
        return url.encode(), "text/plain"

    files = spark.createDataFrame([(1, "http://a", None, None, None), (2, "http://bad", None, None, None), (3, None, b"x", "m", None)], "id int, url string, content binary, mime_type string, error string")
    got = {r["id"]: (r["content"] and bytes(r["content"]), r["mime_type"], r["error"]) for r in plugins.fetch(files, fetcher).collect()}
    assert got == {1: (b"http://a", "text/plain", None), 2: (None, None, "download failed: no route"), 3: (b"x", "m", None)}


def test_model_host(spark):
    def load():
        def model(messages, budget):
            if "boom" in messages[1]["content"]:
                raise ValueError("broken chunk")
            return '{"programs": [{"name": "n%d"}]}' % budget, False

        return model

    chunks = spark.createDataFrame([("d", 0, 2, "text"), ("d", 1, 2, "boom"), ("e", 0, 1, "boom")], "doc_id string, chunk_no int, chunks int, text string")
    answers = plugins.ModelSource(load).generate(chunks, 7)
    assert [(r["doc_id"], r["name"]) for r in cand.items(answers).collect()] == [("d", "n7")]
    report = {r["doc_id"]: r for r in cand.chunk_report(answers).collect()}
    assert not report["d"]["all_failed"] and report["e"]["all_failed"] and report["d"]["chunk_errors"] == ["chunk 2: ValueError: broken chunk"]
    plugins.ModelSource(load).warm_up(spark, 2)


def test_install_and_weights(tmp_path):
    assert set(plugins.install()) <= {"pdf", "xls", "doc"}
    files_.PLUGINS.clear()
    (tmp_path / "models--a--b" / "snapshots" / "x").mkdir(parents=True)
    assert plugins.weights("a/b", cache=str(tmp_path)).rstrip("/").endswith("snapshots/x")
    assert plugins.weights("a/b", (str(tmp_path),)) == "a/b"


def test_addresses_and_readers_in_the_pipeline(spark):
    def fetcher(url, limit):
        if "bad" in url:
            raise OSError("no route")
        return b"a,b\n1,2\n", "text/csv"

    jobs = {"good": {"type": "extract_text", "file_url": "https://x/t.csv"}, "bad": {"type": "extract_text", "files": [{"name": "b.csv", "url": "https://bad/t.csv"}]}, "both": {"type": "extract_text", "text": "own", "files": [{"name": "c.csv", "url": "http://x/c.csv"}]}}
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in jobs.items()], "job string, raw string")
    source = cand.StaticSource(spark.createDataFrame([], "doc_id string, chunk_no int, raw string, truncated boolean"))
    got = {r["job"]: (json.loads(r["result"])["text"] if r["result"] else None, r["error"]) for r in pipeline.process(raw, source, fetcher=fetcher).collect()}
    assert got["good"] == ("a | b\n1 | 2", None)
    assert got["bad"] == (None, "file #1: download failed: no route")
    assert got["both"][0].startswith("===== USER TEXT =====\nown") and got["both"][0].endswith("a | b\n1 | 2")
    off = pipeline.read_documents(settle(req.normalize(raw), "requests"), Options())
    assert {r["doc_id"]: r["error"] for r in off.collect()}["good"] == "file #1: download failed: no fetcher is set"


def test_download_reads_web_addresses_only():
    with pytest.raises(ValueError, match="web address"):
        plugins.download("file:///etc/passwd", 10)


def test_legacy_word_files_go_through_the_tool_that_is_there(tmp_path, monkeypatch):
    tool = tmp_path / "antiword"
    tool.write_text("#!/bin/sh\nprintf 'First  line\\n\\n\\n\\nlast'\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    text, method, warnings = plugins.read_doc(b"x", Options())
    assert (text, method, warnings) == ("First line\n\nlast", "antiword", []) and "doc" in plugins.install()
    files_.PLUGINS.clear()
    tool.write_text("#!/bin/sh\nexit 1\n")
    with pytest.raises(files_.Unsupported):
        plugins.read_doc(b"x", Options())


class Page:
    def __init__(self, text):
        self.text = text

    def get_text(self, *_, **__):
        return self.text


class Document(list):
    needs_pass = False
    page_count = property(len)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_pdf_pages_keep_their_layers(monkeypatch):
    pages = ["first page with more than forty letters of plain text here", "", "third page with more than forty letters of plain text too"]
    opened = Document(map(Page, pages))
    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda **_: opened))
    monkeypatch.setenv("PATH", "")
    text, method, warnings = plugins.read_pdf(b"%PDF", Options())
    assert text == f"===== PAGE 1 =====\n{pages[0]}\n\n===== PAGE 3 =====\n{pages[2]}" and method == "pdf-text-layer"
    assert warnings == ["1 page(s) look scanned but OCR is disabled."]
    opened.needs_pass = True
    with pytest.raises(files_.Unsupported, match="password"):
        plugins.read_pdf(b"%PDF", Options())


def test_old_spreadsheets(monkeypatch):
    cell = lambda v, kind=2: types.SimpleNamespace(value=v, ctype=kind)
    sheet = types.SimpleNamespace(name="S", nrows=2, row=lambda r: [[cell("a", 1), cell(2.0)], [cell("b", 1), cell(0.5)]][r])
    book = types.SimpleNamespace(datemode=0, sheets=lambda: [sheet])
    monkeypatch.setitem(sys.modules, "xlrd", types.SimpleNamespace(open_workbook=lambda **_: book, XL_CELL_DATE=3))
    text, method, _ = plugins.read_xls(b"x", Options())
    assert text.split("\n")[0] == "===== SHEET: S =====" and "a | 2" in text and "b | 0.5" in text and method == "xlrd"
