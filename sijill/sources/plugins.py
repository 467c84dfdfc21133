"""Readers that need tools which may be missing (C8, C10, C14, C15), a fetcher for addresses (A9) and a model host.

``install()`` registers the readers whose tools are there; the others keep the answer of an unsupported file.
"""

from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
import tempfile
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.options import Options
from sijill.sources import candidates as cand
from sijill.sources import files as files_


# ---------------------------------------------------------------- readers
def read_doc(raw: bytes, o: Options) -> tuple[str, str, list[str]]:
    """The first tool that works reads a legacy Word file."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "in.doc"
        path.write_bytes(raw)
        if shutil.which("antiword"):
            done = subprocess.run(["antiword", "-w", "0", "-m", "UTF-8.txt", path], capture_output=True, timeout=60, check=False)
            if not done.returncode and done.stdout.strip():
                return files_.clean(done.stdout.decode("utf-8", "replace")), "antiword", []
        if shutil.which("soffice"):
            subprocess.run(["soffice", "--headless", "--convert-to", "docx", "--outdir", folder, path], capture_output=True, timeout=120, check=False)
            made = Path(folder) / "in.docx"
            if made.exists():
                return files_.read_docx(made.read_bytes(), o), "soffice+docx-xml", []
    raise files_.Unsupported("Legacy .doc could not be read; save it as .docx.")


def read_xls(raw: bytes, o: Options) -> tuple[str, str, list[str]]:
    """The cap counts physical rows."""
    import xlrd

    book, out = xlrd.open_workbook(file_contents=raw), []
    for sheet in book.sheets():
        rows = []
        for r in range(min(sheet.nrows, o.max_sheet_rows)):
            cells = [xlrd.xldate.xldate_as_datetime(c.value, book.datemode) if c.ctype == xlrd.XL_CELL_DATE else c.value for c in sheet.row(r)]
            if line := files_.row_text(cells):
                rows.append(files_.clean(line))
        if rows:
            out += [files_.SHEET.format(sheet.name), files_.TABLE_START, *rows, files_.TABLE_END]
    return "\n".join(out), "xlrd", []


def ocr_image(path: str, env=os.environ) -> str:
    """Recognition of one page image by a subprocess with a time limit."""
    done = subprocess.run(["tesseract", path, "stdout", "-l", env.get("OCR_LANG", "ara+eng"), "--psm", env.get("OCR_PSM", "6"), "--dpi", env.get("PDF_OCR_DPI", "200")], capture_output=True, timeout=float(env.get("OCR_TIMEOUT", "120")), check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip() or "recognition failed")
    return done.stdout.decode("utf-8", "replace")


def read_pdf(raw: bytes, o: Options) -> tuple[str, str, list[str]]:
    """C14: text layers, and recognition where they are doubtful."""
    import pymupdf

    with pymupdf.open(stream=raw, filetype="pdf") as doc, tempfile.TemporaryDirectory() as folder:
        if doc.needs_pass:
            raise files_.Unsupported("PDF is password-protected.")

        def ocr(page: int) -> str:
            path = f"{folder}/{page}.png"
            doc[page - 1].get_pixmap(dpi=int(os.environ.get("PDF_OCR_DPI", "200"))).save(path)
            return ocr_image(path)

        layers = [doc[k].get_text("text", sort=True) if k < o.max_pdf_pages else "" for k in range(doc.page_count)]
        return files_.assemble_pages(layers, o, ocr if shutil.which("tesseract") else None)


def install() -> list[str]:
    """Registers what can run here; returns the kinds."""
    there = {
        "pdf": (read_pdf, importlib.util.find_spec("pymupdf")),
        "xls": (read_xls, importlib.util.find_spec("xlrd")),
        "doc": (read_doc, shutil.which("antiword") or shutil.which("soffice")),
    }
    files_.PLUGINS.update({kind: f for kind, (f, ok) in there.items() if ok})
    return sorted(files_.PLUGINS)


# ---------------------------------------------------------------- addresses
def download(url: str, limit: int, timeout: float = 60) -> tuple[bytes, str | None]:
    """The body, read in pieces and given up beyond the limit, and the type that the server names."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError("not a web address")
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310  the scheme is checked above
        body = bytearray()
        while piece := r.read(1 << 20):
            body += piece
            if len(body) > limit:
                raise ValueError("the file is too large")
        return bytes(body), (r.headers.get("Content-Type") or "").split(";")[0].strip() or None


def fetch(files: DataFrame, fetcher: Callable[[str, int], tuple[bytes, str | None]] = download, options: Options | None = None) -> DataFrame:
    """files (url, content, mime_type, error) with the contents of those that have an address alone."""
    limit = (options or Options()).max_file_bytes

    @F.pandas_udf("content binary, mime_type string, error string")
    def get(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in urls:
            rows = []
            for url in batch:
                try:
                    body, kind = fetcher(url, limit)
                    rows.append((body, kind, None if body else "the file is empty"))
                except Exception as e:  # a failed download fails its request, not the job
                    rows.append((None, None, f"download failed: {e}"))
            yield pd.DataFrame(rows, columns=["content", "mime_type", "error"])

    wanted = files.where("url is not null and content is null and error is null")
    got = wanted.withColumn("_g", get("url"))
    rest = [c for c in files.columns if c not in ("content", "mime_type", "error")]
    done = got.select(*rest, F.col("_g.content").alias("content"), F.coalesce("mime_type", "_g.mime_type").alias("mime_type"), F.col("_g.error").alias("error"))
    return done.unionByName(files.where("url is null or content is not null or error is not null").select(*done.columns))


# ---------------------------------------------------------------- language model
class ModelSource:
    """A model host. load() runs once in each worker process and returns generate(messages, budget) -> (text, cut off).

    A chunk that fails keeps its row, with its error; running out of memory ends the task, as a smaller share of a worker would
    not help the next chunk either.
    """

    def __init__(self, load: Callable[[], Callable[[list[dict], int], tuple[str, bool]]]):
        self.load = load

    def generate(self, chunks: DataFrame, max_new_tokens: int) -> DataFrame:
        load = self.load

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for b in batches:
                rows = []
                for doc, no, said in zip(b.doc_id, b.chunk_no, b.messages, strict=True):
                    try:
                        model = model or load()
                        raw, cut = model([dict(m) if isinstance(m, dict) else m.asDict() for m in said], max_new_tokens)
                        rows.append((doc, no, raw, bool(cut), None))
                    except MemoryError:
                        raise
                    except Exception as e:
                        rows.append((doc, no, None, False, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "raw", "truncated", "error"])

        x = chunks.select("doc_id", "chunk_no", cand.messages(F.col("text"), F.col("chunk_no"), F.col("chunks")).alias("messages"))
        kind = dict(x.dtypes)["doc_id"]
        return x.mapInPandas(run, f"doc_id {kind}, chunk_no int, raw string, truncated boolean, error string")

    def warm_up(self, spark, workers: int) -> None:
        """Loads the model in the workers ahead of the first request."""
        load = self.load

        def run(batches):
            load()
            yield from batches

        spark.range(workers, numPartitions=workers).mapInPandas(run, "id long").count()


def weights(name: str, folders: tuple[str, ...] = (), cache: str | None = None) -> str:
    """A folder that holds the model, else the newest snapshot in a hub cache, else the hub's name."""
    for f in folders:
        if (Path(f) / "config.json").exists():
            return str(f)
    snapshots = sorted((Path(cache) / f"models--{name.replace('/', '--')}" / "snapshots").glob("*/"), key=lambda p: p.stat().st_mtime) if cache else []
    return str(snapshots[-1]) if snapshots else name
