"""Requests: JSON envelopes of several shapes as one relation.

An envelope is read as a variant. An inner object (or JSON text) under ``input`` overlays the outer one; names and contents of
files are paired by position. A bad envelope keeps its row, with ``error`` set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.functions import lexicon as lx
from sijill.functions import text as tx
from sijill.options import Options

NAMES, DATA = ("name", "filename", "file_name", "fileName"), ("data", "base64", "content", "file_base64")
URLS, TYPES = ("url", "file_url", "download_url"), ("mime_type", "mimeType", "content_type", "contentType")
PART = "struct<name:string,data:string,url:string,mime_type:string>"


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, …; null for no value and for JSON's null."""
    return F.nullif(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1), F.lit("VOID"))


def field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def text_of(v: Column) -> Column:
    """A string that is not blank, stripped; null for anything else."""
    return F.when(kind_of(v) == "STRING", F.nullif(tx.strip(F.try_variant_get(v, "$", "string")), F.lit("")))


def first_text(v: Column, keys) -> Column:
    """A2."""
    return F.coalesce(*(text_of(field(v, k)) for k in keys))


def as_list(v: Column) -> Column:
    """A3: an array of variants."""
    kind = kind_of(v)
    return F.when(kind.isNull(), F.array().cast("array<variant>")).when(kind == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def looks_base64(s: Column) -> Column:
    """A4."""
    return s.startswith("data:") | ((F.length(s) >= 64) & F.substring(s, 1, 4096).rlike(r"^[A-Za-z0-9+/=_\-\s]+$"))


def part(v: Column, attachment: bool) -> Column:
    """A5: what one entry says about a file."""
    s, none = text_of(v), F.lit(None).cast("string")
    address = s.rlike("^https?://")
    held = F.lit(attachment) | looks_base64(s)
    return F.struct(
        F.when(s.isNotNull(), F.when(~address & ~held, s)).otherwise(F.when(kind_of(v) == "OBJECT", first_text(v, NAMES))).alias("name"),
        F.when(s.isNotNull(), F.when(~address & held, s)).otherwise(F.when(kind_of(v) == "OBJECT", first_text(v, DATA))).alias("data"),
        F.when(s.isNotNull(), F.when(address, s)).otherwise(F.when(kind_of(v) == "OBJECT", first_text(v, URLS))).alias("url"),
        F.when(s.isNotNull(), none).otherwise(F.when(kind_of(v) == "OBJECT", first_text(v, TYPES))).alias("mime_type"),
    )


def normalize(raw: DataFrame, options: Options | None = None, key: str = "job", text: str = "raw") -> DataFrame:
    """Job, run_id, type, text, files (index, name, data, url, mime_type) and error of each envelope."""
    o = options or Options()
    v = F.try_parse_json(F.when(F.trim(text) == "", "{}").otherwise(F.col(text)))
    x = raw.select(key, F.col(text), v.alias("outer"))
    inner = field(F.col("outer"), "input")
    said = text_of(inner)
    x = x.withColumns({
        "inner": F.when(kind_of(inner) == "STRING", F.try_parse_json(F.coalesce(said, F.lit("{}")))).otherwise(inner),
        "bad_inner": said.isNotNull() & F.try_parse_json(said).isNull(),
    })
    nested = F.coalesce(kind_of(F.col("inner")) == "OBJECT", F.lit(False))
    own = lambda k: F.when(nested, field(F.col("inner"), k))
    both = lambda k: F.coalesce(own(k), field(F.col("outer"), k))
    attached = F.coalesce(*(F.when(kind_of(both(k)).isNotNull(), both(k)) for k in ("attachments",)), F.when(own("files").isNotNull() & field(F.col("outer"), "files").isNotNull(), field(F.col("outer"), "files")), both("files_base64"), both("file_data"))
    x = x.withColumns({"entries": as_list(both("files")), "attached": as_list(attached), "legacy": F.coalesce(*(text_of(both(k)) for k in ("file_url", "url", "document_url"))), "legacy_name": F.coalesce(*(text_of(both(k)) for k in ("file_name", "filename", "name")))})
    n = F.greatest(F.size("entries"), F.size("attached"))
    slots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def spec(i: Column) -> Column:
        a, b = part(F.get("entries", i), False), part(F.get("attached", i), True)
        return F.struct((i + 1).cast("int").alias("index"), *(F.coalesce(a[f], b[f]).alias(f) for f in ("name", "data", "url", "mime_type")))

    odd = lambda arr: F.exists(arr, lambda e: ~F.coalesce(kind_of(e), F.lit("STRING")).isin("STRING", "OBJECT"))
    x = x.withColumns({"files": F.transform(slots, spec), "odd": odd("entries") | odd("attached")})
    last = F.struct((F.size("files") + 1).cast("int").alias("index"), F.col("legacy_name").alias("name"), F.lit(None).cast("string").alias("data"), F.col("legacy").alias("url"), F.lit(None).cast("string").alias("mime_type"))
    x = x.withColumns({"hollow": F.get(F.filter("files", lambda f: f["data"].isNull() & f["url"].isNull()), F.lit(0)), "files": F.when(F.col("legacy").isNotNull(), F.concat("files", F.array(last))).otherwise(F.col("files"))})
    kind = F.lower(F.trim(F.coalesce(F.try_variant_get(both("type"), "$", "string"), F.lit(o.default_run_type))))
    errors = [
        (F.col(text).isNull(), F.lit("missing 'input'")),
        (F.col("outer").isNull(), F.lit("'input' is not valid JSON")),
        (F.coalesce(kind_of(F.col("outer")), F.lit("VOID")) != "OBJECT", F.lit("'input' must be a JSON object")),
        (F.col("bad_inner"), F.lit("'input.input' is not valid JSON")),
        (F.col("odd"), F.lit("a file must be an object or a string")),
        (F.col("hollow").isNotNull(), F.concat(F.coalesce("hollow.name", F.concat(F.lit("file #"), F.col("hollow.index").cast("string"))), F.lit(" has no content"))),
        (F.size("files") > o.max_files, F.concat(F.lit("too many files: "), F.size("files").cast("string"))),
        (~kind.isin(*lx.RUN_TYPES), F.concat(F.lit("unsupported type: "), kind)),
        (text_of(both("text")).isNull() & (F.size("files") == 0), F.lit("nothing to process: send text or a file")),
    ]
    error = reduce(lambda out, e: F.when(e[0], e[1]).otherwise(out), reversed(errors), F.lit(None).cast("string"))
    return x.select(key, F.try_variant_get(both("run_id"), "$", "string").alias("run_id"), kind.alias("type"), text_of(both("text")).alias("text"), "files", error.alias("error"))


def safe_suffix(name: Column) -> Column:
    """A lower-case extension of one to six letters or digits."""
    return F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"[^/.](\.[a-z0-9]{1,6})$", 1)


def decode_base64(data: Column) -> Column:
    """Strict, then URL-safe; a data: header and white space don't matter; null if it cannot be read."""
    s = F.regexp_replace(F.regexp_replace(F.trim(data), r"(?s)^data:[^,]*,", ""), r"\s+", "")
    padded = F.concat(s, F.repeat(F.lit("="), F.pmod(-F.length(s), F.lit(4)).cast("int")))
    return F.coalesce(F.try_to_binary(padded, F.lit("base64")), F.try_to_binary(F.translate(padded, "-_", "+/"), F.lit("base64")))


def header_type(data: Column) -> Column:
    """The MIME type in a data: header."""
    return F.nullif(F.regexp_extract(data, r"^\s*data:([^;,]*)[;,]", 1), F.lit(""))


def materialize(requests: DataFrame, options: Options | None = None, key: str = "job", fetched: bool = False) -> DataFrame:
    """A10: a row for each file: its bytes, or the error that fails its request. An address is one, unless it will be fetched."""
    o = options or Options()
    x = requests.where("error is null").select(key, F.explode("files").alias("f")).select(key, "f.*")
    x = x.withColumns({"content": F.when(F.col("data").isNotNull(), decode_base64(F.col("data"))), "mime_type": F.coalesce("mime_type", header_type(F.col("data"))), "suffix": safe_suffix(F.col("name"))})
    size = F.length("content")
    error = F.when(F.col("data").isNotNull() & F.col("content").isNull(), "'data' is not valid base64").when(F.col("data").isNull() & (F.lit(not fetched) | F.col("url").isNull()), "download failed: no fetcher is set").when(size > o.max_file_bytes, "the file is too large").when(size == 0, "the file is empty")
    return x.select(key, F.col("index").alias("file_index"), "name", "mime_type", "suffix", "url", "content", error.alias("error"))
