"""From raw requests to results: intake, files, documents, candidates, grounding, output."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.functions import lexicon as lx
from sijill.operators import documents as docs_
from sijill.operators import records as rec
from sijill.operators.grounding import ground
from sijill.options import Options
from sijill.sources import candidates as cand
from sijill.sources import files as files_
from sijill.sources import plugins
from sijill.sources import requests as req
from sijill.storage import settle

RECORD = "struct<" + ",".join(f"{f}:{'int' if f == 'year' else 'bigint' if f == 'beneficiaries_count' else 'double' if f == 'budget' else 'string'}" for f in lx.FIELDS) + ">"


Fetcher = Callable[[str, int], tuple[bytes, str | None]]


def read_documents(requests: DataFrame, options: Options, fetcher: Fetcher | None = None) -> DataFrame:
    """doc_id, type, document, sources, warnings and error of each request (job). A bad upload fails its request, a bad file does not."""
    files = req.materialize(requests, options, fetched=fetcher is not None)
    if fetcher is not None:
        files = settle(plugins.fetch(files, fetcher, options), "files")
    bad = files.where("error is not null").groupBy("job").agg(F.min(F.struct("file_index", "error")).alias("e")).select("job", F.concat(F.lit("file #"), F.col("e.file_index").cast("string"), F.lit(": "), F.col("e.error")).alias("upload"))
    read = files_.extract_files(files.where("error is null").drop("error"), options).withColumnRenamed("job", "run_id")
    ok = requests.where("error is null").select(F.col("job").alias("run_id"), "text")
    d = docs_.assemble(ok, read.select("run_id", "file_index", "name", "kind", "method", "text", "warnings", "error")).withColumnRenamed("run_id", "job")
    x = requests.select("job", "type", "error").join(bad, "job", "left").join(d, "job", "left")
    error = F.coalesce("error", "upload", F.when(F.col("document").isNull(), F.concat(F.lit("no usable text: "), F.array_join("warnings", " | "))))
    return x.select(F.col("job").alias("doc_id"), "type", "document", "sources", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), error.alias("error"))


def run_model(documents: list[tuple[DataFrame, int, int]], source: cand.CandidateSource, options: Options) -> tuple[DataFrame, DataFrame]:
    """O1: (records, report): candidates of all chunks, cleaned, grounded, merged. documents come with the size of their chunks and the budget of an answer; all are grounded in one plan."""
    answers = []
    for own, chunk_chars, budget in documents:
        parts = docs_.chunks(own, chunk_chars)
        answers.append(source.generate(parts.join(parts.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id"), budget))
    said = settle(reduce(DataFrame.unionByName, answers), "answers")
    found = rec.clean_items(cand.items(said))
    if options.strict_grounding:
        found, _ = ground(found, reduce(DataFrame.unionByName, (d.select("doc_id", "document") for d, _, _ in documents)))
    return settle(rec.merge_records(found), "records"), settle(cand.chunk_report(said), "report")


def process(raw: DataFrame, source: cand.CandidateSource, options: Options | None = None, fetcher: Fetcher = plugins.download) -> DataFrame:
    """Job, result (JSON) and error of each raw envelope (job, raw); no envelope fails another."""
    o = options or Options()
    if o.enable_tools:
        plugins.install()
    requests = settle(req.normalize(raw, o), "requests")
    d = settle(read_documents(requests, o, fetcher if o.enable_download else None), "documents")
    good = d.where("error is null")

    texts = docs_.extract_text(good.where("type = 'extract_text'")).join(good.select("doc_id", "sources", "warnings"), "doc_id")
    text_out = texts.select("doc_id", F.to_json(F.struct("text", "chars", "sha256", "version", "sources", "warnings"), {"ignoreNullFields": "false"}).alias("result"), F.lit(None).cast("string").alias("failed"))

    kinds = {
        "program_extract": (o.max_input_chars, o.chunk_chars, o.max_new_tokens),
        "program_autofill": (o.autofill_max_input_chars, max(o.chunk_chars, o.autofill_max_input_chars), o.autofill_max_new_tokens),
    }
    asked = {kind: (settle(docs_.truncate(good.where(F.col("type") == kind), limit), kind), chunk, budget) for kind, (limit, chunk, budget) in kinds.items()}
    asked = {kind: x for kind, x in asked.items() if x[0].head(1)}
    done = text_out
    if asked:
        records, report = run_model(list(asked.values()), source, o)
        failed = F.when(F.col("all_failed"), F.concat(F.lit("all chunks failed: "), F.array_join("chunk_errors", "; ")))
        for kind, (mine, _, _) in asked.items():
            own = records.join(mine.select("doc_id"), "doc_id", "left_semi")
            if kind == "program_extract":
                one = F.struct("place", F.struct(*lx.FIELDS).cast(RECORD).alias("record"))
                listed = rec.order_records(own).groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("l"))
                x = mine.select("doc_id").join(listed, "doc_id", "left").join(report, "doc_id", "left")
                result = F.to_json(F.transform(F.coalesce("l", F.array().cast(f"array<struct<place:int,record:{RECORD}>>")), lambda s: s["record"]), {"ignoreNullFields": "false"})
            else:
                best = rec.autofill(own, mine.join(report, "doc_id", "left").select("doc_id", "warnings", F.coalesce("truncated", F.lit(False)).alias("truncated")))
                x = best.join(report, "doc_id", "left")
                result = F.to_json(F.struct(*lx.FIELDS).cast(RECORD), {"ignoreNullFields": "false"})
            done = done.unionByName(x.select("doc_id", F.when(failed.isNull(), result).alias("result"), failed.alias("failed")))
    return d.select(F.col("doc_id"), "error").join(done, "doc_id", "left").select(F.col("doc_id").alias("job"), "result", F.coalesce("error", "failed").alias("error"))
