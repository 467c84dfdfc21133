"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and every
stage works on all rows that its predecessor kept. SQL cannot express the learned rules, the near copies or the tokenizer.

Defined cases: a null text is empty to every stage (the quality rules reject it); a null id takes part like any other; rows
that are equal in id and text are one document to the near-dedup stage, and rows of one id with different texts are different
documents; an empty table gives an empty result at every stage; without labels only the base rule rejects; other columns are
passed on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from sijill.llm.common import read_table, write_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays. Copies have a similarity of 0.8 or more over sets of five-word shingles, compared exactly; wide fingerprints only find whom to compare."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a test item go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked where they stand; every document stays, with n_chars counted anew."""
    return secret_scan.redact(docs, secret_scan.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", keep_good), ("simhash_near_dedup", keep_one_of_near_copies), ("decontamination", drop_leaks), ("secret_scan", mask_secrets), ("best_fit_packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written to the shared folder before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
