"""Quality classifier: importance resampling with hashed n-gram generative models and Gumbel top-k.

Unigrams and bigrams fall into ``BUCKETS`` hash buckets each. The raw model counts them over all documents, the target model
over a bounded sample of documents labelled as good (``max_target``); both are add-one smoothed. A document's log importance
weight is the sum of the log ratios of its n-grams; adding Gumbel noise and keeping the ``fraction`` largest keys samples
without replacement in proportion to the weights. The noise is a hash of the id, so any partitioning gives the same result.
The k-th key is found exactly by narrowing histograms; rows tied with it are kept.

Defined cases: null and empty texts have weight 0; without labelled rows the target equals the raw model and the choice is
random; an empty table gives an empty result; repeated rows are weighed row by row; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, hash_sample, map_rows, read_table, write_table

WORD = re.compile(r"[^\W_]+|[^\w\s]")
BUCKETS = 8192
FRACTION = 0.8
SEED = 17
REMEMBERED = 500_000
BINS, FEW = 4096, 4000


class Hasher(dict):
    """Words to hashes, remembered."""

    def __missing__(self, w: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[w] = zlib.crc32(w.encode())
        return h

    def buckets(self, text: str | None) -> np.ndarray:
        """Buckets of the text's unigrams, then of its bigrams (from BUCKETS on)."""
        h = np.array(list(map(self.__getitem__, WORD.findall((text or "").lower()))), dtype=np.uint64)
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        return np.concatenate([h % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS) + np.uint64(BUCKETS)]).astype(np.int64)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over all texts (column text); each task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(2 * BUCKETS, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for t in batch.slice(k, SLICE).column(0).to_pylist():
                    total += np.bincount(hasher.buckets(t), minlength=2 * BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(2 * BUCKETS, dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    def log_p(n: np.ndarray) -> np.ndarray:
        return np.concatenate([np.log((n[a : a + BUCKETS] + 1) / (n[a : a + BUCKETS].sum() + BUCKETS)) for a in (0, BUCKETS)])

    return log_p(target) - log_p(raw)


def target_sample(docs: DataFrame, labels: DataFrame, max_target: int) -> DataFrame:
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    ids = [r["doc_id"] for r in hash_sample(good, "doc_id", max_target, good.count()).collect()]
    return docs.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id", "left_semi")


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of column key (no nulls), by histograms of ever narrower ranges."""
    r = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    x = keys
    while True:
        if lo == hi:
            return lo
        width = (hi - lo) / BINS
        bin_ = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1))
        rows = x.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("b")).collect()
        for row in rows:
            if k <= row["n"]:
                break
            k -= row["n"]
        if row["n"] <= FEW:
            return sorted((v["key"] for v in x.where(F.col("key").between(row["lo"], row["hi"])).collect()), reverse=True)[k - 1]
        lo, hi = row["lo"], row["hi"]
        x = keys.where(F.col("key").between(lo, hi))


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, seed: int = SEED, max_target: int = 4000) -> DataFrame:
    """doc_id, log_ratio, key and kept of each row; kept marks the ceil(fraction * rows) largest keys."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw, target = gram_counts(x), gram_counts(target_sample(x, labels, max_target))
    sent = docs.sparkSession.sparkContext.broadcast(log_ratios(target if target.sum() else raw, raw))

    def make():
        hasher, ratio = Hasher(), sent.value
        return lambda ids, texts: [ids, [float(ratio[hasher.buckets(t)].sum()) for t in texts]]

    scored = map_rows(x, make, "doc_id long, log_ratio double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = write_table(scored.withColumn("key", F.col("log_ratio") - F.log(-F.log(u))), "weights")
    n = keyed.count()
    return keyed.withColumn("kept", F.col("key") >= (kth_largest(keyed.select("key"), math.ceil(fraction * n)) if n else 0.0))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
