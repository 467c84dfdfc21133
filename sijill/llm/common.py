"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set a local master gets a temporary folder (tests); on a cluster that is an error, since executors would
    write to their own disks and what is read back would be incomplete.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sijill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = "file://" + path
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns it read back: its lineage is cut, lost executors cost nothing done before."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch at most: texts and sets are large, and a batch is held whole on both sides of the pipe.
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS rows, unless they are smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, key: str, bound: int, rows: int) -> DataFrame:
    """About ``bound`` of ``rows`` rows (all, if they are fewer), chosen by a hash of ``key``: the same ones on any partitioning."""
    if rows <= bound:
        return df
    steps = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(steps)) < int(steps * bound / rows))


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), but evaluated once above df's columns: pushed down, it would repeat the expressions it names."""
    return df.withColumn("_late", F.rand(0)).where(condition & (F.col("_late") >= 0)).drop("_late")


#: Bits of a Sieve: a bound on what it sends, whatever it holds.
SIEVE = 1 << 23


class Sieve:
    """A set of longs as a bitmap of fixed size: what it lets through may be among them, what it holds back is not.

    So rows that cannot meet a large table need no shuffle; the others are joined exactly. The bitmap is a table of at most
    SIEVE / 64 words, which is why it may be broadcast.
    """

    def __init__(self, longs: DataFrame, column: str, bits: int = SIEVE):
        self.bits = bits
        key = F.col(column)
        words = longs.select(self._word(key).alias("_word"), F.expr(f"shiftleft(1L, CAST(pmod({column}, 64L) AS INT))").alias("bit"))
        self.words = write_table(words.groupBy("_word").agg(F.bit_or("bit").alias("_bits")), "sieve")

    def _word(self, key: Column) -> Column:
        return F.floor(F.pmod(key, F.lit(self.bits).cast("long")) / 64).cast("int")

    def marked(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with a boolean: may the column's value be in the set?"""
        key = F.col(column)
        x = df.join(F.broadcast(self.words), self._word(key) == F.col("_word"), "left")
        return x.withColumn(name, F.coalesce(F.getbit("_bits", F.pmod(key, F.lit(64).cast("long")).cast("int")) == 1, F.lit(False))).drop("_word", "_bits")


#: Rows that a Python function sees at once, whatever the size of the Arrow batch.
SLICE = 256


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list[list]]], schema: str) -> DataFrame:
    """Runs make() once in each task, and what it returns on lists of the columns, slice by slice; it returns lists of the new columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, out = make(), arrow_schema(schema)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                got = f(*(c.to_pylist() for c in batch.slice(k, SLICE).columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(got, out.types, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow's schema of 'name type, ...' with the types of ARROW."""
    return pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in schema.split(","))])


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
