"""Intake as a stream: raw envelopes from a folder of JSON lines, normalised without state, to any sink.

The work per envelope has no state, so any trigger gives the same rows as a batch over the same files; a checkpoint makes the
sink exactly-once for file sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sijill.options import Options
from sijill.sources import requests as req

SCHEMA = "job string, raw string"


def read_envelopes(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def normalized(spark: SparkSession, folder: str, options: Options | None = None) -> DataFrame:
    return req.normalize(read_envelopes(spark, folder), options)


def write_requests(stream: DataFrame, folder: str, checkpoint: str):
    """Runs to the end of what is there now, as parquet."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
