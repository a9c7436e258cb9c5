"""Stateless extraction over a stream of document files (an extension: the measured system has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import extract
from ..sources.readers import DOCUMENT


def documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).option("multiLine", True).json(path)


def extract_to(spark: SparkSession, path: str, out: str, checkpoint: str):
    """A query that writes the fields of every document that has arrived, each file once, then ends."""
    rows = extract(documents(spark, path)).select("doc_id", "found_type", "fields")
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
