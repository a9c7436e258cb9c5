"""Sinks: reports, error tables, silver sets, caches and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gold import upsert, upsert_report

ERROR_COLUMNS = ("approach", "doc_id", "field", "gold", "pred", "cause", "layout", "template_id", "condition", "lang", "doc_type")


def report(df: DataFrame, path: str, previous: DataFrame | None = None) -> DataFrame:
    """One JSON record an approach; approaches of a previous report that were not run again stay."""
    out = upsert_report(previous, df) if previous is not None else df
    out.write.mode("overwrite").json(path)
    return out


def errors_csv(df: DataFrame, path: str) -> None:
    df.select(*ERROR_COLUMNS).write.mode("overwrite").csv(path, header=True)


def silver_set(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").json(path)


def gold_set(reviewed: DataFrame, preserved: DataFrame, path: str) -> None:
    upsert(preserved, reviewed, "doc_id").write.mode("overwrite").json(path)


def cache(old: DataFrame, new: DataFrame, path: str) -> None:
    """A prediction cache as (doc_id, answer) rows."""
    upsert(old, new, "doc_id").write.mode("overwrite").parquet(path)


def batch_files(df: DataFrame, path: str) -> None:
    """One folder a batch; df has batch_id."""
    df.withColumn("batch_id", F.col("batch_id").cast("int")).write.mode("overwrite").partitionBy("batch_id").json(path)
