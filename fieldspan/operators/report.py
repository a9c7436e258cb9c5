"""From an extractor to the record of a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import score, stats


def run_approach(docs: DataFrame, extractor: Callable[[DataFrame], DataFrame], approach: str, text: str = "text", mode: str = "parity") -> tuple[DataFrame, DataFrame]:
    """(predictions, runs). extractor maps docs to rows with doc_id, fields and, where it can fail, error.

    A failed document has no fields. parity leaves it out of the runs, so it is not scored; fixed keeps
    it, so that its fields count as missed."""
    out = extractor(docs)
    if "error" not in out.columns:
        out = out.withColumn("error", F.lit(None).cast("string"))
    good = out.where("error is null")
    pred = good.select(F.lit(approach).alias("approach"), "doc_id", F.explode("fields").alias("field", "value"))
    return pred, (good if mode == "parity" else out).select(F.lit(approach).alias("approach"), "doc_id")


def summarise(out: DataFrame, resamples: int = 1000) -> DataFrame:
    """One row per approach: pooled scores, the interval of F1, scores by field and by slice as arrays."""
    ci = stats.bootstrap_ci(out, resamples).select("approach", F.struct("lo", "hi").alias("f1_ci95"))
    columns = ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy")
    fields = score.by_field(out).groupBy("approach").agg(F.array_sort(F.collect_list(F.struct("field", *columns))).alias("by_field"))  # 15 a row
    slices = score.slices(out).groupBy("approach").agg(F.array_sort(F.collect_list(F.struct("slice", "value", *columns, "hallucination_rate"))).alias("slices"))
    return score.overall(out).join(ci, "approach").join(fields, "approach").join(slices, "approach")
