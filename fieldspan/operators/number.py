"""Consecutive numbers for the rows of a table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_rows(df: DataFrame, order: str, *keys: str, name: str = "i", parts: int = 64) -> DataFrame:
    """df with name = 0, 1, 2 ... by key in the order of a column.

    Numeric columns are cut at quantiles (at most `parts` of them, exactness not needed) into ranges; counts
    of the ranges give each its first number, and rows are numbered inside their range. Columns of
    other types are numbered by a window over the key."""
    if not isinstance(df.schema[order].dataType, T.NumericType):
        w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(order)
        return df.withColumn(name, F.row_number().over(w) - 1)
    cuts = sorted(set(df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / parts for k in range(1, parts)], 0.005)))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() as array<double>)")
    value = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    rows = df.withColumn("_r", F.size(F.filter(bounds, lambda c: c < value)))
    sizes = rows.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    rows = rows.join(first, [*keys, "_r"])
    return rows.withColumn(name, F.col("_b") + F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(order)) - 1).drop("_r", "_b")
