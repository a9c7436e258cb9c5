"""The few functions with no built-in: Arrow-batched pandas UDFs, to be applied to leftover rows."""

from __future__ import annotations

import difflib
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, for any script."""
    return s.map(_plain, na_action="ignore")


@F.pandas_udf(T.StringType())
def date_tail(s: pd.Series) -> pd.Series:
    """ISO date of shapes that the built-in normaliser does not know, read strictly."""
    from dateutil import parser

    def one(t):
        try:
            return parser.parse(t, dayfirst=False, fuzzy=False).date().isoformat()
        except Exception:  # noqa: BLE001  whatever cannot be read is no date
            return None

    return s.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two normalised texts, 0 where one is empty."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def with_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the matching-blocks ratio of two columns; a map over batches, so that no other expression is
    evaluated with it. Pairs seen lately are not compared again."""
    def run(batches):
        ratio = lru_cache(1 << 16)(lambda x, y: difflib.SequenceMatcher(None, x, y).ratio())
        for pdf in batches:
            yield pdf.assign(**{out: [ratio(x, y) if x and y else 0.0 for x, y in zip(pdf[a], pdf[b], strict=True)]})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
