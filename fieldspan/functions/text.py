"""Text functions as Columns; every regular expression is Unicode-aware where it must be."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def _fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters below U+2200 (and the fi/fl ligatures) that compatibility decomposition turns into
    other characters: single ones for translate(), longer ones for replace(); combining marks go."""
    one, to, many = [], [], []
    drop = [chr(c) for c in range(0x80, 0x2200) if unicodedata.combining(chr(c))]
    for c in [*range(0x80, 0x2200), 0xFB00, 0xFB01, 0xFB02]:
        ch = chr(c)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if plain != ch and len(plain) == 1:
            one.append(ch)
            to.append(plain)
        elif plain != ch and plain and c in (0xBC, 0xBD, 0xBE, 0x2026, 0x2122, 0xFB00, 0xFB01, 0xFB02):
            many.append((ch, plain))
    return "".join(one + drop), "".join(to), tuple(many)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: keeps expressions that use a value often from multiplying."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(c: Column) -> Column:
    """Accents and compatibility forms folded, in the JVM; other scripts: arrow.strip_accents. Text of as many
    bytes as characters has none and stays as it is."""
    src, dst, many = _fold_table()

    def of(v):
        out = F.translate(v, src, dst)
        for a, b in many:
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(F.octet_length(v) == F.length(v), v).otherwise(out)

    return let(c, of)


def squash(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column, chars: str | None = None) -> Column:
    """Strip the ends of white space, or of the given characters."""
    k = r"(?U)\s" if chars is None else "[" + "".join("\\" + x if not x.isalnum() and x != " " else x for x in chars) + "]"
    if chars is None:
        return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return F.regexp_replace(c, f"^{k}+|{k}+$", "")


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def compact(c: Column) -> Column:
    """Folded, lower-cased, letters a-z and digits alone."""
    return F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]", "")


def present(c: Column) -> Column:
    """Null and the empty text are absent."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def present_in(text: Column, value: Column) -> Column:
    """value stands in text, literally or with white space collapsed on both sides."""
    v, t = squash(value), F.regexp_replace(text, r"(?U)\s+", " ")
    return F.contains(text, value) | ((v != "") & F.contains(t, v))


def character_accuracy(reference: Column, hypothesis: Column) -> Column:
    """1 - distance / length of the reference, at least 0, white space collapsed."""
    def of(x):
        r, h = x["r"], x["h"]
        return F.when(r == "", F.when(h == "", 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(r, h) / F.length(r)))

    return let(F.struct(squash(reference).alias("r"), squash(hypothesis).alias("h")), of)
