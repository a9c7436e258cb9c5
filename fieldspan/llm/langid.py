"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1. A letter n-gram is the product of its letters' vectors, each
rotated by its place; a text is the sum of its n-grams; a language prototype is the sum of its texts
scaled to unit length. A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, table

DIM, GRAM, SEED = 2048, 3, 97
#: Learning rows of each language, at most about so many, drawn by a hash of the id.
FIT_ROWS = 1500
#: Code points of one text, or of several together, that are worked on at once.
CHUNK = 1 << 18

_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Code point -> the same, 32 if it is no letter, with lower case applied where it is one code point."""
    global _letters
    if _letters is None:
        t = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters = t
    return _letters


def letter_vector(c: int) -> np.ndarray:
    v = _vectors.get(c)
    if v is None:
        if len(_vectors) > 20_000:
            _vectors.clear()
        v = _vectors[c] = (np.random.default_rng([SEED, c]).integers(0, 2, DIM, np.int8) * 2 - 1).astype(np.int8)
    return v


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams of the whole text (21 bits a letter) and their counts; words end in a space."""
    codes, counts = [], []
    for at in range(0, len(text), CHUNK):  # neighbouring parts share GRAM - 1 letters
        part = text[max(0, at - GRAM + 1):at + CHUNK]
        a = letter_table()[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]
        if at == 0:
            a = np.concatenate([np.array([32], np.uint32), a])
        if at + CHUNK >= len(text):
            a = np.append(a, np.uint32(32))
        space = a == 32
        a = a[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint64)
        if len(a) < GRAM:
            continue
        code = np.zeros(len(a) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            code = (code << np.uint64(21)) | a[k:len(a) - GRAM + 1 + k]
        u, n = np.unique(code, return_counts=True)
        codes.append(u)
        counts.append(n)
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    u, inv = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(inv, np.concatenate(counts)).astype(np.int64)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of +-1 for each n-gram."""
    out = np.ones((len(codes), DIM), np.int8)
    for k in range(GRAM):
        letters, inv = np.unique((codes >> np.uint64(21 * (GRAM - 1 - k))) & np.uint64((1 << 21) - 1), return_inverse=True)
        rolled = np.stack([np.roll(letter_vector(int(c)), GRAM - 1 - k) for c in letters])
        out *= rolled[inv]
    return out


def text_vectors(texts: list[str]) -> np.ndarray:
    """Sums of the n-gram vectors of each text; no letter gives zeros."""
    out = np.zeros((len(texts), DIM), np.float32)
    at = 0
    while at < len(texts):  # a group of texts shares the vectors of its n-grams
        group, size = [], 0
        while at + len(group) < len(texts) and len(group) < 128 and (not group or size + len(texts[at + len(group)]) <= CHUNK):
            size += len(texts[at + len(group)])
            group.append(texts[at + len(group)])
        found = [grams(t) for t in group]
        u, inv = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        row = np.repeat(np.arange(len(group)), [len(c) for c, _ in found])
        n = np.concatenate([n for _, n in found])
        for s in range(0, len(u), 8192):
            inside = (inv >= s) & (inv < s + 8192)
            m = np.zeros((len(group), min(8192, len(u) - s)), np.float32)
            m[row[inside], inv[inside] - s] = n[inside]
            out[at:at + len(group)] += m @ gram_vectors(u[s:s + 8192]).astype(np.float32)
        at += len(group)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def learn(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes. docs is a bounded sample; each of four tasks sends one vector a language."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0), b.column(1)
            for at in range(0, len(texts), 128):
                t, names = texts.slice(at, 128).to_pylist(), langs.slice(at, 128).to_pylist()
                for name, v in zip(names, _unit(text_vectors(t)), strict=True):
                    sums[name] = sums[name] + v if name in sums else v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())],
                                         names=["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for r in docs.select(text_col, lang_col).mapInArrow(run, "lang string, v binary").collect():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.v, "<f8")
    names = sorted(total)
    return names, _unit(np.stack([total[k] for k in names])) if names else np.zeros((0, DIM))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: id_col, held_out, lang_pred, score (the best cosine, 0 to 1).

    Prototypes come from rows with a language and a text with letters whose crc32(id) mod 4 is not 2, at
    most about fit_rows of each language. A null text, one without a letter, and any text when nothing
    could be learnt get `und` and 0. Repeated rows are judged alike; a null id counts as the empty text in
    the fold; very long texts are read whole, part by part; an empty table gives no rows; other columns
    are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
                       (crc_mod(id_col, 4) == 2).alias("held_out"))
    usable = base.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if counts:
        share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, fit_rows / n)))])
        draw = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(5)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
        sample = cut(usable.where(draw).select("text", "lang").repartition(8), "lang_sample")
        names, protos = learn(sample.where(F.col("text").rlike(r"\p{L}")).coalesce(4), "text", "lang")
    else:
        names, protos = [], np.zeros((0, DIM))
    protos = protos.astype(np.float32)

    def run(batches):
        for b in batches:
            texts = b.column(2)
            for at in range(0, len(texts), 128):
                t = texts.slice(at, 128).to_pylist()
                ok = np.array([has_letter(x) for x in t]) & bool(names)
                pred, score = np.full(len(t), "und", object), np.zeros(len(t))
                if ok.any():
                    cos = _unit(text_vectors([x for x, k in zip(t, ok, strict=True) if k])) @ protos.T
                    best = cos.argmax(1)
                    pred[ok] = np.array(names, object)[best]
                    score[ok] = np.clip(cos[np.arange(len(best)), best], 0, 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 128), b.column(1).slice(at, 128), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                                 names=["id", "held_out", "lang_pred", "score"])

    kind = base.schema["id"].dataType.simpleString()
    return base.select("id", "held_out", "text").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"op4_langid": op4_langid}
ORACLE: dict[str, str] = {}
