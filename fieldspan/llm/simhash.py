"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits come from XXH64 (seed 42) of 3-word shingles. For radius r every bit
gets one of the 2^(r+1)-1 non-zero vectors of r+1 bits; table v keeps the bits whose vector has an
odd product with v. Any r bits leave some v orthogonal to all their vectors, so every pair within
the radius agrees on all kept bits of some table: nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .graph import components

BITS = 64
#: Hashes whose bits are unpacked at once, so that a very long text needs bounded memory.
CHUNK = 1 << 17


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one whole text; no words: 0."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i:i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), BITS).sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """Columns of id_col and fp (the fingerprint as signed long)."""
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def masks(radius: int = 2, bits: int = BITS) -> list[int]:
    """The 2^(r+1)-1 kept-bit masks; the vectors go round evenly, so each keeps about 4/7 of the bits."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((i % n + 1) & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = 2, small: int = 32) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, no repeats) that connect exactly
    what is connected by pairs of at most `radius` (1 or 2) differing bits.

    Small buckets compare their members directly. A bucket with more than `small` members is not
    paired off: its members meet at the values one bit away from them (two values within 2 bits
    share such a value, and values that share one are within 2 bits), at most 65 at each.
    """
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for t, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    full = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(rows.join(full, ["t", "key"]), "buckets")
    pairs = (met.where(F.col("n") <= small).groupBy("t", "key").agg(F.collect_list("fp").alias("m"))
             .select(F.explode(F.expr(
                 "flatten(transform(m, x -> transform(filter(m, y -> y > x and bit_count(x ^ y) <= "
                 f"{radius}), y -> struct(x as a, y as b))))")).alias("p")).select("p.*"))
    one = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    big = met.where(F.col("n") > small).select("fp").distinct()
    if radius == 2:
        stars = (big.select("fp", F.explode(one).alias("near")).groupBy("near")
                 .agg(F.collect_set("fp").alias("m")).where("size(m) > 1")
                 .select(F.array_min("m").alias("a"), F.explode("m").alias("b")))
    else:
        other = big.select(F.col("fp").alias("b"))
        stars = (big.select(F.col("fp").alias("a"), F.explode(one).alias("b")).join(other, "b"))
    return pairs.union(stars.select("a", "b").where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 2,
                    shingle: int = 3) -> DataFrame:
    """One row per document: id, fp, component (the smallest id reachable by links).

    Null and empty texts have fingerprint 0 and link like any other; rows with equal ids count as
    rows of one id; a null id never names a component unless all its members are null; other
    columns are not read; an empty table gives no rows. Copies meet in one fingerprint before any
    pair is formed, so a group of copies of any size costs one row.
    """
    fp = cut(fingerprints(docs, id_col, text_col, shingle), "fp")
    uniq = cut(fp.groupBy("fp").agg(F.min(id_col).alias("least")), "fp_uniq")
    comp = components(links(uniq.select("fp"), radius))
    named = uniq.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("first_id"))
    classes = cut(named.join(least, "component").select("fp", "first_id"), "fp_class")
    return fp.join(classes, "fp").select(id_col, "fp", F.col("first_id").alias("component"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


QUERIES = {"op9_simhash": op9_simhash}
ORACLE: dict[str, str] = {}
