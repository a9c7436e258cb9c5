"""Embedding near-duplicates by collision-counting projections.

Vectors are dealt into blocks by the signs of a few projections, over as many tables as the wanted
recall needs; a pair that meets in a block is judged by how many of many one-dimensional projections
put one vector inside a window centred on the other. Pairs with a count at or above the calibrated one
are verified by cosine in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, table
from .graph import components
from .topk import whole_vector

#: Vectors of a block, about; larger blocks are compared chunk by chunk.
BLOCK = 2048
#: Counted projections, and the half width of a window in distances of a pair at the threshold.
PROJECTIONS, WIDTH = 24, 2.0
#: Wanted chance that a pair exactly at the threshold meets in a block, and that its count passes.
MEET, PASS = 0.99, 0.998


def calibrated(m: int = PROJECTIONS, width: float = WIDTH, wanted: float = PASS) -> int:
    """Least count of m collisions that a pair at the threshold reaches with the wanted chance."""
    p = math.erf(width / math.sqrt(2))
    tail = 0.0
    for c in range(m, -1, -1):
        tail += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if tail >= wanted:
            return c
    return 0


def shape(n: int, cosine: float, wanted: float = MEET) -> tuple[int, int]:
    """Sign bits of a block and number of tables for n vectors: blocks stay near BLOCK rows at any n."""
    bits = max(0, math.ceil(math.log2(max(1, n) / BLOCK)))
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if p >= 1 else math.ceil(math.log(1 - wanted) / math.log(1 - p))


def _unit(flat: np.ndarray, d: int) -> np.ndarray:
    v = flat.astype(np.float64).reshape(-1, d)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _directions(d: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((d, n))


def collide(a: np.ndarray, b: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit rows of a and b with cosine >= `cosine`; same: a is b, i < j only.

    Rows are sorted on the first projection; the queries of a strip see only the range of rows inside
    their windows there, and the other projections (in 256 steps, windows rounded outwards) add their
    collisions to the pairs of that range.
    """
    d = a.shape[1]
    dirs = _directions(d, PROJECTIONS, 7)
    w = WIDTH * math.sqrt(max(0.0, 2 - 2 * cosine))
    need = calibrated()
    step = 8.0 / 256
    reach = math.ceil(w / step) + 1
    pa_, pb = a @ dirs, b @ dirs
    oa, ob = np.argsort(pa_[:, 0], kind="stable"), np.argsort(pb[:, 0], kind="stable")
    ca, cb = (np.clip(np.floor((p[o] + 4.0) / step), 0, 255).astype(np.int16) for p, o in ((pa_, oa), (pb, ob)))
    key = pb[ob, 0]
    # the first projection is a window with room to spare: a miss there may cost one collision only
    wide = w * 2
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(oa), 128):
        rows = oa[s:s + 128]
        lo = np.searchsorted(key, pa_[rows[0], 0] - wide)
        hi = np.searchsorted(key, pa_[rows[-1], 0] + wide, side="right")
        if hi <= lo:
            continue
        count = np.zeros((len(rows), hi - lo), np.uint8)
        for m in range(PROJECTIONS):
            low = np.clip(ca[s:s + 128, m] - reach, 0, 255).astype(np.uint8)
            width = (np.clip(ca[s:s + 128, m] + reach, 0, 255) - low).astype(np.uint8)
            count += (cb[lo:hi, m].astype(np.uint8)[None, :] - low[:, None]) <= width[:, None]
        i, j = np.nonzero(count >= need)
        i, j = rows[i], ob[lo + j]
        if same:
            up = i < j
            i, j = i[up], j[up]
        for t in range(0, len(i), 1 << 18):
            x, y = i[t:t + (1 << 18)], j[t:t + (1 << 18)]
            ok = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
            found.append((x[ok], y[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id linked to each row within the group, by repeated minima."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per vector: id_col, n_links, component_id (least id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths never link. Equal vectors meet in one row first and link with each
    other; repeated rows count as vectors of their own; an empty table gives no rows; other columns are
    not read. Links are counted, not listed: a group of n near copies gives n rows from each block.
    """
    rows = cut(vectors.select(F.col(id_col).alias("id"), F.when(whole_vector(vec_col), F.col(vec_col)).alias("x")), "vectors")
    rows = rows.withColumn("x", F.when(F.exists("x", lambda v: v != 0), F.col("x")))
    uniq = cut(rows.where("x is not null").groupBy("x").agg(F.min("id").alias("least"), F.count("*").alias("n"))
               .withColumn("gid", F.monotonically_increasing_id()), "uniq_vectors")
    total = uniq.count()
    bits, tables = shape(total, cosine)

    def deal(batches):
        for b in batches:
            x = b.column(2)
            lens = x.value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((len(lens), tables), np.int32)
            for d in np.unique(lens):
                at = np.flatnonzero(lens == d)
                u = _unit(x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), int(d))
                if bits:
                    sign = (u @ _directions(int(d), tables * bits, 11) > 0).reshape(len(at), tables, bits)
                    out[at] = (sign << np.arange(bits)).sum(2)
            blocks = pa.ListArray.from_arrays(pa.array(np.arange(len(lens) + 1, dtype=np.int32) * tables), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, blocks], names=["gid", "n", "x", "blocks"])

    kind = uniq.schema["x"].dataType.simpleString()
    dealt = cut(uniq.select("gid", "n", "x").mapInArrow(deal, f"gid long, n long, x {kind}, blocks array<int>"), "dealt")
    keyed = dealt.select("gid", "n", "x", "blocks", F.size("x").alias("d"), F.posexplode("blocks").alias("t", "block"))
    sizes = cut(keyed.groupBy("d", "t", "block").agg(F.ceil(F.count("*") / F.lit(2 * BLOCK)).cast("int").alias("chunks")), "blocks")
    placed = keyed.join(maybe_broadcast(sizes), ["d", "t", "block"]).withColumn(
        "mine", F.pmod(F.xxhash64("gid"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumns(
        {"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    schema = pa.schema([("gid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def count(g: pa.Table) -> pa.Table:
        t, lo, hi, d = (g[c][0].as_py() for c in ("t", "lo", "hi", "d"))
        gid, n, mine = (g[c].to_numpy() for c in ("gid", "n", "mine"))
        x = _unit(g["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), d)
        blocks = g["blocks"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(gid), -1)
        if lo == hi:
            i, j = collide(x, x, cosine, True)
        else:
            ai, bi = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
            i, j = collide(x[ai], x[bi], cosine, False)
            i, j = ai[i], bi[j]
        if not len(i):
            return schema.empty_table()
        # a pair that met in an earlier table has been counted there
        new = np.ones(len(i), bool) if t == 0 else ~(blocks[i, :t] == blocks[j, :t]).any(1)
        links = np.zeros(len(gid), np.int64)
        np.add.at(links, i[new], n[j[new]])
        np.add.at(links, j[new], n[i[new]])
        roots = _roots(len(gid), i, j, gid)
        at = np.unique(np.concatenate([i, j]))
        return pa.Table.from_arrays([pa.array(v[at]) for v in (gid, links, roots)], schema=schema)

    met = cut(placed.select("d", "t", "block", "lo", "hi", "mine", "gid", "n", "x", "blocks")
              .groupBy("d", "t", "block", "lo", "hi").applyInArrow(count, "gid long, links long, root long"), "links")
    comp = components(met.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("gid").agg(F.sum("links").alias("links"))
    named = (uniq.select("x", "gid", "n", "least").join(links, "gid", "left")
             .join(comp.withColumnRenamed("node", "gid"), "gid", "left")
             .select("x", "least", F.coalesce("component", "gid").alias("c"),
                     (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    classes = cut(named.join(least, "c").select("x", "n_links", "component_id"), "vector_class")
    out = rows.join(classes, "x", "left")
    comp_id = F.when(F.col("x").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      comp_id.alias("component_id"), F.col("id").eqNullSafe(comp_id).alias("kept"))


def op6_embeddup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op6_embeddup": op6_embeddup}
ORACLE: dict[str, str] = {}
