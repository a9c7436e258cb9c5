"""Exact top-k search by inner product over integer vectors with multi-resolution segment bounds.

For a segment of length l with means m and deviations s,  sum (q - x)^2 >= l ((mq - mx)^2 + (sq - sx)^2);
with the norms known this bounds the inner product by  sum over segments of l (mq mx + sq sx).
Levels of 1, 2, 4, ... segments are tried coarse to fine; exact products are computed for survivors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of a block of queries and of a block of candidates, on average.
BLOCK = 8192
#: Queries that go through the levels together.
STRIP = 64
#: Pairs whose exact products are computed at once.
PAIRS = 1 << 16


def whole_vector(c: str) -> Column:
    """The vector is there and has no null and no non-finite component."""
    return F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))


def matrix(arrays: pa.ChunkedArray) -> np.ndarray:
    """floor(256 x) of every component, as doubles; shorter vectors are filled up with 0."""
    arr = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    n = arr.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = np.floor(256.0 * flat)
    return out


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs; results beyond a long stay at its ends."""
    d = q.shape[1]
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(d, 1) < 2**53:
        step = max(1, PAIRS * 64 // max(d, 1))
        return np.concatenate([np.zeros(0, np.int64)] + [
            np.rint(np.einsum("ij,ij->i", q[qi[i:i + step]], x[xi[i:i + step]])).astype(np.int64) for i in range(0, len(qi), step)])
    ends = np.iinfo(np.int64)
    return np.array([min(ends.max, max(ends.min, sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True))))
                     for i, j in zip(qi, xi, strict=True)], np.int64)


def _exact_all(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs, where doubles hold them: cheaper for many survivors of a strip."""
    return np.rint(q @ x.T).astype(np.int64)


def segments(v: np.ndarray, parts: int) -> np.ndarray:
    """sqrt(l) times the means and deviations of `parts` segments side by side."""
    d = v.shape[1]
    edges = np.linspace(0, d, parts + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(v, edges[:-1], axis=1) / length
    var = np.add.reduceat((v - np.repeat(mean, length, axis=1)) ** 2, edges[:-1], axis=1) / length
    return np.hstack([mean * np.sqrt(length), np.sqrt(var * length)])


def search(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, xkey: np.ndarray, k: int):
    """(query row, candidate row, score) of the k best of each query; qid and xid tell a query's own row.

    A strip of queries goes through the levels while its matrix of bounds stays in the cache. The k
    candidates with the best bounds give exact scores, the k-th of them a floor for what can be among
    the k best; pairs whose bound is below the floor are gone.
    """
    d = max(q.shape[1], x.shape[1])
    q, x = (np.pad(v, ((0, 0), (0, d - v.shape[1]))) for v in (q, x))
    k_here = min(k, len(x))
    levels = [1 << i for i in range(max(0, d - 1).bit_length())] if k_here else []
    seg_q, seg_x = ([segments(v, n).astype(np.float32) for n in levels] for v in (q, x))
    # the bounds are sums in single precision: this is far above their rounding errors
    slack = 1e-5 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0) + 1e-3
    small = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(d, 1) < 2**53
    found = []
    for s in range(0, len(q), STRIP):
        rows = np.arange(s, min(s + STRIP, len(q)))
        alive = qid[rows, None] != xid[None, :]
        floor = np.full(len(rows), -np.inf)
        for level, (sq, sx) in enumerate(zip(seg_q, seg_x, strict=True)):
            bound = sq[rows] @ sx.T
            bound[~alive] = -np.inf
            if level in (0, len(levels) // 2, len(levels) - 1) and k_here == k:
                best = np.argpartition(bound, bound.shape[1] - k, axis=1)[:, -k:]
                score = _exact(q, x, np.repeat(rows, k), best.ravel()).astype(float).reshape(best.shape)
                score[~np.take_along_axis(alive, best, 1)] = -np.inf
                floor = np.maximum(floor, score.min(1))
            alive &= bound >= (floor - slack[rows]).astype(np.float32)[:, None]
            if np.count_nonzero(alive) <= 2 * k * len(rows):
                break
        qi, xi = np.nonzero(alive)
        score = _exact_all(q[rows], x)[qi, xi] if len(qi) * 16 > alive.size and small else _exact(q, x, rows[qi], xi)
        good = score >= floor[qi]
        found.append((rows[qi[good]], xi[good], score[good]))
    qi, xi, score = (np.concatenate(p) for p in zip(*found, strict=True))
    order = np.lexsort((xkey[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(q)))[qi] < k
    return qi[keep], xi[keep], score[keep]


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` its k best others.

    Ties go to the smaller id (null ids last). Vectors that are null or hold a null or non-finite
    component take no part; shorter vectors count as filled up with 0. Rows are rows: repeated ones are
    queries and candidates of their own, and only the query's own row is left out. Fewer than k others:
    all of them; an empty table gives no rows; other columns are not read.

    Queries and candidates are dealt into blocks by a hash; each pair of a query block and a candidate
    block is one group, so no task holds more than two blocks, whatever the input.
    """
    rows = cut(vectors.where(whole_vector(vec_col)).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"),
                                           F.col(vec_col).cast("array<double>").alias("x")), "vectors")
    queries = rows.where(F.col("id") % every == 0)
    n, m = rows.count(), queries.count()
    groups, blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(m / BLOCK))
    cand = rows.withColumn("c", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ask = queries.withColumn("q", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    schema = pa.schema([("qrid", pa.int64()), ("query_id", pa.int64()), ("vrid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        qrid, vrid = a["rid"].to_numpy(), b["rid"].to_numpy()
        vid = b["id"].combine_chunks() if isinstance(b["id"], pa.ChunkedArray) else b["id"]
        key = vid.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        qi, xi, s = search(matrix(a["x"]), qrid, matrix(b["x"]), vrid, key, k)
        return pa.Table.from_arrays([pa.array(qrid[qi]), a["id"].take(pa.array(qi)).combine_chunks().cast(pa.int64()), pa.array(vrid[xi]),
                                     vid.take(pa.array(xi)).cast(pa.int64()), pa.array(s)], schema=schema)

    found = ask.groupBy("q", "c").cogroup(cand.groupBy("q", "c")).applyInArrow(
        block, "qrid long, query_id long, vrid long, vec_id long, score long")
    order = Window.partitionBy("qrid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vrid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP10_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op10_topk": op10_topk}
ORACLE = {"op10_topk": OP10_SQL}
