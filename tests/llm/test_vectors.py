import duckdb
import numpy as np

from fieldspan.llm import embeddup, topk
from fieldspan.llm.topk import OP10_SQL, op10_topk, search, top_k

SF = "/root/testdata/sf0.01"


def test_top_k_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.execute(f"select query_id, rank, vec_id, score from ({OP10_SQL})").fetchall())
    got = sorted(map(tuple, op10_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == want and len(got) == 50


def test_search_prunes_but_loses_nothing():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((3000, 24)) * np.linspace(2, 0.1, 24))
    q = x[:40]
    qi, xi, s = search(q, np.arange(40), x, np.arange(3000), np.arange(3000), 5)
    full = (q @ x.T).astype(int)
    for r in range(40):
        order = sorted((-full[r, j], j) for j in range(3000) if j != r)[:5]
        assert [(-int(a), int(b)) for a, b in zip(s[qi == r], xi[qi == r], strict=True)] == order


def test_top_k_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    rows = [(0, [1.0, 0.5], "s"), (0, [1.0, 0.5], "s"), (1, [1.0, 0.5], "s"), (2, None, "s"), (3, [float("nan"), 1.0], "s"), (50, [2.0], "s"),
            (4, [None, 1.0], "s"), (None, [9.0, 9.0], "s"), (5, [], "s"), (6, [float("inf"), 0.0], "s"), (100, [-1.0, 4.0], "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r.rank, str(r.vec_id), r.score) for r in top_k(df, k=3).collect())
    ok = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    want = []
    for i, a in enumerate(ok):
        if a[0] is not None and a[0] % 50 == 0:
            v = [(int(sum(np.floor(256 * x) * np.floor(256 * y) for x, y in zip(a[1], b[1], strict=False))), b[0]) for j, b in enumerate(ok) if j != i]
            v.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0))
            want += [(a[0], n + 1, str(t[1]), t[0]) for n, t in enumerate(v[:3])]
    assert got == sorted(want)
    assert top_k(df.limit(0)).count() == 0


def brute(ids, x, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], label.max()).min(1))
        if (new == label).all():
            return hit.sum(1), label
        label = new


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "BLOCK", 150)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 32))
    near = np.vstack([base[i % 20] + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.35]) for i in range(500)])
    hot = base[0] + rng.standard_normal((400, 32)) * 0.1
    x = np.vstack([base, near, hot, base[:30], base[:30]])
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, n int")
    n, label = brute(ids, x)
    got = {r.vec_id: r for r in embeddup.near_duplicates(df).collect()}
    assert len(got) == len(x)
    assert sum(r.n_links for r in got.values()) >= 0.98 * n.sum()
    assert all(got[i].n_links <= m for i, m in zip(ids, n, strict=True))
    assert np.mean([got[i].component_id == c for i, c in zip(ids, label, strict=True)]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_query_equals_brute_force(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)
    n, label = brute(ids, x)
    got = {r.vec_id: r for r in embeddup.op6_embeddup(spark, SF).collect()}
    assert [got[i].n_links for i in ids] == n.tolist() and [got[i].component_id for i in ids] == label.tolist()


def test_odd_vectors(spark):
    rows = [(4, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [2.0, 4.0]), (9, [0.0, 0.0]), (8, None), (7, []), (6, [float("nan"), 1.0]),
            (5, [None, 1.0]), (3, [1.0]), (1, [1e300, 2e300]), (0, [-1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddup.near_duplicates(df).collect())
    assert got == [(0, 0, 0), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 3, 1), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9)]
    assert embeddup.near_duplicates(df.limit(0)).count() == 0
