import duckdb
import pytest
from pyspark.sql import functions as F

from fieldspan.llm.mixing import OP7_SQL, mix, op7_mixing, training_order

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        room = left - sum(cap * sizes[s] for s in full)
        t = {s: w[s] * room / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else t[s] for s in names}
        full |= over


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = "doc_id, size, source_size, target, taken, position"
    want = sorted(con.execute(f"select {cols} from ({OP7_SQL})").fetchall())
    got = sorted(map(tuple, op7_mixing(spark, SF).select(*cols.split(", ")).collect()))
    assert len(got) == len(want) == 1000
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[4] == w[4] and g[3] == pytest.approx(w[3], rel=1e-12) and g[5] == w[5]


def test_targets_and_order(spark):
    rows = [(i, "w " * (i % 40), ["a", "b", "c", None, "é"][min(4, i // 3 % 9)], 1) for i in range(400)] + [(7, None, "b", 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    out = mix(df).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.5
    order = training_order(df)
    assert order.agg(F.sum("words")).first()[0] == sum(taken.values())
    pos = [r.position for r in order.collect()]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    assert mix(df.limit(0)).count() == 0
    assert [r.taken for r in mix(df.where("text is null")).collect()] == [0, 0]


def test_query_and_operator_are_sorted_by_position(spark):
    by = lambda p: (p is None, p or 0)
    df = spark.createDataFrame([(i % 90, "w " * (i % 7), "ab"[i % 2]) for i in range(300)] + [(None, None, None)], "doc_id long, text string, source string")
    for out, n in ((mix(df), 301), (op7_mixing(spark, SF), 1000)):
        places = [r.position for r in out.collect()]  # partitions in their order, as files are read
        assert len(places) == n and places == sorted(places, key=by)
        assert None in places and len(set(places)) > n / 4
