from hashlib import md5

import pytest

from fieldspan.functions.draws import md5_heads
from fieldspan.operators import stats


@pytest.mark.parametrize("before", ["", "7:", "999:", "swap:12:", "swap:123:"])
def test_heads_are_those_of_md5(before):
    for start, stop in ((0, 21_000), (99_990, 100_020), (123_456_789, 123_456_799)):
        got = [(j + k, int(h)) for j, heads in md5_heads(before, start, stop) for k, h in enumerate(heads)]
        assert got == [(j, int(md5(f"{before}{j}".encode()).hexdigest()[:8], 16)) for j in range(start, stop)]


def test_resamples_without_a_row_for_each_draw(spark, monkeypatch):
    rows = [(s, d, d % 3, (d * 7) % 2, int(s == "b")) for s, n in (("a", 70), ("b", 50)) for d in range(n)]
    docs = spark.createDataFrame(rows[::-1], "approach string, doc_id long, tp long, fp long, fn long")
    want = []
    for s, n in (("a", 70), ("b", 50)):
        mine = [r[2:] for r in rows if r[0] == s]
        for b in range(9):
            want.append((s, b, *map(sum, zip(*(mine[int(md5(f"{b}:{j}".encode()).hexdigest()[:8], 16) % n] for j in range(n)), strict=True))))
    got = stats.resample(docs, ("tp", "fp", "fn"), 9, "approach")
    assert sorted(map(tuple, got.collect())) == want and "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(stats, "HELD", 16)
    assert sorted(map(tuple, stats.resample(docs, ("tp", "fp", "fn"), 9, "approach").collect())) == want
    monkeypatch.setattr(stats, "KINDS", 2)
    assert stats.resample(docs, ("tp", "fp", "fn"), 9, "approach") is None
