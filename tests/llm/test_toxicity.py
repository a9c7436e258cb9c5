import zlib

import numpy as np
import pyarrow.parquet as pq

from fieldspan.llm import toxicity as X
from fieldspan.llm.toxicity import classify, op1_toxicity

SF = "/root/testdata/sf0.1"


def test_pooling_equals_brute_force(monkeypatch):
    words, net = X.Words(), X.Net.fresh(3)
    texts = ["a b c d e f g", "", "x", None, "Été! " * 40, "p q"]
    rows = [words.rows(t) for t in texts]
    vec = net.vectors(np.array(words.triples))

    def brute(r):
        x = np.concatenate([vec[r], np.zeros((X.PAD, X.DIM))])
        out = []
        for w in X.WIDTHS:
            y = [sum(x[i + o] @ net.filt[w][o] for o in range(w)) for i in range(len(r))]
            out.append(np.max(y, axis=0) if y else np.full(X.FILTERS, -np.inf))
        return np.concatenate(out)

    want = np.stack([brute(r) for r in rows])
    assert np.allclose(net.pool(rows, vec), want, atol=1e-5)
    monkeypatch.setattr(X, "CHUNK", 7)  # long texts in overlapping parts give the same
    best, place = net.pool(rows, vec, where=True)
    assert np.allclose(best, want, atol=1e-5) and (place[4] < 40).all()


def test_held_out_quality(spark):
    lab = pq.read_table(f"{SF}/labels.parquet")
    y = dict(zip(lab["doc_id"].to_pylist(), lab["toxic"].to_pylist(), strict=True))
    got = op1_toxicity(spark, SF).collect()
    assert len(got) == 10000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got[:500])
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    hit = sum(p and t for p, t in held)
    print("held-out precision", hit / sum(p for p, _ in held), "recall", hit / sum(t for _, t in held))
    assert hit / sum(p for p, _ in held) > 0.85 and hit / sum(t for _, t in held) > 0.8


def test_odd_rows(spark):
    rows = [(i, ["you are vile scum", "the sun is out today"][i % 2] + f" w{i % 5}", "en", 0.5) for i in range(60)]
    rows += [(100, None, "en", 0.5), (101, "", None, 0.5), (None, "vile scum", "en", 0.5), (102, "q " * 60000, "xx", 0.5), (102, "vile", "xx", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame([(i, 1 - i % 2, 9) for i in range(60)] + [(7, None, 9), (None, 1, 9), (999, 1, 9)], "doc_id long, toxic int, score int")
    got = classify(df, lab, keep=("score",)).collect()
    assert len(got) == 65 and all(r.score == 0.5 for r in got)
    s = {r.doc_id: r.score_ for r in got if r.doc_id != 102}
    assert s[None] > 0.5 > s[1] and s[100] == s[101]
    assert [r.score_ for r in classify(df, lab.where("toxic = 0")).collect()] == [0.0] * 65
    assert [r.score_ for r in classify(df, lab.limit(0)).collect()] == [0.0] * 65
    assert classify(df.limit(0), lab).count() == 0


def test_thresholds():
    s, y = np.array([0.1, 0.2, 0.6, 0.9]), np.array([0, 0, 1, 1])
    assert X.best_threshold(s, y) == 0.3
    assert 0.6 < X.best_threshold(s, np.array([0, 0, 0, 1])) < 0.9
    assert X.best_threshold(s, np.zeros(4)) == 0.3
