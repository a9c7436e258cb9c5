import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from fieldspan.llm import lm
from fieldspan.llm.lm import EliasFano, build, op5_lm, score_texts

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n,bound", [(0, 5), (1, 1), (50, 7), (1000, 10**6), (5000, 1 << 62), (3000, 3100)])
def test_elias_fano_round_trip_and_successor(n, bound):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, bound, n).astype(np.uint64))
    ef = EliasFano.build(v, bound)
    assert (ef.get(np.arange(n)) == v).all()
    x = np.concatenate([v, rng.integers(0, bound, 500).astype(np.uint64)])
    at, hit = ef.find(x)
    want = np.searchsorted(v, x)
    assert (at == want).all()
    assert (hit == np.array([i < n and v[i] == q for i, q in zip(want, x, strict=True)])).all()


def test_trie_gives_discounted_probabilities():
    context = np.array([4, 4, 4, 10, 11, 11], np.uint64)
    word = np.array([1, 7, 7, 2, 1, 9], np.uint64)
    trie, total = build(context, word, np.array([1, 2, 3, 1, 4, 1]))
    assert total.tolist() == [6, 1, 5]
    at, hit = trie.find_context(np.array([4, 5, 10, 11, 99], np.uint64))
    assert hit.tolist() == [True, False, True, True, False]
    place, seen = trie.find(at[[0, 0, 0, 2, 3]], np.array([1, 2, 7, 1, 9], np.uint64))
    assert seen.tolist() == [True, False, True, False, True]
    p = 10 ** trie.log_prob(place[seen])
    assert np.allclose(p, [0.1 / 6, 3.4 / 6, 0.1 / 5], rtol=0.006) and (p <= np.array([0.1 / 6, 3.4 / 6, 0.1 / 5]) + 1e-12).all()
    assert np.allclose(10 ** trie.log_keep(at[[0, 2, 3]]), [2.5 / 6, 0.9, 2.5 / 5], rtol=0.006)
    trie.close()


def brute(rows, hot_of):
    """rows (doc_id, text); hot_of(tokens of all texts) gives the hot words."""
    def words(t):
        out = (t or "").encode().lower().split()
        return [*out, None]

    docs = [(i, words(t), zlib.crc32(str("" if i is None else i).encode()) % 10 != 0) for i, t in rows]
    hot = hot_of(Counter(w for _, ws, _ in docs for w in ws if w is not None), sum(len(ws) for _, ws, _ in docs))

    def pairs(ws):
        for i in range(1, len(ws)):
            h = ws[max(0, i - 1):i]
            for k in (2, 3):
                if h[0] in hot and len(h) == k - 1:
                    h = ws[max(0, i - k):i] if i - k >= 0 else ["<s>"] + ws[:i]
            yield tuple(h), ws[i]

    c1, c2, ch = Counter(), Counter(), Counter()
    for _, ws, train in docs:
        if train:
            c1.update(ws)
            for h, w in pairs(ws):
                c2[h, w] += 1
                ch[h] += 1
    n, v = sum(c1.values()), len(c1)
    lost = Counter()
    for (h, _), c in c2.items():
        lost[h] += lm.DISCOUNTS[min(c, 3) - 1]
    uni = lambda w: math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1)))
    down = lambda p: -math.ceil(-math.log10(p) * lm.STEPS - 1e-9) / lm.STEPS
    out = []
    for i, ws, train in docs:
        score = uni(ws[0])
        for h, w in pairs(ws):
            c = c2[h, w]
            if c:
                score += down((c - lm.DISCOUNTS[min(c, 3) - 1]) / ch[h])
            else:
                score += (down(min(1, lost[h] / ch[h])) if ch[h] else 0) + uni(w)
        out.append((i, not train, len(ws), sum(c1[w] > 0 for w in ws), n, sum(map(uni, ws)), score))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-10) and g[6] == pytest.approx(w[6], rel=1e-10)


COLS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize("share", [1, 50])
def test_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(lm, "HOT", share)
    monkeypatch.setattr(lm, "SHARD_ROWS", 300)
    rng = random.Random(share)
    vocab = [f"w{i}" for i in range(60)] + ["The", "the", "É", "x\x1cy"]
    rows = [(i, " \n".join(rng.choices(vocab, [1] * 60 + [40, 30, 20, 5], k=rng.randrange(0, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "only"), (202, "only"), (None, "the the the the w1"), (203, "\t the w5 w6  THE"), (10, "the the the the the the")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, train string, score double")
    hot_of = lambda c, n: {w for w, k in c.items() if k >= max(2, n // lm.LOCAL) and k * share >= n}
    same(score_texts(df.coalesce(1)).select(*COLS).collect(), brute(rows, hot_of))
    assert score_texts(df.limit(0)).count() == 0


def test_long_texts_in_parts(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 50) for i in range(3000))
    whole = lm.token_hashes([b"a b", text, b"", b"c"])
    monkeypatch.setattr(lm, "CHUNK", 100)
    parts = lm.token_hashes([b"a b", text, b"", b"c"])
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist() == [2, 3000, 0, 1]


def test_query_over_all_documents(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    got = op5_lm(spark, SF).select(*COLS).collect()
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))

    def hot_of(c, n):
        return {w for w, k in c.items() if k >= max(2, n // lm.LOCAL) and k * lm.HOT >= n}

    same(got, brute(rows, hot_of))
    held = [r for r in got if r.held_out]
    print("held-out log10 per token: base", sum(r.base_score for r in held) / sum(r.n_tokens for r in held), "model", sum(r.score for r in held) / sum(r.n_tokens for r in held))
