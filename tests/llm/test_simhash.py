import random

import xxhash
from pyspark.sql import functions as F

from fieldspan.llm.simhash import fingerprint, links, masks, near_duplicates


def brute_fp(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def brute_classes(values, radius):
    of = {v: v for v in values}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    vs = sorted(values)
    for i, x in enumerate(vs):
        for y in vs[i + 1:]:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= radius:
                a, b = sorted((top(x), top(y)))
                of[b] = a
    return {v: top(v) for v in values}


def test_masks_cover_every_pair_of_bits():
    m = masks(2)
    assert len(m) == 7
    for i in range(64):
        for j in range(64):
            assert any(not k >> i & 1 and not k >> j & 1 for k in m)


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        for _ in range(5):
            t = " ".join(rng.choice("aé BcDe f \x1c").strip() + str(rng.randrange(30)) for _ in range(n))
            assert fingerprint(t.encode()) == brute_fp(t)
    assert fingerprint(None) == 0 and fingerprint(b" \t\n") == 0


def test_links_with_small_and_hot_buckets(spark):
    rng = random.Random(2)
    vals = {rng.getrandbits(64) - 2**63 for _ in range(50)}
    for seed in list(vals)[:4]:
        for _ in range(60):
            x = seed
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(63)
            vals.add(x)
    from fieldspan.llm.graph import components

    df = spark.createDataFrame([(v,) for v in vals], "fp long")
    for small in (2, 1000):
        got = {r.node: r.component for r in components(links(df, 2, small)).collect()}
        want = brute_classes(vals, 2)
        groups = {}
        for v, c in want.items():
            groups.setdefault(c, []).append(v)
        for v in vals:
            assert got.get(v, v) == min(groups[want[v]])


def test_documents_with_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base, "x"), (3, base, "x"), (3, base, "x"), (9, None, "x"), (8, "", "x"), (1, base.upper(), "x"),
            (None, "lonely words here", "x"), (20, "y " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component", F.lit(1))
    got = sorted(((r.doc_id, r.component) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 1), (3, 1), (3, 1), (1, 1), (9, 8), (8, 8), (None, None), (20, 20)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
