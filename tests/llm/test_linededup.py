import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from fieldspan.llm import linededup as D
from fieldspan.llm.common import cut, stored
from fieldspan.llm.linededup import banded, dedup_lines, line_hashes, normalised, op3_linededup, within

SF = "/root/testdata/sf0.01"


def norm(line):
    return b" ".join(re.findall(rb"[a-z0-9\x80-\xff]+", line.lower().encode())).decode("utf-8", "replace")


def lev(a, b):
    """Whole columns of the distance table as the bits of one number."""
    if not a:
        return len(b)
    at, full, top = {}, (1 << len(a)) - 1, 1 << (len(a) - 1)
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, d = full, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        v, h = same | minus, (((same & plus) + plus) ^ plus) | same
        p, m = (minus | ~(h | plus)) & full, plus & h
        d += bool(p & top) - bool(m & top)
        p, m = (p << 1 | 1) & full, (m << 1) & full
        plus, minus = (m | ~(v | p)) & full, p & v
    return d


def test_the_measure_itself():
    assert [lev("kitten", "sitting"), lev("", "abc"), lev("abc", ""), lev("flaw", "lawn"), lev("same", "same")] == [3, 3, 3, 2, 0]


def test_hashes_depend_on_normalised_words_alone():
    n, chars, k1, k2, sim, keys = line_hashes("the cat, sat\n\n  the--cat   sat!\nthe cat sad\n é \nsat cat the\n".encode())
    assert n.tolist() == [3, 0, 3, 3, 1, 3, 0] and chars.tolist() == [11, 0, 11, 11, 1, 11, 0]
    assert k1[0] == k1[2] and k2[0] == k2[2] and sim[0] == sim[2] and all(k[0] == k[2] for k in keys)
    assert len({int(x) for x in k1[[0, 3, 5]]}) == 3 and sim[0] == sim[5]
    again = line_hashes(b"zzz zz\nthe cat sat")
    assert again[2][1] == k1[0] and again[4][1] == sim[0] and all(a[1] == k[0] for a, k in zip(again[5], keys, strict=True))
    assert line_hashes(b"")[0].tolist() == [0]


def test_scripts_without_blanks_have_words():
    n, chars, *_ = line_hashes("東京都に住む人\nabc東京 def".encode())
    assert n.tolist() == [7, 4] and chars.tolist() == [7, 9]
    assert normalised("  東京都, Abc ") == "東京都 abc"


@pytest.mark.parametrize("m", [1, 31, 255, 256, 1000])
def test_simhash_equals_majority(m):
    r = np.random.default_rng(m)
    words = r.integers(0, 1 << 63, m + 3, np.uint64) * np.uint64(2) + r.integers(0, 2, m + 3).astype(np.uint64)
    got = D.simhash(words, np.array([3, m]))
    for line, have in zip((words[:3], words[3:]), got, strict=True):
        assert int(have) == sum(1 << i for i in range(64) if 2 * sum(int(w) >> i & 1 for w in line) > len(line))


def test_edit_distance_in_bands():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))
        b = "".join(c for c in a if rng.random() > 0.1) + "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
        d = lev(a, b)
        for k in (1, 5, 20, 80):
            got = banded(a, b, k)
            assert got == d if d <= k else got > k
        assert within(a, b, d) and (d == 0 or not within(a, b, d - 1))
    a = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    b = list(a)
    for i in sorted(rng.sample(range(6000), 500), reverse=True):
        b[i:i + 1] = rng.choice([[], ["x"], [b[i], "y"]])
    d = lev(a, "".join(b))
    assert banded(a, "".join(b), 600) == d and within(a, "".join(b), d) and not within(a, "".join(b), d - 1)


@pytest.mark.parametrize("words", [1, 2, 4, 8])
@pytest.mark.parametrize("letters", ["ab ", "abcdé", "aé東", "ab\U00020000"])
def test_distances_of_many_pairs_together(words, letters):
    rng, a, b = random.Random(words), [], []
    while len(a) < 150:
        x = [rng.choice(letters) for _ in range(rng.randrange(1, 60 * words))]
        y = [e for c in x for e in rng.choices(([c], [], [c, "z"], ["z"]), (9, 1, 1, 1))[0]] if rng.random() < 0.8 else [rng.choice(letters) for _ in x]
        if y and abs(len(x) - len(y)) < 32 * words:
            a.append("".join(x))
            b.append("".join(y))
    for x, y, got in zip(a, b, D.together(a, b, words), strict=True):
        d = lev(x, y)
        assert got == d if d < 32 * words else got >= 32 * words


def test_many_pairs_and_one_at_a_time_agree():
    rng, a, b = random.Random(8), [], []
    for size in (0, 1, 5, 40, 300, 700, 1500, 5000):
        for _ in range(40 if size < 2000 else 2):
            x = [rng.choice("abcdefgh ") for _ in range(size)]
            a.append("".join(x))
            b.append("".join(rng.choice("xyz") if rng.random() < rng.choice([0.05, 0.3]) else c for c in x)[rng.randrange(0, 3):])
    a, b = [*a, "nul\0 in it" * 5], [*b, "nul\0in it" * 5]
    most = [max(len(x), len(y)) // 5 for x, y in zip(a, b, strict=True)]
    assert D.alike(a, b, most).tolist() == [lev(x, y) <= k for x, y, k in zip(a, b, most, strict=True)]
    assert D.alike([], [], []).tolist() == []


def roots(n, links):
    of = list(range(n))

    def top(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in links:
        of[top(a)] = top(b)
    return [top(i) for i in range(n)]


def brute(docs, similarity=0.8, min_words=1):
    """docs: (id, text) in row order; the texts that stay when all pairs of lines are compared."""
    occ = [(d, i, j, norm(line)) for i, (d, t) in enumerate(docs) if t for j, line in enumerate(t.split("\n"))]
    occ = [o for o in occ if len(o[3].split()) >= min_words]
    texts = sorted({o[3] for o in occ}, key=lambda t: (len(t), t))
    place = {t: i for i, t in enumerate(texts)}
    links = near_pairs(texts, similarity)
    top = roots(len(texts), links)
    first = {}
    for o in sorted(occ, key=lambda o: (o[0] is not None, o[0] or 0, o[1], o[2])):
        first.setdefault(top[place[o[3]]], o[:3])
    gone = {(o[1], o[2]) for o in occ if first[top[place[o[3]]]] != o[:3]}
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, (_, t) in enumerate(docs)]


def check(got, docs):
    have = sorted((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in got)
    exp = sorted((d is not None, d or 0, t is not None, t or "") for (d, _), t in zip(docs, brute(docs), strict=True))
    assert have == exp


def test_equals_brute_force_on_a_fixture(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    base = [" ".join(word() for _ in range(rng.choice([2, 8, 25]))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base).split()
            if len(line) > 8 and rng.random() < 0.3:
                line[rng.randrange(len(line))] = word()
            lines.append(" ".join(line).capitalize() + rng.choice(["", ".", " !"]))
        docs.append((i, "\n".join(lines)))
    docs += [(70, None), (71, ""), (72, "one\n\none\n..."), (73, docs[0][1]), (73, docs[0][1]), (None, base[0] + "\n" + "q " * 300)]
    # names that the operator uses inside
    df = spark.createDataFrame([(*d, 1, "z", 5, "w") for d in docs], "doc_id long, text string, rid int, id string, n_lines int, kept string").coalesce(1)
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "rid", "id", "kept", "text", "n_lines", "n_dropped", "emptied"]
    got = got.collect()
    assert {(r.rid, r.id, r.kept) for r in got} == {(1, "z", "w")}
    check(got, docs)
    assert any(r.emptied for r in got) and dedup_lines(df.limit(0)).count() == 0


def test_a_block_that_spans_partitions(spark, monkeypatch):
    """All lines share their long words, so all tables have one block; tiles and partitions split it."""
    monkeypatch.setattr(D, "TILE", 8)
    rng = random.Random(2)
    tails = ["".join(rng.choice("abc") for _ in range(4)) + " " + "".join(rng.choice("abc") for _ in range(4)) for _ in range(120)]
    docs = [(i, f"{t[:4]} quarterly {t[5:]} revenue ledger balance") for i, t in enumerate(tails)]
    # two families that no other line links
    docs += [(200 + i, f"{'z' * (30 + i % 3)} quarterly {'y' * 30} revenue ledger balance {'x' * (30 + i % 2)}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dedup_lines(df).collect()
    check(got, docs)
    assert sum(bool(r.text) for r in got) < 60


def near_pairs(texts, similarity=0.8):
    """All pairs of texts, sorted by length, with the edit similarity; bags of three-letter runs leave out
    what cannot have it."""
    import duckdb
    import pandas as pd

    n = np.array([len(t) for t in texts])
    bag = np.zeros((len(texts), 512), np.int16)
    for i, t in enumerate(texts):
        c = np.array([ord(x) for x in t], np.int64)
        np.add.at(bag[i], (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % 509, 1)
    cand = []
    for i in range(len(texts)):
        hi = np.searchsorted(n, n[i] / similarity + 1e-9, side="right")
        apart = np.abs(bag[i + 1:hi] - bag[i]).sum(1)  # an edit changes three runs on either side
        cand += [(i, int(j)) for j in np.flatnonzero(apart <= 6 * (1 - similarity) * n[i + 1:hi] + 1e-9) + i + 1]
    # by bytes the distance is between once and four times the one by characters
    far = [p for p in cand if n[p[1]] > 1000]
    frame = pd.DataFrame([(i, j, texts[i], texts[j]) for i, j in cand if n[j] <= 1000], columns=["i", "j", "a", "b"])  # noqa: F841
    close = duckdb.sql(f"SELECT i, j FROM frame WHERE levenshtein(a, b) <= 4 * ({1 - similarity:.6f} * greatest(length(a), length(b)) + 1e-9)").fetchall()
    return [p for p in [*close, *far] if lev(texts[p[0]], texts[p[1]]) <= (1 - similarity) * max(n[list(p)]) + 1e-9]


def test_recall_over_all_lines_against_true_edit_similarity(spark):
    """No bound of the method: every pair of distinct lines up to 200 characters."""
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    texts = sorted({n for x in t["text"] for line in x.split("\n") if (n := norm(line)) and len(n) <= 200}, key=lambda x: (len(x), x))
    true = near_pairs(texts)
    assert len(true) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = stored(df)
    uniq, comp = D.groups(rows, cut(D.lines_of(rows, 1), "lines"), 0.8)
    of = {r.first.id: r.component if r.component is not None else -r.gid - 1 for r in uniq.join(comp.withColumnRenamed("node", "gid"), "gid", "left").collect()}
    found = sum(of[a] == of[b] for a, b in true)
    print("recall", found / len(true), "of", len(true))
    assert found >= 0.9 * len(true)
    # and nothing is linked that the true pairs do not connect
    top = roots(len(texts), true)
    for group in {c: [i for i in of if of[i] == c] for c in set(of.values()) if c >= 0}.values():
        assert len({top[i] for i in group}) == 1


def test_exact_copies_over_all_documents(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    got = {r.doc_id: r for r in op3_linededup(spark, SF).collect()}
    assert len(got) == 1000
    seen = set()
    for d, text in sorted(zip(t["doc_id"], t["text"], strict=True)):
        kept, lines = got[d].text.split("\n"), text.split("\n")
        assert got[d].n_lines == len(lines) and (got[d].n_dropped == len(lines) or len(kept) == len(lines) - got[d].n_dropped)
        left, before = set(kept), set(seen)
        for line in lines:
            n = norm(line)
            if n:
                assert n not in before or line not in left
                seen.add(n)
            else:
                assert line in left


def test_pairs_of_characters_bound_the_edits():
    """Each edit turns four bits at most, and lines that share words only differ in more than similar ones may."""
    rng = random.Random(11)
    for letters in ("abcdefgh ", "aé東\U00020000 "):
        a = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
        b = ["".join(e for c in x for e in rng.choices(([c], [], [c, "z"], ["z"]), (9, 1, 1, 1))[0]) or "z" for x in a]
        one, other = D.grams(a), D.grams(b)
        assert all(int(np.bitwise_count(x ^ y).sum()) <= 4 * lev(s, t) for x, y, s, t in zip(one, other, a, b, strict=True))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4))
    lines = [f"quart reven ledge balan {' '.join(word() for _ in range(18))}" for _ in range(60)]
    bits = D.grams(lines)
    spared = [np.bitwise_count(bits[i] ^ bits[j]).sum() > 4 * (max(len(lines[i]), len(lines[j])) // 5) for i in range(60) for j in range(i)]
    assert sum(spared) > 0.5 * len(spared)


def test_lines_that_share_words_are_not_compared_in_squares(spark, monkeypatch):
    """One block of many lines that are similar to few others: most pairs are spared before their texts are read."""
    rng, compared = random.Random(5), []
    similar = D._similar
    monkeypatch.setattr(D, "_similar", lambda pairs, *a: compared.append(pairs.count()) or similar(pairs, *a))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4))
    docs = [(i, f"quart reven ledge balan {' '.join(word() for _ in range(18))}") for i in range(150)]
    docs += [(200 + i, docs[i][1][:-1] + "z") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(dedup_lines(df).collect(), docs)
    print("compared", compared)
    assert 20 <= sum(compared) < 7000  # of 14,365 pairs of lines in the block


def test_lines_of_one_group_are_not_compared_again(spark):
    """Late pairs of two groups: one goes first, and once it links the groups the others are not compared."""
    rng, compared = random.Random(9), []
    group = {i: i // 20 * 20 for i in range(120)}  # six groups of 20 lines and 30 single ones
    group |= {i: i for i in range(120, 150)}
    pairs = [(a, b) for a in group for b in range(a + 1, 150) if group[a] != group[b] and rng.random() < 0.7]
    links = {p for p in pairs if group[p[0]] < 60 and group[p[1]] < 60 or p[0] >= 140 or rng.random() < 0.002}
    comp = spark.createDataFrame([(i, g) for i, g in group.items() if i < 120], "node long, component long")
    rows = [(a, b, *sorted((group[a], group[b])), 5 if (a, b) in links and group[a] < 60 else rng.randrange(4, 90)) for a, b in pairs]

    def verified(some, label):
        got = [(r.a, r.b) for r in some.collect()]
        compared.extend(got)
        return cut(spark.createDataFrame([p for p in got if p in links], "a long, b long"), label)

    got = {r.node: r.component for r in D._across(comp, spark.createDataFrame(rows, "a long, b long, g long, h long, turned int"), verified).collect()}
    top = roots(150, [*links, *((i, g) for i, g in group.items())])
    least = {t: min(i for i in range(150) if top[i] == t) for t in top}
    assert all(got.get(i, i) == least[top[i]] for i in range(150))
    assert len(compared) == len(set(compared)) < 0.9 * len(pairs)
    assert sum(group[a] < 60 and group[b] < 60 for a, b in compared) < 0.1 * sum(group[a] < 60 and group[b] < 60 for a, b in pairs)


def test_a_rough_alignment_is_never_below_the_distance():
    rng, found, alike = random.Random(4), 0, 0
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    for _ in range(400):
        x = [word() for _ in range(rng.randrange(1, 40))]
        y = [e for w in x for e in rng.choices(([w], [], [w, word()], [word()]), (30, 1, 1, 1))[0]] or [word()]
        a, b = " ".join(x), " ".join(y)
        d = lev(a, b)
        assert d == 0 or not D.roughly(a, b, d - 1)
        most = max(len(a), len(b)) // 5
        alike += d <= most
        found += D.roughly(a, b, most)
    assert D.roughly("a", "a", 0) and not D.roughly("a b", "a", 1) and D.roughly("a b", "a", 2)
    assert 0.7 * alike < found <= alike


def test_workers_give_back_what_they_have_freed():
    """A worker that comes from another stage with much freed memory does not keep it, nor what it frees itself."""
    import subprocess
    import sys

    code = """if True:
        import re
        from fieldspan.llm import linededup as D
        size = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
        base = size()
        def fill():
            held = [bytes(1 << 16) + bytes([i % 256]) for i in range(3000)]
            pins = [bytes(1 << 10) for _ in range(8)]
            return held, pins
        held, pins = fill()
        last = held[-1]
        del held
        before = size() - base
        seen = list(D.trimmed(lambda batches: (size() - base for _ in batches))([1]))
        print(before, seen[0])
    """
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=D.__file__.split("/fieldspan/")[0]).stdout.split()
    assert float(out[0]) > 100 and float(out[1]) < 30, out
