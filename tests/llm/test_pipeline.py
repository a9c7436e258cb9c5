from collections import Counter, defaultdict

import pyarrow.parquet as pq
import public_tokenizers
from test_linededup import brute as brute_lines
from test_mixing import brute_targets
from test_simhash import brute_classes, brute_fp

import corpus_pipeline as P
from fieldspan.llm.common import cut
from fieldspan.llm.tokens import tokenizer

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=str)


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(90).coalesce(1)
    extra = docs.limit(3).union(docs.limit(2))
    docs = cut(docs.union(extra).coalesce(1), "in")
    n = docs.count()

    clean = cut(P.drop_toxic(spark, docs, SF), "a")
    assert clean.columns == list(P.COLUMNS) and 0 < clean.count() <= n
    gone = Counter(rows_of(docs)) - Counter(rows_of(clean))
    assert Counter(rows_of(clean)) + gone == Counter(rows_of(docs))

    lines = cut(P.drop_lines(spark, clean, SF), "b")
    source = [tuple(r) for r in clean.collect()]
    want = brute_lines([(r[0], r[1]) for r in source])
    left = Counter((r[0], t) for r, t in zip(source, want, strict=True) if t is None or t == r[1] or any(c.isalnum() for c in t))
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == left
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    single = cut(P.drop_near_duplicates(spark, lines, SF), "c")
    fps = [(r.doc_id, brute_fp(r.text)) for r in lines.collect()]
    classes = brute_classes({f for _, f in fps}, 2)
    best = defaultdict(list)
    for d, f in fps:
        best[classes[f]].append(d)
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(v) for v in best.values())

    mixed = cut(P.mix_sources(spark, single, SF), "d")
    size = lambda t: len((t or "").encode().split())
    sizes, took, largest = Counter(), Counter(), Counter()
    for r in single.collect():
        sizes[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    times = Counter(tuple(r) for r in mixed.collect())
    assert set(times) <= {tuple(r) for r in single.collect()} and max(times.values()) <= 2
    for r, k in times.items():
        took[r[3]] += k * size(r[1])
    for s, t in brute_targets(dict(sizes)).items():
        assert abs(took[s] - t) <= largest[s] / 2 + 1

    packed = P.pack_sequences(spark, mixed, SF).collect()
    tok = tokenizer(public_tokenizers.path("word_bpe_49k.json")).tok
    tokens = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r.length for r in packed) == tokens
    cells = defaultdict(int)
    for r in packed:
        cells[r.sequence_id] += r.length
    assert all(v == 2048 or v & (v - 1) == 0 for v in cells.values())


def test_run_on_the_whole_table(spark):
    out = P.run(spark, SF)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    known = set(pq.read_table(f"{SF}/documents.parquet")["doc_id"].to_pylist())
    assert ids and ids <= known


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "some words that stand here", "en", "s", 1),
            (3, "some words that stand here", "fr", None, 1), (4, "x " * 30000, "de", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        if name == "line_dedup":
            assert docs.count() == 5
        if name == "simhash_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["2", "4", "None"]
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
