import random

import pytest
from pyspark.sql import functions as F

from fieldspan.operators import score, stats

FIELDS = ["patient_name", "patient_dob", "referring_provider_name", "payer_name", "member_id", "document_date"]


@pytest.fixture(scope="module")
def fact(spark):
    docs = spark.createDataFrame([(i, "patient_intake_form", f"Ann Lee {i} 03/14/2025 AB123456{i}", ["clean", "scanned"][i % 2], "en", None) for i in range(4)]
                                 + [(9, "odd", "x", "clean", "en", "t")], "doc_id int, doc_type string, text string, condition string, lang string, gold_source string")
    gold = spark.createDataFrame([(i, "patient_name", f"Ann Lee {i}") for i in range(4)] + [(i, "document_date", "03/14/2025") for i in range(4)]
                                 + [(9, "extra", "X")], "doc_id int, field string, value string")
    pred = spark.createDataFrame([("a", i, "patient_name", f"ann lee {i}") for i in range(3)] + [("a", 3, "patient_name", "Zed"), ("a", 0, "document_date", "2025-03-14"),
                                 ("a", 1, "document_date", ""), ("a", 2, "payer_name", "Acme"), ("a", 9, "extra", " x "), ("b", 0, "patient_name", "Ann Lee 0")], "approach string, doc_id int, field string, value string")
    runs = spark.createDataFrame([("a", i) for i in (0, 1, 2, 3, 9)] + [("b", i) for i in range(4)], "approach string, doc_id int")
    return score.outcomes(runs, docs, gold, pred).cache()


def test_outcomes(fact):
    assert fact.count() == 4 * 6 + 1 + 4 * 6
    r = {(x.approach, x.doc_id, x.field): x for x in fact.collect()}
    assert r["a", 0, "patient_name"].tp == 1 and not r["a", 0, "patient_name"].exact and r["b", 0, "patient_name"].exact
    wrong = r["a", 3, "patient_name"]
    assert (wrong.tp, wrong.fp, wrong.fn, wrong.tn) == (0, 1, 1, 0) and wrong.hallucinated
    assert r["a", 0, "document_date"].correct and not r["a", 0, "document_date"].hallucinated
    assert (r["a", 1, "document_date"].fn, r["a", 1, "document_date"].fp) == (1, 0)
    assert r["a", 2, "payer_name"].fp == 1 and r["a", 0, "payer_name"].tn == 1
    assert r["a", 9, "extra"].tp == 1


def test_aggregates(fact):
    o = {r.approach: r for r in score.overall(fact).collect()}
    a = o["a"]
    assert (a.tp, a.fp, a.fn) == (5, 2, 4) and a.n_documents == 5 and a.precision == pytest.approx(5 / 7) and a.recall == pytest.approx(5 / 9)
    assert a.hallucination_rate == pytest.approx(2 / 7)
    f = {(r.approach, r.field): r for r in score.by_field(fact).collect()}
    assert f["a", "patient_dob"].f1 == 0 and f["a", "patient_dob"].tn == 4 and f["a", "patient_dob"].accuracy == 1
    macro = sum(r.f1 for k, r in f.items() if k[0] == "a") / 7
    assert a.macro_f1 == pytest.approx(macro)
    s = {(r.approach, r.slice, r.value): r for r in score.slices(fact).collect()}
    assert s["a", "condition", "clean"].tp + s["a", "condition", "scanned"].tp == 5
    assert s["a", "gold_source", "?"].tp + s["a", "gold_source", "t"].tp == 5 and len([k for k in s if k[1] == "doc_type"]) == 3


def test_doctype_matrix(spark):
    pairs = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("x", "z")], "gold string, pred string")
    m = {(r.gold, r.pred): r.n for r in score.confusion(pairs).collect()}
    assert len(m) == 9 and m["x", "y"] == 1 and m["z", "z"] == 0
    c = {r.label: r for r in score.class_metrics(pairs).collect()}
    assert c["y"].precision == 0.5 and c["y"].recall == 1 and c["z"].support == 0
    d = score.doctype_summary(pairs).first()
    assert d.accuracy == 0.5 and d.macro_f1 == pytest.approx((0.5 + 2 / 3) / 2)


def test_service_lines_are_multisets(spark):
    rows = [("gold", 1, "99213", "03/14/2025", "$10"), ("gold", 1, "99213", "03/14/2025", "$10"), ("gold", 1, "1", None, None),
            ("pred", 1, "99213", "2025-03-14", "10.00"), ("pred", 1, "1", None, None), ("pred", 1, "2", None, "x"), ("pred", 2, "99213", "2025-03-14", "10")]
    r = score.service_lines(spark.createDataFrame(rows, "side string, doc_id int, procedure_code string, date_of_service string, charge string")).first()
    assert (r.tp, r.fp, r.fn) == (2, 2, 1)


def test_latency_top_and_costs(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(100)], "k string, v double")
    r = score.latency_profile(df, "k", "v").first()
    assert (r.p50, r.p95) == (49.5, 95.0)
    e = spark.createDataFrame([("a", f, i) for i, f in enumerate("xxyzzw")], "approach string, field string, seq int")
    assert [(r.field, r.n) for r in score.top_fields(e, 3).orderBy("rank").collect()] == [("x", 2), ("z", 2), ("y", 1)]
    c = spark.createDataFrame([(1000, 100), (None, None)], "prompt_tokens int, completion_tokens int")
    assert score.mean_cost(c, 5.0, 25.0).first().mean_cost == pytest.approx(0.00375)
    assert [r.k for r in score.rare_classes(spark.createDataFrame([("a",), ("b",), ("b",), ("b",)], "k string"), "k").collect()] == ["a"]


def test_bootstrap_parity_with_a_plain_loop(spark, fact):
    out = fact.where("approach = 'a'")
    docs = sorted((r.doc_id, r.tp, r.fp, r.fn) for r in out.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")]).collect())
    f1 = lambda rows: (lambda t, p, n: 2 * t / (2 * t + p + n) if t else 0.0)(*(sum(r[i] for r in rows) for i in (1, 2, 3)))
    rng = random.Random(0)
    got = sorted(f1([docs[rng.randrange(5)] for _ in range(5) if rng.random() < 2]) for _ in range(40))
    r = stats.bootstrap_ci(out, 40, drawn=stats.seeded_draws(spark, 5, 40)).first()
    assert r.point == pytest.approx(f1(docs)) and 0 <= r.lo <= r.hi <= 1 and len(got) == 40
    same = stats.seeded_draws(spark, 5, 40).collect()
    assert r.lo == pytest.approx(sorted(f1([docs[x.i] for x in same if x.b == b]) for b in range(40))[1])
    s = stats.bootstrap_ci(fact, 50)
    assert s.count() == 2 and all(x.lo <= x.point + 0.5 for x in s.collect())


def test_paired_and_compare(spark, fact):
    r = stats.paired_pvalue(fact, "a", "b", 99).first()
    assert r.n_docs == 4 and 0 < r.p_value <= 1
    assert stats.paired_pvalue(fact, "a", "none", 9).first().p_value == 1.0
    assert stats.paired_pvalue(fact, "a", "a", 9).first().p_value == 1.0
    c = stats.compare(fact, ["b", "a"], 20).first()
    assert (c.a, c.b) == ("a", "b") and c.f1_a > c.f1_b


def test_determinism_and_curve(spark):
    runs = spark.createDataFrame([(1, r, {"b": "x", "a": "y"}) for r in range(3)] + [(2, r, {"a": str(r)}) for r in range(3)], "doc_id int, run int, f map<string,string>")
    runs = runs.select("doc_id", "run", stats.signature(F.lit("t"), F.col("f")).alias("signature"))
    r = stats.determinism(runs).first()
    assert (r.rate, r.deterministic) == (0.5, False)
    docs = spark.createDataFrame([(i, 1 if i > 2 else 0, 0, 0 if i > 2 else 1) for i in range(1, 7)], "seq int, tp int, fp int, fn int")
    c = {x["size"]: x for x in stats.learning_curve(docs, [2, 6]).collect()}
    assert c[2].f1 == 0 and c[6].f1 == pytest.approx(0.8) and c[6].gain == pytest.approx(0.8)
