import json

import pytest
from pyspark.sql import functions as F

from fieldspan.operators import doctype, errors, generator, gold, replay
from fieldspan.operators.generator import corpus
from fieldspan.sources import readers, writers


def test_causes_in_order(spark):
    text = "Ann Lee paid $5.00 on 03/14/2025, ref AB-12, Cedar Park Clinic"
    rows = [("payer_name", "Acme", "Acme", "OCR_CORRUPTION"), ("member_id", None, "AB-12", "SPURIOUS_EXTRACTION"), ("patient_dob", "03/14/2025", None, "MISSED_ENTIRELY"),
            ("amount_paid", None, None, "OK"), ("total_charge", "$5.00", "5", "FORMAT_NORMALISATION"), ("patient_name", "Ann Lee", "Bob Ray", "HALLUCINATION"),
            ("servicing_facility", "Cedar Park Clinic", "Cedar Park", "TRUNCATION"), ("document_reference", "AB-12", "Ann Lee", "WRONG_VALUE"),
            ("referring_provider_name", "Ann Lee", "Ann Lee paid", "OVER_CAPTURE"), ("document_date", "03/14/2025", "03/14/2025", "OK")]
    df = spark.createDataFrame([("a", 1, f, g, p, text, "inline") for f, g, p, _ in rows], "approach string, doc_id int, field string, gold string, pred string, text string, layout string")
    out = errors.classify(df)
    assert {r.field: r.cause for r in out.collect()} == {f: c for f, _, _, c in rows}
    n = {(r.by, r.approach, r.cause, r.layout, r.field): r.n for r in errors.counts(out).collect()}
    assert n["cause_layout", None, "TRUNCATION", "inline", None] == 1 and sum(v for k, v in n.items() if k[0] == "approach_field") == 8


def test_gold(spark):
    m = spark.createDataFrame([(str(i), {"a": "x"}, None) for i in range(4)], f"doc_id string, truth map<string,string>, service_lines {readers.SERVICE}")
    v = spark.createDataFrame([("1", {"b": "y"}, None, True, None, None), ("2", {"b": "z"}, None, False, "expert", ["c"]), ("3", None, None, None, "", None)],
                              f"doc_id string, fields map<string,string>, service_lines {readers.SERVICE}, verified boolean, adjudicated_by string, corrections array<string>")
    got = {r.doc_id: (r.gold_source, r.truth) for r in gold.load_gold(m, v).collect()}
    assert got == {"0": ("generator_truth", {"a": "x"}), "1": ("human_verified", {"b": "y"}), "2": ("expert_adjudicated", {"b": "z"}), "3": ("auto_verified_only", {"a": "x"})}
    assert gold.load_gold(m, None).select("gold_source").distinct().first()[0] == "generator_truth"
    g = spark.createDataFrame([(1, f, f"v{f}") for f in "abcd"], "doc_id int, field string, value string")
    d = spark.createDataFrame([(1, "a", "keep"), (1, "b", "unreadable"), (1, "c", "new")], "doc_id int, field string, decision string")
    adj = gold.adjudicate(g, d)
    assert {r.field: (r.value, r.outcome) for r in adj.collect()} == {"a": ("va", "kept"), "b": (None, "unreadable"), "c": ("new", "replaced"), "d": ("vd", "untouched")}
    tiers = gold.review_tiers(g.withColumn("text", F.lit("has va and vb")))
    s = gold.review_summary(tiers, adj).first()
    assert (s.fields_total, s.auto_verified, s.flagged, s.replaced) == (4, 2, 2, 1) and s.correction_rate == 0.25
    up = gold.upsert(g, g.limit(1).withColumn("value", F.lit("n")), "doc_id", "field")
    assert up.count() == 4 and up.where("value = 'n'").count() == 1
    r = spark.createDataFrame([("x", "s", 1)], "approach string, split string, f1 int")
    assert gold.upsert_report(r, r.withColumn("approach", F.lit("y"))).count() == 2
    with pytest.raises(ValueError):
        gold.upsert_report(r, r.withColumn("split", F.lit("t")))
    assert gold.missing(g.select("doc_id").distinct(), d).count() == 0 and gold.leaks(g, d, "doc_id").count() == 1
    q = gold.teacher_quality(g, g.where("field <> 'a'").withColumn("value", F.upper("value"))).collect()
    assert {x.field: x.correct for x in q} == {"a": 0, "b": 1, "c": 1, "d": 1}
    sp = spark.createDataFrame([(1, "b", 3, "exact")], "doc_id int, field string, start int, method string")
    assert gold.excluded_but_there(g, adj.select("doc_id", "field", "value"), sp).count() == 1
    t = spark.createDataFrame([("see RF19485] here", "RF194851"), ("none", "abc")], "t string, v string")
    assert [r[0] for r in t.select(gold.best_guess_region(F.col("t"), F.col("v"))).collect()] == ["see >>>RF19485<<<] here", None]


def test_generated_corpus(spark):
    df = corpus(spark, 300).cache()
    assert df.count() == 300 and corpus(spark, 300).drop("truth").exceptAll(df.drop("truth")).count() == 0
    from fieldspan.functions.normalize import is_valid_npi, normalize_amount, normalize_date

    t = F.col("truth")
    bad = df.where(~is_valid_npi(t["referring_provider_npi"]) | normalize_date(t["document_date"]).isNull() | normalize_amount(t["total_charge"]).isNull())
    assert bad.count() == 0
    clean = df.where("condition = 'clean'").select(F.explode("truth").alias("f", "v"), "text")
    assert clean.where(~F.contains("text", "v")).count() == 0
    assert df.select(is_valid_npi(generator.decoy_number(F.col("doc_id"))).alias("x")).where("x").count() == 0
    assert df.where("split = 'gold_synth' and template_id <= 10").count() == 0
    assert df.groupBy(F.col("template_id") % 2, F.col("doc_type")).count().count() == 12


def test_replay_batches_and_schema(spark):
    docs = spark.createDataFrame([(str(i), "x" * 7000) for i in range(4)], "doc_id string, text string")
    ans = spark.createDataFrame([("0", json.dumps({"document_type": "lab_order", "payer_name": " Acme ", "member_id": "", "prompt_tokens": 1000, "service_lines": [{"charge": "1"}]})),
                                 ("1", "not json"), ("2", json.dumps({"document_type": "odd"}))], "doc_id string, answer string")
    got = {r.doc_id: r for r in replay.replay(docs, ans).collect()}
    assert got["0"].doc_type == "lab_order" and got["0"].fields == {"payer_name": "Acme"} and got["0"].cost == pytest.approx(0.005) and got["0"].service_lines[0].charge == "1"
    assert got["1"].doc_type == got["2"].doc_type == "unknown" and got["3"].missing and replay.replay(docs, ans, "fixed").count() == 3
    assert docs.select(F.length(replay.clipped(F.col("text")))).first()[0] == 6005
    assert set(replay.json_schema()["required"]) <= set(replay.answer_schema().fieldNames())
    b = replay.batches(spark.range(40).withColumnRenamed("id", "doc_id"), size=15)
    assert [(r.batch_id, r.n) for r in b.groupBy("batch_id").agg(F.count("*").alias("n")).orderBy("batch_id").collect()] == [(0, 15), (1, 15), (2, 10)]
    assert all(r.batch_id == r.doc_id // 15 for r in b.collect()) and replay.usage_estimate(docs).first().prompt_tokens == 4 * 1944


def test_doctype_model(spark):
    df = spark.createDataFrame([(i, ["lab order blood test form", "claim form payment due now"][i % 2] + f" w{i % 3}", ["lab_order", "insurance_claim"][i % 2]) for i in range(40)],
                               "doc_id int, text string, doc_type string")
    got = doctype.predict(doctype.fit(df), df.drop("doc_type"))
    assert got.join(df.select("doc_id", "doc_type"), "doc_id").where("doc_type = predicted_type").count() == 40


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"doc_id":"a","split":"train","truth":{"x":"1"}}\n\n{"doc_id":"b","split":"val"}\n')
    assert [r.doc_id for r in readers.manifest(spark, str(tmp_path / "m.jsonl"), "train").collect()] == ["a"]
    (tmp_path / "docs").mkdir()
    doc = {"doc_id": "a", "text": "Date: 03/14/2025", "words": [{"text": "Date:", "start": 0, "end": 5}], "condition": "clean", "lang": "en"}
    (tmp_path / "docs" / "a.json").write_text(json.dumps(doc, indent=1))
    r = readers.documents(spark, str(tmp_path / "docs")).first()
    assert r.text[r.words[0].start:r.words[0].end] == r.words[0].text and r.source_path.endswith("a.json")
    (tmp_path / "cache.json").write_text(json.dumps({"a": {"payer_name": "X"}, "b": {}}))
    assert replay.replay(readers.documents(spark, str(tmp_path / "docs")), readers.prediction_cache(spark, str(tmp_path / "cache.json"))).first().fields == {"payer_name": "X"}
    lay = spark.createDataFrame([("/x/a.b.pdf", "t" * 50, "o"), ("c.pdf", " ", "o")], "path string, layer_text string, ocr_text string")
    assert [(x.doc_id, x.condition, x.text[0]) for x in readers.choose_layer(lay).collect()] == [("a.b", "clean", "t"), ("c", "scanned", "o")]
    w = spark.createDataFrame([("a", 200.0, 0.0, 400.0, 100.0, 90.0), (" ", 0.0, 0.0, 1.0, 1.0, 90.0), ("b", 0.0, 0.0, 1.0, 1.0, -1.0)], "text string, x0 double, y0 double, x1 double, y1 double, conf double")
    assert [x.x0 for x in readers.recognised_words(w).collect()] == [72.0]
    (tmp_path / "p.bin").write_bytes(b"hello")
    got = readers.binary_files(spark, str(tmp_path / "p.bin"), lambda p, c: [(0, c.decode(), 0.0, 0.0, 1.0, 1.0)]).first()
    assert got.text == "hello"
    rep = spark.createDataFrame([("a", "s", 0.5)], "approach string, split string, f1 double")
    writers.report(rep, str(tmp_path / "r1"))
    writers.report(rep.withColumn("approach", F.lit("b")), str(tmp_path / "r2"), spark.read.json(str(tmp_path / "r1")))
    assert spark.read.json(str(tmp_path / "r2")).count() == 2
    writers.batch_files(replay.batches(spark.range(20).withColumnRenamed("id", "doc_id")), str(tmp_path / "batches"))
    assert spark.read.json(str(tmp_path / "batches")).where("batch_id = 1").count() == 5
    writers.silver_set(spark.createDataFrame([("a", "train")], "doc_id string, split string"), str(tmp_path / "silver"))
    assert spark.read.json(str(tmp_path / "silver")).first().split == "train"


def test_stream_of_documents(spark, tmp_path):
    from fieldspan.streaming import extract as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"doc_id": "a", "text": "REMITTANCE ADVICE\nMember ID: ABC123456789"}))
    S.extract_to(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    assert spark.read.json(str(tmp_path / "out")).first().fields.member_id == "ABC123456789"
