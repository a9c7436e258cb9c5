import pytest
from pyspark.sql import functions as F

from fieldspan.functions.text import strip
from fieldspan.operators import align, layout, rules

TEXT = """EXPLANATION OF BENEFITS
Patient Name: Linda Davis    Member ID: ABC123456789
Date: 03/14/2025   Insurance Carrier: WellCare
Total Charge: $1,234.56
Facility
Cedar Park Imaging Center
Reference #: EOB-1234567
99213 03/10/2025 1 $120.50 $100.00"""


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id int, text string")


def test_lines_words_and_offsets(spark):
    r = one(spark, "ab  cd\n\n e f").select(layout.words_of(F.col("text")).alias("l"), layout.line_starts(F.col("text")).alias("s")).first()
    assert r.s == [0, 7, 8] and [x.no for x in r.l] == [0, 2]
    assert [(w.text, w.start, w.end) for x in r.l for w in x.words] == [("ab", 0, 2), ("cd", 4, 6), ("e", 9, 10), ("f", 11, 12)]
    assert r.l[1].words[0].x0 == 6.0


def test_anchors_take_the_longest_label(spark):
    r = rules.with_anchors(one(spark, "Patient Name: Linda Davis   D.O.B.: 1/2/1980\nInsurance Carrier: X")).first()
    assert [(a.fields, a.start, a.end) for a in r.lines[0].anchors] == [(["patient_name"], 0, 13), (["patient_dob"], 28, 35)]
    assert r.lines[1].anchors[0].fields == ["payer_name"]


def test_extract_a_document(spark):
    for mode in ("parity", "fixed"):
        r = rules.extract(one(spark, TEXT), mode=mode).first()
        assert r.found_type == "remittance_advice" and r.found_type_confidence == 0.6
        f = r.fields
        assert f["patient_name"] == "Linda Davis" and f["member_id"] == "ABC123456789" and f["document_date"] == "03/14/2025"
        assert f["payer_name"] == "WellCare" and f["total_charge"] == "$1,234.56" and f["servicing_facility"] == "Cedar Park Imaging Center"
        assert f["document_reference"] == "EOB-1234567" and f["procedure_code"] == "99213" and r.org_roles.payer_org == "WellCare"
        assert r.confidences["patient_name"] == pytest.approx(0.95) and r.org_roles.referring_org == "EXPLANATION OF BENEFITS"
        line = r.service_lines[0]
        assert (line.procedure_code, line.date_of_service, line.units) == ("99213", "03/10/2025", "1")
        assert (line.charge, line.paid) == (("99213", "03") if mode == "parity" else ("$120.50", "$100.00")) or mode == "parity"
    spans = {x.field: x for x in rules.long_form(rules.extract(one(spark, TEXT)), "nlp").collect()}
    assert TEXT[spans["payer_name"].start:spans["payer_name"].end] == "WellCare"


def test_scores_and_cuts(spark):
    df = spark.createDataFrame([("Jane Doe Member ID: 7",), ("Jane",), ("9x y",), ("A b c d e f",)], "v string")
    assert [r[0] for r in df.select(rules.cut_at_label(F.col("v"))).collect()] == ["Jane Doe", "Jane", "9x y", "A b c d e f"]
    assert [r[0] for r in df.select(rules.type_score("patient_name", F.col("v"))).collect()] == [30, 20, 30, 20]
    assert [r[0] for r in df.select(rules.type_score("payer_name", F.col("v"))).collect()] == [90, 75, 90, 90]
    assert one(spark, "nothing").select(rules.doctype_by_words(F.col("text")).alias("t")).first().t.doc_type == "referral_letter"
    assert df.select(strip(F.lit(" \t a \n"))).first()[0] == "a"


def test_line_grouping_and_assembly(spark):
    rows = [(1, 0, "a", 0, 0.0, 0.0, 10.0, 10.0), (1, 1, "c", 0, 100.0, 1.0, 110.0, 11.0), (1, 2, "b", 0, 13.0, 2.0, 20.0, 12.0), (1, 3, "z", 0, 0.0, 30.0, 5.0, 40.0),
            (1, 4, "p", 1, 0.0, 0.0, 5.0, 10.0)]
    boxes = spark.createDataFrame(rows, "doc_id int, pos int, text string, page int, x0 double, y0 double, x1 double, y1 double")
    lines = layout.group_into_lines(boxes)
    assert [(r.text, r.line_idx, r.place) for r in lines.orderBy("line_idx", "place").collect()] == [("a", 0, 0), ("b", 0, 1), ("c", 0, 2), ("z", 1, 0), ("p", 2, 0)]
    texts, words = layout.assemble(lines)
    text = texts.first().text
    assert text == "a b" + " " * 10 + "c\nz\np"
    assert all(text[w.start:w.end] == w.text for w in words.collect())
    placed = layout.words_in_lines(words.select("doc_id", "text", "start", "end"), spark.createDataFrame([(1, 0, 0, 14), (1, 1, 15, 16), (1, 2, 17, 18)], "doc_id int, no int, start int, end int"))
    assert sorted((r.text, r.line_no) for r in placed.collect()) == [("a", 0), ("b", 0), ("c", 0), ("p", 2), ("z", 1)]


def test_alignment_cascade(spark):
    text = "Pay to Cedar Park\nImaging, ref RF-1948.51. Total $5 and $5. Café Olé"
    cases = [("$5", "exact", "$5", 2), ("cedar  park imaging", "whitespace", "Cedar Park\nImaging", 1), ("rf194851", "compact", "RF-1948.51", 1),
             ("cafe ole", "compact", "Café Olé", 1), ("Cedor Park Imaging", "fuzzy", "Cedar Park\nImaging", 1), ("absent thing", "none", None, 0), ("", "none", None, 0)]
    df = spark.createDataFrame([(1, i, text, c[0]) for i, c in enumerate(cases)], "doc_id int, seq long, text string, value string")
    got = {r.seq: r for r in align.find_spans(df).collect()}
    for i, (_, method, sub, n) in enumerate(cases):
        r = got[i]
        assert r.method == method and (text[r.start:r.end] if r.start is not None else None) == sub
        assert method in ("fuzzy", "none") or r.occurrences == n


def test_overlaps_bio_and_picks(spark):
    spans = spark.createDataFrame([(1, 0, "a", 0, 10, "exact", 100.0, 1), (1, 1, "b", 5, 20, "exact", 100.0, 1), (1, 2, "c", 18, 22, "fuzzy", 99.0, 2), (1, 3, "d", 30, 31, "none", 0.0, 0)],
                                  "doc_id int, seq long, field string, start int, end int, method string, score double, occurrences int").withColumn(
        "start", F.when(F.col("method") != "none", F.col("start"))).withColumn("end", F.when(F.col("method") != "none", F.col("end")))
    r = {x.field: x for x in align.resolve_overlaps(spans).collect()}
    assert [r[k].method for k in "abcd"] == ["overlap", "exact", "overlap", "none"] and r["a"].start is None
    rep = align.alignment_report(align.resolve_overlaps(spans)).first()
    assert (rep.total, rep.aligned, rep.ambiguous) == (4, 1, 1)
    tokens = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate([(0, 0), (0, 4), (5, 9), (10, 14), (15, 18)])], "doc_id int, pos int, start int, end int")
    two = spark.createDataFrame([(1, "x", 0, 9), (1, "y", 10, 14)], "doc_id int, field string, start int, end int")
    bio = align.spans_to_bio(tokens, two)
    assert [x.label for x in bio.orderBy("pos").collect()] == ["O", "B-x", "I-x", "B-y", "O"]
    assert [(x.field, x.start, x.end) for x in align.bio_to_spans(bio).orderBy("start").collect()] == [("x", 0, 9), ("y", 10, 14)]
    stray = spark.createDataFrame([(1, 0, 0, 2, "I-x"), (1, 1, 3, 5, "I-x"), (1, 2, 6, 8, "I-y"), (1, 3, 9, 10, "B-y")], "doc_id int, pos int, start int, end int, label string")
    assert [(x.field, x.start, x.end) for x in align.bio_to_spans(stray).orderBy("start").collect()] == [("x", 0, 5), ("y", 6, 8), ("y", 9, 10)]
    windows = spark.createDataFrame([(1, 0, 5, 8, "O", 0.6), (1, 1, 5, 8, "B-x", 0.9), (1, 2, 5, 8, "I-x", 0.9), (1, 0, 0, 0, "O", 1.0)], "doc_id int, window int, start int, end int, label string, confidence double")
    assert [x.label for x in align.merge_windows(windows).collect()] == ["B-x"]
    cand = spark.createDataFrame([(1, "payer_name", "ab", 0), (1, "payer_name", "abc", 1), (1, "payer_name", "xyz", 2), (1, "total_charge", "1", 3), (1, "total_charge", "100", 4)],
                                 "doc_id int, field string, value string, seq int")
    assert {x.field: x.value for x in align.best_values(cand, ("total_charge",)).collect()} == {"payer_name": "abc", "total_charge": "1"}
    lines = spark.createDataFrame([(1, "procedure_code", "a", 0), (1, "procedure_code", "b", 1), (1, "total_charge", "5", 2)], "doc_id int, field string, value string, seq int")
    assert [(x.procedure_code, x.date_of_service, x.charge) for x in align.zip_service_lines(lines).orderBy("line_no").collect()] == [("a", None, "5"), ("b", None, None)]
