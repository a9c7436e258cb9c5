import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from fieldspan.functions import arrow
from fieldspan.functions import normalize as N
from fieldspan.functions import text as X


def values(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string").withColumn("o", f(F.col("v")))
    return [r.o for r in df.orderBy("i").collect()]


def test_dates(spark):
    cases = {"03/14/2025": "2025-03-14", "3/4/25": "2025-03-04", "14/03/2025": "2025-03-14", "2025-03-14": "2025-03-14", "03.14.2025": "2025-03-14",
             "14-Mar-2025": "2025-03-14", "March 14, 2025": "2025-03-14", "Mar. 3rd 99": "1999-03-03", "14 de marzo de 2025": "2025-03-14",
             "DOS: 03/14/2025": "2025-03-14", "dated 5 sept 2020": "2020-09-05", "02/30/2025": None, "soon": None, "": None, None: None,
             "5 of 12": None, "13/13/2020": None, "1/2/31": "1931-01-02", " Fecha 3/4/2020; ": "2020-03-04"}
    assert values(spark, N.normalize_date, cases) == list(cases.values())
    assert values(spark, lambda c: N.date_parts(c)["ambiguous"], ["03/04/2025", "13/04/2025", "2025-03-04", "x", None]) == [True, False, False, False, False]


def test_amounts(spark):
    cases = {"$1,234.56": "1234.56", "USD 99": "99.00", "1.234,56": "1234.56", "12,50": "12.50", "1,234": "1234.00", "($5.005)": "-5.00", "-3": "-3.00",
             "0.125": "0.12", "0.135": "0.14", "1.234.567": "1234.57", "Total: $7": "7.00", "none": None, "": None, None: None, "1-2": None, "-0": "0.00"}
    assert values(spark, N.normalize_amount, cases) == list(cases.values())


def test_names_orgs_codes(spark):
    people = {"Dr. Jane Doe, M.D.": "jane doe", "Doe, Jane": "jane doe", "JOSÉ  Núñez Jr.": "jose nunez", "O'Neil-Smith, Ann": "ann o'neil-smith", "Dr.": None, "": None}
    assert values(spark, N.normalize_person, people) == list(people.values())
    orgs = {"Acme Health, Inc.": "acme health", "St. Mary's P.C.": "st mary s", "A & B Group LLC": "a & b", "": None}
    assert values(spark, N.normalize_org, orgs) == list(orgs.values())
    assert values(spark, N.normalize_code, ["A01.1", " ref-00 1", "--", None]) == ["A011", "REF001", None, None]


def test_checks(spark):
    assert values(spark, N.is_valid_npi, ["1234567893", "1234567890", "123-456-7893", "12", None]) == [True, False, True, False, False]
    assert values(spark, N.npi_check_digit, ["123456789"]) == [3]
    assert values(spark, N.looks_like_icd10, ["a01.1", "U12", "Z9", None]) == [True, False, False, False]
    assert values(spark, N.looks_like_cpt, ["99213", "0001F", "D1234", None]) == [True, True, False, False]


def test_presence_and_match(spark):
    df = spark.createDataFrame([("total_charge", "$1,234.56", "Pay 1234.56 now"), ("document_date", "March 4, 2025", "on 03/04/2025."), ("document_date", "2025-03-05", "on 03/04/2025."),
                                ("payer_name", "", "x"), ("payer_name", None, "x"), ("payer_name", "Zed", "abc"), ("payer_name", "Café", "the CAFE")], "f string, v string, t string")
    assert [r[0] for r in df.select(N.appears_in_text(F.col("v"), F.col("t"), F.col("f"))).collect()] == [True, True, False, True, True, False, True]
    df = spark.createDataFrame([("total_charge", "$1", "1.00"), ("total_charge", "x", "y"), ("member_id", None, None), ("member_id", "a", None), ("other", " A  b", "a B")], "f string, a string, b string")
    assert [r[0] for r in df.select(N.values_match(F.col("f"), F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True]


def test_text(spark):
    assert values(spark, X.fold, ["é½ﬁº́…", None]) == ["e1⁄2fio...", None]
    assert values(spark, arrow.strip_accents, ["é½ﬁº́…", None, "ά"]) == ["e1⁄2fio...", None, "α"]
    df = spark.createDataFrame([("abc d", "abd  d"), ("", ""), ("", "x"), ("a", "bcdef")], "a string, b string")
    assert [r[0] for r in df.select(X.character_accuracy(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.8), 1.0, 0.0, 0.0]
    df = spark.createDataFrame([("a\nb  c", "a b"), ("abc", "bc"), ("abc", " "), ("x", "y")], "t string, v string")
    assert [r[0] for r in df.select(X.present_in(F.col("t"), F.col("v"))).collect()] == [True, True, False, False]


def test_arrow_functions(spark):
    assert values(spark, arrow.date_tail, ["2025 March 4", "prose", None]) == [date(2025, 3, 4).isoformat(), None, None]
    df = spark.createDataFrame([("abcd", "abxd"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(arrow.similarity("a", "b")).collect()] == [0.75, 0.0]


def test_fuzzy_windows(spark):
    from fieldspan.operators.align import compact_match, fuzzy_match

    rows = [("Name: Cedar Pork Imaging", "Cedar Park Imaging"), ("nothing here", "Cedar Park"), ("abc", "abc"), ("xx Cedr Park Imaging, y", "Cedar Park Imaging"),
            ("\u00bd price at Cafe Ol\u00e9", "1/2 PRICE"), ("", "Cedar Park"), (None, "Cedar Park"), ("Cedar Park", None)]
    df = spark.createDataFrame(rows, "t string, v string")
    got = [r.s for r in df.select(fuzzy_match(F.col("t"), F.col("v")).alias("s")).collect()]
    assert (got[0].start, got[0].end) == (6, 24) and got[0].score > 88
    assert got[3].score >= 88 and rows[3][0][got[3].start:got[3].end] == "Cedr Park Imaging"
    assert [got[i] for i in (1, 2, 5, 6, 7)] == [None] * 5
    # a character that folds into several keeps its place, also for the values behind it
    half = df.select(compact_match(F.col("t"), F.col("v")).alias("s")).collect()[4].s
    assert (half.start, half.end) == (0, 7)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    cases = []
    for _ in range(25):
        page = [word() for _ in range(8)]
        v = " ".join(page[3:6])
        hurt = list(v)
        for i in rng.sample(range(len(v)), rng.choice([1, 2, 3])):
            hurt[i] = rng.choice("xyz")
        cases.append((" ".join(page), "".join(hurt)))
    out = spark.createDataFrame(cases, "t string, v string").select("t", "v", fuzzy_match(F.col("t"), F.col("v")).alias("s")).collect()

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for r in out:  # every window, no seeds
        hay, needle = r.t.replace(" ", ""), r.v.replace(" ", "")
        best = max(100 * (1 - dist(needle, hay[i:j]) / max(len(needle), j - i)) for i in range(len(hay)) for j in range(i + 1, min(len(hay), i + 2 * len(needle)) + 1))
        assert (r.s is None) == (best < 88) and (r.s is None or abs(r.s.score - best) < 1e-9)
