from pyspark.sql import functions as F

from fieldspan.operators import report, score


def test_run_and_summary(spark):
    docs = spark.createDataFrame([(i, f"Ann Lee {i}", "patient_intake_form", "clean", "en", "t") for i in range(4)],
                                 "doc_id int, text string, doc_type string, condition string, lang string, gold_source string")
    extractor = lambda d: d.select("doc_id", F.create_map(F.lit("patient_name"), F.col("text")).alias("fields"),
                                   F.when(F.col("doc_id") == 3, "broken").alias("error"))
    gold = docs.select("doc_id", F.lit("patient_name").alias("field"), F.col("text").alias("value"))
    pred, runs = report.run_approach(docs, extractor, "x")
    assert pred.count() == runs.count() == 3
    r = report.summarise(score.outcomes(runs, docs, gold, pred), 10).first()
    assert r.f1 == 1 and r.n_documents == 3 and r.f1_ci95.lo == 1 and len(r.by_field) == 6 and len(r.slices) == 4
    pred, runs = report.run_approach(docs, extractor, "x", mode="fixed")
    assert score.overall(score.outcomes(runs, docs, gold, pred)).first().fn == 1
