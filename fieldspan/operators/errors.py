"""Error taxonomy: one cause for each wrong decision, in a fixed order of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import appears_in_text, normalize_field
from ..functions.text import let, present, strip


def classify(pairs: DataFrame) -> DataFrame:
    """pairs (approach, doc_id, field, gold, pred, text, ...) with cause. The other gold values of the
    document come from pairs itself, as one list per (approach, document). Outcomes bring norm_gold, norm_pred
    and that list (golds) with them; then nothing is shuffled."""
    g, p = present(F.col("gold")), present(F.col("pred"))
    carried = ("norm_gold", "norm_pred", "golds")
    if all(c in pairs.columns for c in carried):
        rows = pairs.withColumnsRenamed({"norm_gold": "ng", "norm_pred": "np"})
    else:
        rows = pairs.drop(*carried).withColumns({"ng": F.when(g, normalize_field(F.col("field"), F.col("gold"))), "np": F.when(p, normalize_field(F.col("field"), F.col("pred")))})
        # a document's few fields; no exchange where the rows are dealt by document already
        own = Window.partitionBy("approach", "doc_id")
        rows = rows.withColumn("golds", F.collect_list(F.when(F.col("ng").isNotNull(), F.struct("field", "ng"))).over(own))
    alnum = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    # the page does not show the gold value, neither as it is nor normalised; the prediction plays no part
    corrupted = g & ~F.contains(F.col("text"), F.col("gold")) & let(
        alnum(F.coalesce(F.col("ng"), F.lit(""))), lambda v: (v == "") | ~F.contains(alnum(F.col("text")), v))
    same = F.col("ng").eqNullSafe(F.col("np"))
    confused = F.exists(F.coalesce("golds", F.expr("cast(array() as array<struct<field:string,ng:string>>)")),
                        lambda o: (o["field"] != F.col("field")) & (o["ng"] == F.col("np")))
    cause = (F.when(corrupted, "OCR_CORRUPTION").when(p & ~g, "SPURIOUS_EXTRACTION").when(g & ~p, "MISSED_ENTIRELY").when(~g & ~p, "OK")
             .when(same, F.when(strip(F.col("gold")) != strip(F.col("pred")), "FORMAT_NORMALISATION").otherwise("OK"))
             .when(~appears_in_text(F.col("pred"), F.col("text"), F.col("field")), "HALLUCINATION")
             .when(F.contains("ng", "np"), "TRUNCATION").when(F.contains("np", "ng"), "OVER_CAPTURE")
             .when(F.coalesce(confused, F.lit(False)), "LABEL_CONFUSION").otherwise("WRONG_VALUE"))
    return rows.withColumn("cause", cause).drop("ng", "np", "golds")


def counts(errors: DataFrame) -> DataFrame:
    """Numbers by (approach, cause), (cause, layout) and (approach, field) in one pass; `by` names the set."""
    sets = [[F.col("approach"), F.col("cause")], [F.col("cause"), F.col("layout")], [F.col("approach"), F.col("field")]]
    by = F.when(F.grouping("layout") == 0, "cause_layout").when(F.grouping("field") == 0, "approach_field").otherwise("approach_cause")
    return errors.where("cause <> 'OK'").select("approach", "cause", "layout", "field").groupingSets(sets, "approach", "cause", "layout", "field").agg(
        F.count("*").alias("n"), by.alias("by"))
