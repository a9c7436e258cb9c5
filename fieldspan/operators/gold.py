"""Gold sets: where a record's truth comes from, adjudication, review tiers, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present, present_in


def load_gold(manifest: DataFrame, verified: DataFrame | None) -> DataFrame:
    """manifest with the verified fields and service lines where there are any (whole maps, not single
    keys), gold_source and corrections. verified (doc_id, fields, service_lines, verified, adjudicated_by,
    corrections)."""
    if verified is None:
        return manifest.withColumns({"gold_source": F.lit("generator_truth"), "corrections": F.expr("cast(null as array<string>)")})
    v = verified.select("doc_id", F.col("fields").alias("_f"), F.col("service_lines").alias("_l"), F.col("verified").alias("_v"),
                        F.col("adjudicated_by").alias("_a"), "corrections", F.lit(True).alias("_m"))
    out = manifest.join(v, "doc_id", "left")
    source = (F.when(F.col("_m").isNull(), "generator_truth").when(F.coalesce("_v", F.lit(False)), "human_verified")
              .when(present(F.col("_a")), F.concat("_a", F.lit("_adjudicated"))).otherwise("auto_verified_only"))
    return out.withColumns({"truth": F.coalesce("_f", "truth"), "service_lines": F.coalesce("_l", "service_lines"), "gold_source": source}).drop(
        "_f", "_l", "_v", "_a", "_m")


def adjudicate(gold: DataFrame, decisions: DataFrame) -> DataFrame:
    """gold (doc_id, field, value) with decisions (doc_id, field, decision): keep, unreadable (no value) or
    the new value; outcome tells which."""
    out = gold.join(F.broadcast(decisions) if decisions.isLocal() else decisions, ["doc_id", "field"], "left")
    outcome = (F.when(F.col("decision").isNull(), "untouched").when(F.col("decision") == "keep", "kept")
               .when(F.col("decision") == "unreadable", "unreadable").otherwise("replaced"))
    value = F.when(outcome == "replaced", F.col("decision")).when(outcome != "unreadable", F.col("value"))
    return out.withColumns({"outcome": outcome, "value": value}).drop("decision")


def review_tiers(gold: DataFrame) -> DataFrame:
    """gold (doc_id, field, value, text) with tier: auto if the value stands in the text, else flagged."""
    return gold.where(present(F.col("value"))).withColumn("tier", F.when(present_in(F.col("text"), F.col("value")), "auto").otherwise("flagged"))


def review_summary(tiers: DataFrame, adjudicated: DataFrame) -> DataFrame:
    t = tiers.agg(F.count("*").alias("fields_total"), F.count_if(F.col("tier") == "auto").alias("auto_verified"),
                  F.count_if(F.col("tier") == "flagged").alias("flagged"), F.count_distinct("doc_id").alias("n_documents"))
    a = adjudicated.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("kept", "replaced", "unreadable")])
    return t.join(F.broadcast(a)).withColumn("correction_rate", F.coalesce(F.try_divide("replaced", "fields_total"), F.lit(0.0)))


def excluded_but_there(manifest_long: DataFrame, gold_long: DataFrame, spans: DataFrame) -> DataFrame:
    """Fields whose gold is empty although the generator's value was located: (doc_id, field, value, method)."""
    empty = gold_long.where(~present(F.col("value"))).select("doc_id", "field")
    found = spans.where(F.col("start").isNotNull()).select("doc_id", "field", "method")
    return manifest_long.where(present(F.col("value"))).join(empty, ["doc_id", "field"]).join(found, ["doc_id", "field"])


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """upsert by approach; refuses reports of different splits."""
    splits = old.select("split").union(new.select("split")).distinct()
    if splits.limit(2).count() > 1:
        raise ValueError("the reports are of different splits")
    return upsert(old, new, "approach")


def missing(texts: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without an annotation yet: also the resume of a result cache."""
    return texts.join(done.select(key).distinct(), key, "left_anti")


def leaks(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; no leak gives no rows."""
    return train.select(key).intersect(test.select(key))


def teacher_quality(truth: DataFrame, silver: DataFrame) -> DataFrame:
    """Accuracy of the labels of a teacher by field. truth, silver (doc_id, field, value)."""
    from ..functions.normalize import values_match

    both = truth.join(silver.withColumnRenamed("value", "label"), ["doc_id", "field"], "left")
    ok = values_match(F.col("field"), F.col("value"), F.col("label"))
    return both.groupBy("field").agg(F.count("*").alias("total"), F.count_if(ok).alias("correct")).withColumn("accuracy", F.try_divide("correct", "total"))


def marked(text: Column, start: Column, end: Column, width: int = 90) -> Column:
    """Snippet of the text with the span between >>> and <<<, newlines as bars."""
    lo = F.greatest(F.lit(0), start - width)
    s = F.concat(F.substring(text, lo + 1, start - lo), F.lit(">>>"), F.substring(text, start + 1, end - start), F.lit("<<<"), F.substring(text, end + 1, F.lit(width)))
    return F.replace(s, F.lit("\n"), F.lit(" | "))


def best_guess_region(text: Column, value: Column, width: int = 110) -> Column:
    """Marked snippet around the longest prefix or suffix (at least four letters or digits) of the value
    that the text still shows, whatever stands between its characters."""
    def find(bare):
        sizes = F.sequence(F.length(bare), F.lit(4), F.lit(-1))
        parts = F.flatten(F.transform(sizes, lambda n: F.array(F.left(bare, n), F.right(bare, n))))
        patterns = F.transform(parts, lambda x: F.concat(F.lit("(?i)"), F.array_join(F.filter(F.split(x, ""), lambda c: c != ""), r"\W*")))
        hit = F.try_element_at(F.filter(patterns, lambda p: F.regexp_instr(text, p) > 0), F.lit(1))

        def show(p):
            at = F.regexp_instr(text, p) - 1
            return marked(text, at, at + F.length(F.regexp_substr(text, p)), width // 2)

        return F.when(F.length(bare) >= 4, F.element_at(F.transform(F.array(hit), lambda p: F.when(p.isNotNull(), show(p))), 1))

    return F.element_at(F.transform(F.array(F.regexp_replace(value, "[^A-Za-z0-9]", "")), find), 1)
