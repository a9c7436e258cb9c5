"""Scoring: the table of outcomes (approach x document x expected field) and its aggregates.

Only sums leave a partition: each aggregate is algebraic, so partial sums combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import FIELDS_BY_DOCTYPE
from ..functions.normalize import appears_in_text, normalize_amount, normalize_code, normalize_date, normalize_field
from ..functions.text import compact, let, present, strip


def expected_fields(spark: SparkSession) -> DataFrame:
    """(doc_type, field): 63 rows."""
    return spark.createDataFrame([(t, f) for t, fs in FIELDS_BY_DOCTYPE.items() for f in sorted(fs)], "doc_type string, field string")


#: Columns that outcomes() makes; docs' own columns of these names give way.
MADE = ("approach", "field", "gold", "pred", "gold_present", "pred_present", "norm_gold", "norm_pred", "correct", "exact", "hallucinated", "tp", "fp", "fn", "tn", "golds")


def outcomes(runs: DataFrame, docs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The fact table. runs (approach, doc_id): documents an approach has finished; docs (doc_id, doc_type,
    text, slice columns); gold (doc_id, field, value); pred (approach, doc_id, field, value).

    All values of a document meet in one row of its text: texts cross one exchange, once, and the fact
    table stays partitioned by doc_id. Documents without a run, and empty tables, give no rows."""
    side = lambda df, approach, *what: df.select("doc_id", approach.alias("approach"), *(c.cast("string").alias(n) for n, c in zip(("field", "value"), what, strict=True)))
    none = F.lit(None).cast("string")
    values = (side(runs, F.col("approach"), none, none).unionByName(side(gold.where("field is not null"), none, F.col("field"), F.col("value")))
              .unionByName(side(pred.where("approach is not null and field is not null"), F.col("approach"), F.col("field"), F.col("value"))))
    met = values.groupBy("doc_id").agg(F.collect_list(F.struct("approach", "field", "value")).alias("_v"))  # as many as approaches x fields
    return outcomes_of_rows(docs.drop(*MADE).join(met, "doc_id"), "_v")


def outcomes_of_rows(docs: DataFrame, values: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """The fact table of documents that carry their values: an array of (approach, field, value), without an
    approach for gold, without a field for a run. Nothing is shuffled. fields: those to be scored, all if not given.

    The expected fields of the type are exploded, so fields absent on both sides have rows too; a document of a
    type without expected fields is scored on the fields of its gold. Of several values of one field one counts;
    a null or empty value is absent; a null text shows nothing. A gold value is normalised once for all approaches;
    golds has all of the document (field, ng)."""
    rows = docs.where("doc_id is not null").withColumnRenamed(values, "_v")
    gold_of = F.filter("_v", lambda x: x["approach"].isNull())
    wanted = lambda fs: [f for f in sorted(fs) if fields is None or f in fields]
    expected = F.create_map(*[c for t, fs in FIELDS_BY_DOCTYPE.items() for c in (F.lit(t), F.array(*[F.lit(f) for f in wanted(fs)]).cast("array<string>"))])
    known = F.array_distinct(F.transform(gold_of, lambda x: x["field"]))
    rows = rows.withColumns({
        "_gold": gold_of, "_compact": compact(F.col("text")), "_approach": F.array_distinct(F.transform(F.filter("_v", lambda x: x["field"].isNull()), lambda x: x["approach"])),
        "_field": F.coalesce(F.try_element_at(expected, F.col("doc_type")), known if fields is None else F.filter(known, lambda f: f.isin(list(fields))))})
    value = lambda c, f: F.try_element_at(F.filter(c, lambda x: x["field"] == f), F.lit(1))["value"]
    cell = lambda f: let(value("_gold", f), lambda v: F.struct(f.alias("field"), v.alias("gold"), F.when(present(v), normalize_field(f, v)).alias("norm_gold")))
    rows = rows.withColumn("_cell", F.transform("_field", cell)).drop("_field", "_gold")
    rows = rows.withColumn("golds", F.transform(F.filter("_cell", lambda x: x["norm_gold"].isNotNull()), lambda x: F.struct(x["field"].alias("field"), x["norm_gold"].alias("ng"))))
    # explode() would have sizes tested below the exchange, with all that the arrays are made of; outer does not
    rows = rows.withColumn("approach", F.explode_outer("_approach")).where("approach is not null").withColumn("_pred", F.filter("_v", lambda x: (x["approach"] == F.col("approach")) & x["field"].isNotNull()))
    rows = rows.drop("_v", "_approach").withColumn("_x", F.explode_outer("_cell")).where("_x is not null").drop("_cell")
    rows = rows.withColumns({k: F.col("_x")[k] for k in ("field", "gold", "norm_gold")}).drop("_x")
    rows = rows.withColumn("pred", value("_pred", F.col("field"))).drop("_pred")
    g, p = present(F.col("gold")), present(F.col("pred"))
    norm_pred = F.when(F.col("pred") == F.col("gold"), F.col("norm_gold")).otherwise(normalize_field(F.col("field"), F.col("pred")))
    rows = rows.withColumns({"gold_present": g, "pred_present": p, "norm_pred": F.when(p, norm_pred)})
    correct = F.coalesce(F.col("norm_gold") == F.col("norm_pred"), F.lit(False))
    rows = rows.withColumns({"correct": correct,
                             "exact": F.coalesce(g & p & (strip(F.col("gold")) == strip(F.col("pred"))), F.lit(False)),
                             "hallucinated": p & ~appears_in_text(F.col("pred"), F.col("text"), F.col("field"), F.col("_compact"))}).drop("_compact")
    tp = F.col("gold_present") & F.col("pred_present") & F.col("correct")
    # a wrong value counts against precision and against recall
    return rows.withColumns({"tp": tp.cast("int"), "fp": (F.col("pred_present") & ~tp).cast("int"), "fn": (F.col("gold_present") & ~tp).cast("int"),
                             "tn": (~F.col("gold_present") & ~F.col("pred_present")).cast("int")})


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf_columns(df: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy from sums tp, fp, fn, tn; 0 where undefined."""
    c = F.col
    df = df.withColumns({"precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")),
                         "accuracy": ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")), "support": c("tp") + c("fn")})
    return df.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def sums(*extra: Column) -> list[Column]:
    return [*(F.sum(k).cast("long").alias(k) for k in ("tp", "fp", "fn", "tn")), *extra]


def by_field(out: DataFrame) -> DataFrame:
    return prf_columns(out.groupBy("approach", "field").agg(*sums()))


def overall(out: DataFrame) -> DataFrame:
    """One row per approach: pooled counts and their ratios, macro F1, exact match, hallucination rate."""
    fields = by_field(out)
    macro = fields.groupBy("approach").agg(F.avg("f1").alias("macro_f1"))
    pooled = out.groupBy("approach").agg(
        *sums(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_field_decisions"), F.avg(F.col("exact").cast("int")).alias("exact_match_rate"),
              F.sum((F.col("hallucinated")).cast("int")).alias("h"), F.sum(F.col("pred_present").cast("int")).alias("p")))
    return prf_columns(pooled).withColumn("hallucination_rate", ratio(F.col("h"), F.col("p"))).drop("h", "p").join(macro, "approach")


def slices(out: DataFrame, keys: tuple[str, ...] = ("condition", "lang", "doc_type", "gold_source")) -> DataFrame:
    """(approach, slice, value) for every slice key in one pass of grouping sets."""
    filled = out.select("approach", *[F.coalesce(F.col(k), F.lit("?")).alias(k) for k in keys], "tp", "fp", "fn", "tn", "hallucinated", "pred_present")
    sets = [[F.col("approach"), F.col(k)] for k in keys]
    # a key that is grouped has grouping() 0; each set has exactly one
    name = F.coalesce(*[F.when(F.grouping(k) == 0, k) for k in keys])
    value = F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k)) for k in keys])
    grouped = filled.groupingSets(sets, "approach", *keys).agg(
        *sums(F.sum(F.col("hallucinated").cast("int")).alias("h"), F.sum(F.col("pred_present").cast("int")).alias("p"), name.alias("slice"), value.alias("value")))
    return prf_columns(grouped).withColumn("hallucination_rate", ratio(F.col("h"), F.col("p"))).drop("h", "p", *keys)


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, pred, n) over all pairs of labels that occur on either side, with explicit zeros. pairs (gold, pred)."""
    counts = pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    labels = counts.select(F.col("gold").alias("label")).union(counts.select("pred")).distinct()  # as many as there are classes
    grid = labels.select(F.col("label").alias("gold")).join(F.broadcast(labels.select(F.col("label").alias("pred"))))
    return grid.join(counts, ["gold", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """precision, recall, f1, support of each label, from one pass over the pairs."""
    counts = pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    none, same = F.lit(0).cast("long"), F.col("gold").eqNullSafe(F.col("pred"))
    sides = F.array(F.struct(F.col("gold").alias("label"), F.when(same, F.col("n")).otherwise(none).alias("tp"), F.col("n").alias("g"), none.alias("p")),
                    F.struct(F.col("pred").alias("label"), none.alias("tp"), none.alias("g"), F.col("n").alias("p")))
    out = counts.select(F.explode(sides).alias("s")).select("s.*").where("label is not null").groupBy("label").agg(*[F.sum(k).alias(k) for k in ("tp", "g", "p")])
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("p")), "recall": ratio(F.col("tp"), F.col("g"))})
    return out.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
                      F.col("g").cast("long").alias("support"))


def doctype_summary(pairs: DataFrame) -> DataFrame:
    """accuracy, macro F1 over classes that occur in gold, n."""
    classes = class_metrics(pairs).where("support > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    hits = pairs.agg(F.coalesce(F.avg((F.col("gold") == F.col("pred")).cast("int")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))
    return hits.join(F.broadcast(classes))


def service_lines(lines: DataFrame) -> DataFrame:
    """tp, fp, fn and ratios over all documents. lines (side gold|pred, doc_id, procedure_code,
    date_of_service, charge); equal normalised rows match as a multiset, nulls equal nulls."""
    keyed = lines.select("doc_id", "side", normalize_code(F.col("procedure_code")).alias("c"), normalize_date(F.col("date_of_service")).alias("d"),
                         normalize_amount(F.col("charge")).alias("a"))
    n = keyed.groupBy("doc_id", "c", "d", "a").agg(F.count_if(F.col("side") == "gold").alias("g"), F.count_if(F.col("side") == "pred").alias("p"))
    hit = F.least("g", "p")
    return prf_columns(n.agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"),
                             F.lit(0).cast("long").alias("tn"))).select("tp", "fp", "fn", "precision", "recall", "f1")


def latency_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """p50 (mean of the middle two) and p95 (value number min(n - 1, int(0.95 n)) from 0) by key."""
    w = Window.partitionBy(key).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 95 / 100))
    return ranked.groupBy(key).agg(F.median(value).alias("p50"), F.max(F.when(F.col("i") == at, F.col(value))).alias("p95"), F.count("*").alias("n"))


def top_fields(errors: DataFrame, k: int = 6) -> DataFrame:
    """The k most frequent fields of each approach; ties: the one seen first (column seq)."""
    n = errors.groupBy("approach", "field").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy("approach").orderBy(F.desc("n"), "first")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


def mean_cost(calls: DataFrame, usd_in: float, usd_out: float) -> DataFrame:
    """Mean cost of a call from its prompt and completion tokens, in USD per million."""
    return calls.agg(F.avg(F.coalesce("prompt_tokens", F.lit(0)) / 1e6 * usd_in + F.coalesce("completion_tokens", F.lit(0)) / 1e6 * usd_out).alias("mean_cost"))


def rare_classes(df: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Classes with too few rows for a three-fold fit."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") < least)
