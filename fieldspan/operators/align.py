"""Values aligned to character spans: exact, white space, compact, fuzzy; overlaps; BIO tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FUZZY_THRESHOLD
from ..functions.text import compact, let, squash

SPAN = "struct<start:int,end:int,method:string,score:double,occurrences:int>"
RANK = {"exact": 4, "whitespace": 3, "compact": 2, "fuzzy": 1}


def _span(start: Column, end: Column, method: str, n: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(method).alias("method"), F.lit(100.0).alias("score"),
                    n.cast("int").alias("occurrences"))


def exact(text: Column, value: Column) -> Column:
    at = F.instr(text, value)
    n = (F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)
    return F.when(at > 0, _span(at - 1, at - 1 + F.length(value), "exact", n))


def white_space(text: Column, value: Column) -> Column:
    """The value's words parted by any white space, in any case."""
    tokens = F.split(squash(value), " ")
    pattern = F.concat(F.lit(r"(?iu)\Q"), F.array_join(F.transform(tokens, lambda t: F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q"))), r"\E\s+\Q"), F.lit(r"\E"))
    at = F.regexp_instr(text, pattern)
    return F.when((squash(value) != "") & (at > 0), _span(at - 1, at - 1 + F.length(F.regexp_substr(text, pattern)), "whitespace", F.regexp_count(text, pattern)))


def compact_characters(text: Column) -> Column:
    """The letters and digits of the folded text as (i, c); i is the place of the character of the text that
    c comes from, so one that folds into several gives its place to each of them."""
    pieces = F.transform(F.split(text, ""), lambda ch, i: F.transform(F.split(compact(ch), ""), lambda c: F.struct(i.alias("i"), c.alias("c"))))
    return F.filter(F.flatten(pieces), lambda s: s["c"] != "")


def _joined(chars: Column) -> Column:
    return F.array_join(F.transform(chars, lambda s: s["c"]), "")


def compact_match(text: Column, value: Column) -> Column:
    """Letters and digits alone, folded; offsets are those of the characters themselves."""
    def of(x):
        hay, needle = x["hay"], x["needle"]
        at = F.instr(hay, needle)
        n = (F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)
        first, last = (F.try_element_at(x["chars"], k)["i"] for k in (at, at + F.length(needle) - 1))
        return F.when((needle != "") & (at > 0), _span(first, last + 1, "compact", n))

    return let(let(compact_characters(text), lambda c: F.struct(c.alias("chars"), _joined(c).alias("hay"), compact(value).alias("needle"))), of)


def fuzzy_match(text: Column, value: Column) -> Column:
    """The window of the compacted text closest to a value of at least four letters or digits.

    A window scores 100 * (1 - edit distance / the longer length) and must reach the threshold, which
    leaves few edits: the value is cut into one run more than these, so one run stands in the text as it
    is, and only windows around such places are measured. Of equal scores the first, then the shorter one."""
    loss = 1 - FUZZY_THRESHOLD / 100

    def of(x):
        hay, needle, n = x["hay"], x["needle"], F.length(x["needle"])
        edits = F.ceil(n * F.lit(loss)).cast("int")
        cut = lambda r: F.floor(r * n / (edits + 1)).cast("int")  # noqa: E731  where run r begins
        seeds = F.flatten(F.transform(F.sequence(F.lit(0), edits), lambda r: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(hay))), lambda at: F.substring(hay, at, cut(r + 1) - cut(r)) == F.substring(needle, cut(r) + 1, cut(r + 1) - cut(r))),
            lambda at: at - cut(r))))
        around = F.array_distinct(F.flatten(F.transform(seeds, lambda at: F.sequence(at - edits, at + edits))))
        around = F.filter(around, lambda at: (at >= 1) & (at <= F.length(hay)))
        sizes = F.sequence(F.greatest(F.lit(1), n - edits), n + edits)
        windows = F.flatten(F.transform(around, lambda at: F.transform(F.filter(sizes, lambda w: at + w - 1 <= F.length(hay)), lambda w: F.struct(
            (F.lit(-100.0) * (1 - F.levenshtein(needle, F.substring(hay, at, w)) / F.greatest(n, w))).alias("k"), at.alias("at"), w.alias("w")))))
        best = F.array_min(windows)
        place = lambda k: F.try_element_at(x["chars"], k)["i"]
        return F.when(n >= 4, let(best, lambda b: F.when(b["k"] <= -FUZZY_THRESHOLD, F.struct(
            place(b["at"]).cast("int").alias("start"), (place(b["at"] + b["w"] - 1) + 1).cast("int").alias("end"), F.lit("fuzzy").alias("method"),
            (-b["k"]).alias("score"), F.lit(1).alias("occurrences")))))

    return let(let(compact_characters(text), lambda c: F.struct(c.alias("chars"), _joined(c).alias("hay"), compact(value).alias("needle"))), of)


def find_spans(values: DataFrame, text: str = "text", value: str = "value", fuzzy: bool = True) -> DataFrame:
    """values with start, end, method, score, occurrences (columns of these names give way). All rungs run
    in the JVM, cheapest first, each on rows that none before it has found. Null or empty values and texts
    have method none; an empty table gives no rows; repeated rows are rows of their own."""
    t, v = F.col(text), F.col(value)
    ok = (F.length(v) > 0) & (F.length(t) > 0)
    own = ("start", "end", "method", "score", "occurrences")
    found = values.drop(*own).withColumn("_s", F.when(ok, exact(t, v)))
    for rung in (white_space, compact_match, *([fuzzy_match] if fuzzy else [])):
        found = found.withColumn("_s", F.when(F.col("_s").isNull() & ok, rung(t, v)).otherwise(F.col("_s")))
    none = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("none").alias("method"), F.lit(0.0).alias("score"),
                    F.lit(0).alias("occurrences"))
    return found.withColumn("_s", F.coalesce("_s", none)).select(*[c for c in values.columns if c not in own], "_s.*")


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """Of spans of a document that share characters the better stays: method, score, length, then the
    order of seq; the others keep their row with method `overlap`. A fold over a document's few spans."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("method")), F.lit(0))
    item = F.struct((-rank).alias("r"), (-F.col("score")).alias("s"), (F.col("start") - F.col("end")).alias("l"), "seq", "start", "end")
    per = spans.where("start is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = F.aggregate("items", F.expr("cast(array() as array<struct<start:int,end:int,seq:bigint>>)"), lambda acc, x: F.when(
        F.exists(acc, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"])), acc).otherwise(
        F.concat(acc, F.array(F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["seq"].cast("bigint").alias("seq"))))))
    winners = per.select("doc_id", F.explode(kept).alias("k")).select("doc_id", F.col("k.seq").alias("seq"), F.lit(True).alias("won"))
    out = spans.join(winners, ["doc_id", "seq"], "left")
    lost = F.col("start").isNotNull() & F.col("won").isNull()
    return out.withColumns({"method": F.when(lost, "overlap").otherwise(F.col("method")), "start": F.when(~lost, F.col("start")),
                            "end": F.when(~lost, F.col("end"))}).drop("won")


def alignment_report(aligned: DataFrame, *by: str) -> DataFrame:
    """total, aligned, rate, ambiguous by any key; the sums of two reports add up."""
    return aligned.groupBy(*by).agg(F.count("*").alias("total"), F.count("start").alias("aligned"), F.count_if(F.col("occurrences") > 1).alias("ambiguous")).withColumn(
        "rate", F.coalesce(F.try_divide("aligned", "total"), F.lit(0.0)))


def spans_to_bio(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, start, end) with label O, B-field or I-field. (0, 0) marks a special token; of
    several spans on a token the one that starts last counts."""
    t, s = tokens.alias("t"), spans.where("start is not null").alias("s")
    hit = t.join(s, (F.col("t.doc_id") == F.col("s.doc_id")) & (F.col("t.start") < F.col("s.end")) & (F.col("s.start") < F.col("t.end"))
                 & ~((F.col("t.start") == 0) & (F.col("t.end") == 0)), "left").select("t.doc_id", "t.pos", F.col("t.start").alias("start"), F.col("t.end").alias("end"),
                                                                                     "s.field", F.col("s.start").alias("at"))
    first = F.row_number().over(Window.partitionBy("doc_id", "field", "at").orderBy("pos")) == 1
    last = Window.partitionBy("doc_id", "pos").orderBy(F.desc_nulls_last("at"), F.desc("field"))
    hit = hit.withColumn("tag", F.when(F.col("field").isNull(), "O").otherwise(F.concat(F.when(first, "B-").otherwise("I-"), "field")))
    return hit.withColumn("k", F.row_number().over(last)).where("k = 1").select("doc_id", "pos", "start", "end", F.col("tag").alias("label"))


def bio_to_spans(tagged: DataFrame) -> DataFrame:
    """(doc_id, field, start, end, seq) of runs of tags: a B, or an I of another field than before, opens one."""
    real = tagged.where("not (start = 0 and end = 0)")
    w = Window.partitionBy("doc_id").orderBy("pos")
    field = F.when(F.col("label") != "O", F.substring("label", 3, 1000))
    real = real.withColumn("field", field)
    opens = F.col("field").isNotNull() & (F.col("label").startswith("B-") | ~F.col("field").eqNullSafe(F.lag("field").over(w)))
    real = real.withColumn("run", F.sum(opens.cast("int")).over(w)).where("field is not null")
    return real.groupBy("doc_id", "run", "field").agg(F.min("start").alias("start"), F.max("end").alias("end")).where("end > start").withColumnRenamed("run", "seq")


def merge_windows(predictions: DataFrame) -> DataFrame:
    """Token predictions of overlapping windows (doc_id, window, start, end, label, confidence): at each
    start the most confident one, of equals the earliest window."""
    real = predictions.where("not (start = 0 and end = 0)")
    best = F.max_by(F.struct("end", "label", "confidence"), F.struct("confidence", -F.col("window")))
    out = real.groupBy("doc_id", "start").agg(best.alias("b")).select("doc_id", "start", "b.*")
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")))


def best_values(spans: DataFrame, first_kinds: tuple[str, ...]) -> DataFrame:
    """One value per document and field: the first for dates and amounts, else the longest, the first of
    equals. spans (doc_id, field, value, seq); first_kinds: the fields whose first mention counts."""
    length = F.when(F.col("field").isin(list(first_kinds)), 0).otherwise(-F.length("value"))
    w = Window.partitionBy("doc_id", "field").orderBy(length, "seq")
    return spans.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def zip_service_lines(spans: DataFrame) -> DataFrame:
    """The i-th procedure code with the i-th date and the i-th charge, null behind the shorter list's end."""
    w = Window.partitionBy("doc_id", "field").orderBy("seq")
    n = spans.withColumn("line_no", F.row_number().over(w))
    side = lambda f, name: n.where(F.col("field") == f).select("doc_id", "line_no", F.col("value").alias(name))
    return (side("procedure_code", "procedure_code").join(side("date_of_service", "date_of_service"), ["doc_id", "line_no"], "left")
            .join(side("total_charge", "charge"), ["doc_id", "line_no"], "left"))
