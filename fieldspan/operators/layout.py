"""Page layout: words with boxes become lines and text; text becomes lines of words with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "struct<text:string,start:int,end:int,x0:double,x1:double>"
LINE_GAP, SPACE, COLUMN_GAP, MAX_GAP = 0.6, 0.30, 2.2, 10


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted array: for even n the larger of the middle two."""
    s = F.array_sort(values)
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def group_into_lines(boxes: DataFrame, tolerance: float | None = None) -> DataFrame:
    """boxes (doc_id, pos, text, page, x0, y0, x1, y1) with line_idx and place (order on the line).

    A word joins the current line if it is on its page and its centre is within the tolerance of the mean
    centre of the words so far; the mean moves with each word, so the line numbers come from a fold over
    the sorted array of a document's words. Equal places keep the order of pos."""
    item = F.struct("page", ((F.col("y0") + F.col("y1")) / 2).alias("mid"), "x0", "pos", F.struct(*boxes.columns).alias("box"))
    docs = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"), upper_median(F.collect_list(F.col("y1") - F.col("y0"))).alias("h"))
    usual = F.greatest(F.lit(3.0), F.when(F.col("h") != 0, F.col("h")).otherwise(8.0) * LINE_GAP)
    docs = docs.withColumn("reach", usual if tolerance is None else F.lit(float(tolerance)))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        stays = F.coalesce((last["page"] == x["page"]) & (F.abs(x["mid"] - last["sum"] / last["n"]) <= F.col("reach")), F.lit(False))
        return F.concat(acc, F.array(F.struct(
            F.when(stays, last["line"]).otherwise(F.coalesce(last["line"] + 1, F.lit(0))).alias("line"), F.when(stays, last["sum"] + x["mid"]).otherwise(x["mid"]).alias("sum"),
            F.when(stays, last["n"] + 1).otherwise(1).alias("n"), x["page"].cast("long").alias("page"))))

    lines = F.aggregate("items", F.expr("cast(array() as array<struct<line:int,sum:double,n:int,page:bigint>>)"), step)
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip("items", lines.alias("lines"))).alias("seq", "z")).select("doc_id", "seq", "z.items.box", F.col("z.lines.line").cast("long").alias("line_idx"))
    across = Window.partitionBy("doc_id", "line_idx").orderBy("box.x0", "seq")
    return rows.withColumn("place", F.row_number().over(across).cast("long") - 1).select("box.*", "line_idx", "place")


def assemble(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts (doc_id, text), words with start and end) of boxes with line_idx and place.

    Lines are parted by a newline, words by a space, or by a run of spaces where the gap is as wide as a
    column break; the offsets satisfy substring(text, start, end) = word by construction."""
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("line_idx", "place")
    height = upper_median(F.collect_list(F.col("y1") - F.col("y0")).over(doc))
    space = F.greatest(F.lit(2.0), height * SPACE)
    gap = F.col("x0") - F.lag("x1").over(order)
    n = F.least(F.lit(MAX_GAP), F.greatest(F.lit(2), F.rint(gap / F.col("space")).cast("int")))
    sep = (F.when(F.lag("line_idx").over(order).isNull(), "").when(F.lag("line_idx").over(order) != F.col("line_idx"), "\n")
           .when(gap > F.col("space") * COLUMN_GAP, F.repeat(F.lit(" "), n)).otherwise(" "))
    w = boxes.withColumn("space", space).withColumn("sep", sep)
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("end", F.sum(F.length("sep") + F.length("text")).over(before).cast("int")).withColumn("start", F.col("end") - F.length("text"))
    parts = F.array_sort(F.collect_list(F.struct("line_idx", "place", F.concat("sep", "text").alias("t"))))
    texts = w.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))
    return texts, w.drop("space", "sep")


def words_of(text: Column, width: float = 6.0) -> Column:
    """Array of lines of a text: (no, text, start, end, words) for lines that are not blank; words carry
    offsets in the text and, at a fixed advance width, horizontal extents."""
    lines = F.split(text, "\n", -1)
    sized = F.transform(lines, lambda t, i: F.struct(t.alias("text"), i.alias("no")))
    # the start of a line: lengths of the lines before it, and their newlines
    start = F.aggregate(sized, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<no:int,text:string,start:int,end:int>>)").alias("out")),
                        lambda acc, x: F.struct((acc["at"] + F.length(x["text"]) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(
                            x["no"].alias("no"), x["text"].alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(x["text"])).alias("end")))).alias("out")),
                        lambda acc: acc["out"])

    def with_words(x):
        tokens = F.regexp_extract_all(x["text"], F.lit(r"(\s*\S+)"))
        ends = F.aggregate(tokens, F.expr(f"cast(array() as array<{WORD}>)"), lambda acc, t: F.concat(acc, F.array(_word(acc, t, x["start"], width))))
        return F.struct(x["no"].alias("no"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), ends.alias("words"))

    return F.transform(F.filter(start, lambda x: F.trim(F.regexp_replace(x["text"], r"\s", " ")) != ""), with_words)


def _word(acc: Column, token: Column, line_start: Column, width: float) -> Column:
    at = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], line_start)
    word = F.regexp_replace(token, r"^\s+", "")
    start = at + F.length(token) - F.length(word)
    end = at + F.length(token)
    return F.struct(word.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"),
                    ((start - line_start) * width).cast("double").alias("x0"), ((end - line_start) * width).cast("double").alias("x1"))


def line_starts(text: Column) -> Column:
    """Offsets of all lines."""
    return F.aggregate(F.split(text, "\n", -1), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("o")),
                       lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["o"], F.array(acc["at"])).alias("o")), lambda acc: acc["o"])


def words_in_lines(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words with the line that contains them: (doc_id, start, end) by interval, keyed by document."""
    w, l = words.alias("w"), lines.alias("l")  # noqa: E741
    return w.join(l, (F.col("w.doc_id") == F.col("l.doc_id")) & (F.col("w.start") >= F.col("l.start")) & (F.col("w.end") <= F.col("l.end")), "left").select(
        "w.*", F.col("l.no").alias("line_no"))
