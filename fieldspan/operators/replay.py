"""Language-model responses as a table: prompts out, JSON answers in, costs; no network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CHARS_PER_TOKEN, DOC_TYPES, FIELD_KINDS, USD_PER_MTOK_INPUT, USD_PER_MTOK_OUTPUT
from .number import number_rows

LINE = T.StructType([T.StructField(k, T.StringType()) for k in ("procedure_code", "date_of_service", "units", "charge", "paid")])


def answer_schema() -> T.StructType:
    """Every key of an answer: the type, all fields, the service lines."""
    return T.StructType([T.StructField("document_type", T.StringType()), *[T.StructField(f, T.StringType()) for f in FIELD_KINDS],
                         T.StructField("service_lines", T.ArrayType(LINE)), T.StructField("org_roles", T.MapType(T.StringType(), T.StringType())),
                         T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()), T.StructField("latency_ms", T.DoubleType())])


def json_schema() -> dict:
    """The same for a constrained decoder: all keys required, so that absence is said explicitly."""
    text = {"type": ["string", "null"]}
    line = {f.name: text for f in LINE.fields}
    return {"type": "object", "properties": {"document_type": {"type": "string", "enum": DOC_TYPES}, **{f: text for f in FIELD_KINDS},
                                             "service_lines": {"type": "array", "items": {"type": "object", "properties": line, "required": list(line)}}},
            "required": ["document_type", *FIELD_KINDS, "service_lines"]}


def clipped(text: Column, max_chars: int = 6000) -> Column:
    """Head and tail of a long text, for a prompt."""
    half = max_chars // 2
    return F.when(F.length(text) > max_chars, F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(half)))).otherwise(text)


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def cost(prompt: Column, completion: Column) -> Column:
    return F.coalesce(prompt, F.lit(0)) / 1e6 * USD_PER_MTOK_INPUT + F.coalesce(completion, F.lit(0)) / 1e6 * USD_PER_MTOK_OUTPUT


def parse(answers: DataFrame, column: str = "answer") -> DataFrame:
    """answers with a parsed struct; what is no JSON gives nulls."""
    return answers.withColumn("parsed", F.from_json(column, answer_schema(), {"mode": "PERMISSIVE"}))


def replay(docs: DataFrame, answers: DataFrame, mode: str = "parity") -> DataFrame:
    """(doc_id, doc_type, fields, service_lines, missing, cost). answers (doc_id, answer). A document
    without an answer has no fields; parity keeps its row, fixed leaves it out, since it was not run."""
    rows = docs.join(parse(answers), "doc_id", "left" if mode == "parity" else "inner")
    kind = F.trim(F.coalesce(F.col("parsed.document_type"), F.lit("")))
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.trim(F.col(f"parsed.{f}")).alias("value")) for f in FIELD_KINDS])
    fields = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))
    return rows.select("doc_id", F.when(kind.isin(DOC_TYPES), kind).otherwise("unknown").alias("doc_type"), fields.alias("fields"),
                       F.col("parsed.service_lines").alias("service_lines"), F.col("answer").isNull().alias("missing"),
                       cost(F.col("parsed.prompt_tokens"), F.col("parsed.completion_tokens")).alias("cost"))


def batches(docs: DataFrame, order: str = "doc_id", size: int = 15) -> DataFrame:
    """docs with batch_id: `size` consecutive documents each."""
    return number_rows(docs, order, name="_i").withColumn("batch_id", F.floor(F.col("_i") / size)).drop("_i")


def usage_estimate(docs: DataFrame, text: str = "text", completion: int = 400) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.sum(tokens(F.col(text))).alias("prompt_tokens"), F.sum(cost(tokens(F.col(text)), F.lit(completion))).alias("usd"))
