"""Readers with declared schemas: manifests, documents, gold, silver, prediction caches, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<text:string,start:int,end:int,page:int,x0:double,y0:double,x1:double,y1:double>"
SERVICE = "array<struct<procedure_code:string,description:string,date_of_service:string,units:string,charge:string,paid:string>>"
DOCUMENT = f"doc_id string, text string, words array<{WORD}>, page_count int, condition string, lang string, source_path string"
MANIFEST = ("doc_id string, split string, doc_type string, template_id int, lang string, condition string, severity string, date_style string, money_style string, "
            f"truth map<string,string>, service_lines {SERVICE}, org_roles map<string,string>, pdf string, text string")
GOLD = ("doc_id string, doc_type string, fields map<string,string>, " f"service_lines {SERVICE}, org_roles map<string,string>, provenance string, template_id int, "
        "condition string, lang string, verified boolean, corrections array<string>, adjudicated_by string")
SILVER = ("doc_id string, split string, text string, labels map<string,array<int>>, doc_type string, doc_type_gold string, condition string, template_id int, lang string")


def manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One record a line; blank lines are skipped; the split filter reaches the scan."""
    df = spark.read.schema(MANIFEST).json(path)
    return df.where(F.col("split") == split) if split else df


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file, with the file's name as source_path where it has none."""
    df = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    return df.withColumn("source_path", F.coalesce("source_path", F.input_file_name()))


def gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path)


def silver(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Training examples; limit takes the first by doc_id."""
    df = spark.read.schema(SILVER).json(path)
    return df.orderBy("doc_id").limit(limit) if limit else df


def prediction_cache(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object keyed by doc_id -> (doc_id, answer) rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_id", "answer"))


def text_layer_words(pages: DataFrame) -> DataFrame:
    """Words of a text layer (doc_id, page, text, x0, y0, x1, y1) without blank ones, numbered in order."""
    return pages.where(F.trim("text") != "")


def recognised_words(pages: DataFrame, dpi: int = 200) -> DataFrame:
    """Words of an optical reader: blank and unsure (confidence below 0) ones go, pixels become points."""
    ok = pages.where((F.trim("text") != "") & (F.col("conf") >= 0))
    return ok.withColumns({c: F.col(c) * 72.0 / dpi for c in ("x0", "y0", "x1", "y1")})


def choose_layer(docs: DataFrame) -> DataFrame:
    """condition clean where the text layer has at least 40 characters, else scanned with the read text;
    the default id is the file's name without its ending. docs (path, layer_text, ocr_text)."""
    clean = F.length(F.trim(F.coalesce("layer_text", F.lit("")))) >= 40
    return docs.withColumns({"condition": F.when(clean, "clean").otherwise("scanned"), "text": F.when(clean, F.col("layer_text")).otherwise(F.col("ocr_text")),
                             "doc_id": F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)})


def binary_files(spark: SparkSession, path: str, reader) -> DataFrame:
    """PDF adapter: reader(path, bytes) -> list of (page, text, x0, y0, x1, y1), called on the executors.
    The box has no PDF library, so the function is the caller's."""
    import pandas as pd

    def run(batches):
        for b in batches:
            for p, c in zip(b.path, b.content, strict=True):
                yield pd.DataFrame([(p, *w) for w in reader(p, c)], columns=["path", "page", "text", "x0", "y0", "x1", "y1"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(
        run, "path string, page int, text string, x0 double, y0 double, x1 double, y1 double")
