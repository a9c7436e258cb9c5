"""Synthetic documents as column expressions: every draw is a hash of the key and a salt, so any row can
be made anywhere, and two draws with different salts are independent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DOC_TYPES, LABELS, MONTHS_EN, MONTHS_ES, TEMPLATES
from ..functions.normalize import npi_check_digit

FIRST = ["Ann", "Ben", "Clara", "David", "Elena", "Frank", "Grace", "Henry"]
LAST = ["Adams", "Brown", "Castillo", "Davis", "Evans", "Flores", "Garcia", "Hughes", "Irwin", "Jones"]
CITIES = ["Cedar Park", "Lakeview", "Northgate", "Riverside", "Summit"]
FACILITIES = ["Imaging Center", "Medical Center", "Clinic", "Hospital"]
DATE_STYLES = ["mdy_slash", "iso", "dmy_mon", "month_name", "dot", "mdy_slash_short", "es_long"]
MONEY_STYLES = ["dollar_comma", "plain_comma", "dollar_plain", "usd_comma"]


def draw(key: Column, salt: str, n: int | Column) -> Column:
    """A number from 0 to n - 1: 32 bits of md5(key:salt) modulo n."""
    text = F.concat(key.cast("string"), F.lit(":" + salt)).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % (F.lit(n) if isinstance(n, int) else n)


def pick(key: Column, salt: str, pool: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (draw(key, salt, len(pool)) + 1).cast("int"))


def format_date(d: Column, style: Column) -> Column:
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS_EN]), F.month(d))
    es = F.element_at(F.array(*[F.lit(m) for m in MONTHS_ES]), F.month(d))
    day, year = F.day(d).cast("string"), F.year(d).cast("string")
    return (F.when(style == "iso", F.date_format(d, "yyyy-MM-dd")).when(style == "mdy_slash", F.date_format(d, "MM/dd/yyyy"))
            .when(style == "mdy_slash_short", F.concat_ws("/", F.month(d), day, F.substring(year, 3, 2))).when(style == "dot", F.date_format(d, "MM.dd.yyyy"))
            .when(style == "dmy_mon", F.concat_ws("-", F.date_format(d, "dd"), F.left(month, F.lit(3)), year))
            .when(style == "month_name", F.concat(month, F.lit(" "), day, F.lit(", "), year)).when(style == "es_long", F.concat_ws(" de ", day, es, year)))


def format_money(amount: Column, style: Column) -> Column:
    grouped = F.format_number(amount.cast("decimal(20,2)"), 2)
    plain = amount.cast("decimal(20,2)").cast("string")
    return (F.when(style == "dollar_comma", F.concat(F.lit("$"), grouped)).when(style == "plain_comma", grouped)
            .when(style == "dollar_plain", F.concat(F.lit("$"), plain)).when(style == "usd_comma", F.concat(F.lit("USD "), grouped)))


def digits(key: Column, salt: str, n: int) -> Column:
    return F.concat(*[draw(key, f"{salt}{i}", 10).cast("string") for i in range(n)])


def person(key: Column, salt: str) -> Column:
    return F.concat(pick(key, salt + "first", FIRST), F.lit(" "), pick(key, salt + "last", LAST))


def npi(key: Column, salt: str = "npi") -> Column:
    nine = digits(key, salt, 9)
    return F.concat(nine, npi_check_digit(nine).cast("string"))


def decoy_number(key: Column, salt: str = "decoy") -> Column:
    """Ten digits with a wrong check digit."""
    nine = digits(key, salt, 9)
    return F.concat(nine, ((npi_check_digit(nine) + 1 + draw(key, salt + "off", 9)) % 10).cast("string"))


def member_id(key: Column, salt: str = "member") -> Column:
    letter = lambda i: pick(key, f"{salt}l{i}", list("ABCDEFGHJKLMNPRSTUVWXYZ"))
    shape, d = draw(key, salt, 4), lambda n: digits(key, salt, n)
    return (F.when(shape == 0, F.concat(letter(0), letter(1), letter(2), d(9))).when(shape == 1, F.concat_ws("-", d(3), digits(key, salt + "b", 2), digits(key, salt + "c", 4)))
            .when(shape == 2, F.concat(letter(0), d(8), letter(1))).otherwise(d(11)))


def reference_number(key: Column, prefix: Column, salt: str = "ref") -> Column:
    return F.concat(prefix, F.when(draw(key, salt + "sep", 3) == 1, "").otherwise("-"), F.substring(digits(key, salt, 8), F.lit(1), (draw(key, salt + "n", 3) + 6).cast("int")))


def address(key: Column, salt: str = "addr") -> Column:
    return F.concat((draw(key, salt, 9800) + 100).cast("string"), F.lit(" "), pick(key, salt + "s", ["Main St", "Oak Ave", "Park Blvd"]), F.lit(", "), pick(key, salt + "c", CITIES))


def phone(key: Column, salt: str = "phone") -> Column:
    return F.concat(F.lit("("), (draw(key, salt, 790) + 200).cast("string"), F.lit(") "), (draw(key, salt + "b", 790) + 200).cast("string"), F.lit("-"),
                    (draw(key, salt + "c", 9000) + 1000).cast("string"))


def label_for(field: str, variant: Column) -> Column:
    labels = LABELS[field]
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (variant % len(labels) + 1).cast("int"))


def add_noise(text: Column, key: Column, per_mille: int = 20) -> Column:
    """Character damage as a scan would do it: look-alikes at places drawn by hash."""
    worse = F.translate(text, "0Ol1I5S8B", "O0I|l S5B")
    chars = F.transform(F.split(text, ""), lambda c, i: F.when(F.pmod(F.xxhash64(key, i), F.lit(1000)) < per_mille, F.substring(worse, i + 1, F.lit(1))).otherwise(c))
    return F.array_join(chars, "")


def corpus(spark: SparkSession, n: int, scanned_per_mille: int = 500, spanish_per_mille: int = 80) -> DataFrame:
    """n documents: manifest columns, truth map, text, all from the row number. Type, template, language,
    styles and condition are drawn independently."""
    k = F.col("id")
    df = spark.range(n).select(k, F.concat(F.lit("doc-"), F.lpad(k.cast("string"), 8, "0")).alias("doc_id"), pick(k, "type", DOC_TYPES).alias("doc_type"),
                               (draw(k, "template", len(TEMPLATES)) + 1).cast("int").alias("template_id"),
                               F.when(draw(k, "lang", 1000) < spanish_per_mille, "es").otherwise("en").alias("lang"),
                               F.when(draw(k, "scan", 1000) < scanned_per_mille, "scanned").otherwise("clean").alias("condition"),
                               pick(k, "date", DATE_STYLES).alias("date_style"), pick(k, "money", MONEY_STYLES).alias("money_style"),
                               F.date_add(F.lit("2025-01-01").cast("date"), draw(k, "day", 500).cast("int")).alias("day"))
    truth = {"patient_name": person(k, "p"), "referring_provider_npi": npi(k), "member_id": member_id(k), "document_reference": reference_number(k, F.lit("REF")),
             "document_date": format_date(F.col("day"), F.col("date_style")), "servicing_facility": F.concat(pick(k, "city", CITIES), F.lit(" "), pick(k, "fac", FACILITIES)),
             "total_charge": format_money((draw(k, "charge", 500000) + 1000) / 100, F.col("money_style"))}
    df = df.withColumns({f"t_{f}": c for f, c in truth.items()})
    layouts = F.create_map(*[x for t, (lay, _, v) in TEMPLATES.items() for x in (F.lit(t), F.struct(F.lit(lay).alias("layout"), F.lit(v).alias("v")))])
    df = df.withColumn("_t", F.element_at(layouts, F.col("template_id")))
    below = F.col("_t.layout").isin("below", "grid")
    lines = [F.concat(label_for(f, F.col("_t.v")), F.when(below, "\n").otherwise(": "), F.col(f"t_{f}")) for f in truth]
    decoy = F.concat(F.lit("Fax: "), decoy_number(k, "fax"), F.lit("  Account: "), decoy_number(k, "acct"), F.lit("  Tel: "), phone(k), F.lit("  "), address(k))
    text = F.concat_ws("\n", F.upper(F.replace(F.col("doc_type"), F.lit("_"), F.lit(" "))), *lines, decoy)
    df = df.withColumn("text", text).withColumn("text", F.when(F.col("condition") == "scanned", add_noise(F.col("text"), k)).otherwise(F.col("text")))
    split = F.when(F.col("template_id") > 10, "gold_synth").when(draw(k, "val", 6) == 0, "val").otherwise("train")
    return df.select("doc_id", split.alias("split"), "doc_type", "template_id", "lang", "condition", "date_style", "money_style", F.col("_t.layout").alias("layout"),
                     F.create_map(*[x for f in truth for x in (F.lit(f), F.col(f"t_{f}"))]).alias("truth"), "text")
