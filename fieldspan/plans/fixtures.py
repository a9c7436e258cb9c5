"""Rendered documents, gold values and two damaged systems made from the star schema, in Spark and in
DuckDB SQL. Each choice is drawn from md5(key:salt) with a salt of its own, so choices are independent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MONTHS_EN
from ..functions.text import let as once
from ..operators.generator import FIRST, LAST, draw, format_date, format_money, pick

FIELDS = ("patient_name", "document_reference", "document_date", "total_charge", "payer_name", "member_id")
TYPES = ["remittance_advice", "insurance_claim", "lab_order"]
TITLES = ["EXPLANATION OF BENEFITS", "HEALTH INSURANCE CLAIM FORM", "LABORATORY ORDER"]
DATES = ["mdy_slash", "iso", "dmy_mon", "month_name", "dot", "mdy_slash_short"]
MONEY = ["dollar_comma", "plain_comma", "dollar_plain", "usd_comma"]
SYSTEMS = ("a", "b")
INVENTED = {"patient_name": "Zed Nobody", "document_reference": "ZZZ-999", "document_date": "01/01/1901", "total_charge": "$9.99",
            "payer_name": "Nowhere Plan", "member_id": "QQQ-000"}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    """One document per order: doc_id, the six values, doc_type, shown_type, condition, lang, gold_source, text.
    The few columns a document is made of are dealt by its key, so the work on it does not depend on how the
    tables are split, and what is grouped by document later needs no exchange."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    d = o.join(c, o.o_custkey == c.c_custkey).repartition(n, "o_orderkey")
    d = d.select(
        k.alias("doc_id"), F.concat(pick(cust, "first", FIRST), F.lit(" "), pick(cust, "last", LAST)).alias("patient_name"),
        F.concat(F.lit("ORD-"), F.lpad(k.cast("string"), 7, "0")).alias("document_reference"),
        format_date(F.col("o_orderdate").cast("date"), pick(k, "date", DATES)).alias("document_date"),
        format_money(F.col("o_totalprice"), pick(k, "money", MONEY)).alias("total_charge"), F.col("c_mktsegment").alias("payer_name"),
        F.concat(F.lit("ABC"), F.lpad(cust.cast("string"), 9, "0")).alias("member_id"), pick(k, "type", TYPES).alias("doc_type"),
        F.when(draw(k, "title", 5) == 0, "PATIENT REFERRAL").otherwise(pick(k, "type", TITLES)).alias("title"),
        F.when(draw(k, "scan", 2) == 0, "scanned").otherwise("clean").alias("condition"), F.when(draw(k, "lang", 10) == 0, "es").otherwise("en").alias("lang"),
        F.when(draw(k, "source", 3) > 0, "generator_truth").alias("gold_source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
        F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("plain"))
    text = F.concat_ws("\n", "title", F.concat(F.lit("Patient Name: "), "patient_name", F.lit("    Reference #: "), "document_reference"),
                       F.concat(F.lit("Date: "), "document_date"), F.concat(F.lit("Total Charge: "), "total_charge"), F.concat(F.lit("Payer: "), "payer_name"),
                       F.concat(F.lit("Member ID: "), "member_id"))
    return d.withColumn("text", text)


def long_gold(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select("doc_id", *keep, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")).select(
        "doc_id", *keep, "x.field", "x.value")


def damaged(field: Column, value: Column, approach: Column) -> Column:
    again = F.when(field == "document_date", F.col("iso")).when(field == "total_charge", F.col("plain")).otherwise(F.upper(value))
    invented = F.element_at(F.create_map(*[F.lit(x) for kv in INVENTED.items() for x in kv]), field)
    return once(draw(F.concat(F.col("doc_id").cast("string"), field, approach), "damage", 10), lambda code: (
        F.when(code == 1, F.col("document_reference")).when(code == 2, again).when(code == 3, F.left(value, F.floor(F.length(value) / 2).cast("int")))
        .when(code == 4, invented).when(code > 4, value)))


def predictions(docs: DataFrame) -> DataFrame:
    """(approach, doc_id, field, value): gold with damage of ten kinds, drawn for each system."""
    rows = long_gold(docs, "document_reference", "iso", "plain").withColumn("approach", F.explode(F.array(*[F.lit(s) for s in SYSTEMS])))
    return rows.select("approach", "doc_id", "field", damaged(F.col("field"), F.col("value"), F.col("approach")).alias("value"))


def with_values(docs: DataFrame) -> DataFrame:
    """docs with values: runs, gold and predictions of each document in its own row, as (approach, field, value)."""
    none = F.lit(None).cast("string")
    one = lambda a, f, v: F.struct(a.alias("approach"), f.alias("field"), v.alias("value"))
    return docs.withColumn("values", F.array(*[one(F.lit(s), none, none) for s in SYSTEMS], *[one(none, F.lit(f), F.col(f)) for f in FIELDS],
                                             *[one(F.lit(s), F.lit(f), damaged(F.lit(f), F.col(f), F.lit(s))) for s in SYSTEMS for f in FIELDS]))


def runs(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array(*[F.lit(s) for s in SYSTEMS])).alias("approach"), "doc_id")


# ---- the same in DuckDB ---------------------------------------------------------------------------

_names = iter(range(10**9))


def let(value: str, body) -> str:
    """body(v) with v bound to value once."""
    v = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def h(key: str, salt: str, n: int) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT % {n})"


def arr(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def choose(key: str, salt: str, xs) -> str:
    return f"{arr(xs)}[{h(key, salt, len(xs))} + 1]"


def _date(d: str, style: str) -> str:
    forms = {"mdy_slash": f"strftime({d}, '%m/%d/%Y')", "iso": f"strftime({d}, '%Y-%m-%d')", "dmy_mon": f"strftime({d}, '%d-%b-%Y')",
             "month_name": f"strftime({d}, '%B ') || day({d}) || ', ' || year({d})", "dot": f"strftime({d}, '%m.%d.%Y')",
             "mdy_slash_short": f"month({d}) || '/' || day({d}) || '/' || substr(CAST(year({d}) AS VARCHAR), 3, 2)"}
    return "CASE " + style + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in forms.items()) + " END"


def _money(x: str, style: str) -> str:
    plain, grouped = f"CAST({x} AS VARCHAR)", f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"
    return f"CASE {style} WHEN 'dollar_comma' THEN '$' || {grouped} WHEN 'plain_comma' THEN {grouped} WHEN 'dollar_plain' THEN '$' || {plain} ELSE 'USD ' || {grouped} END"


RENDERED = f"""rendered0 AS (
  SELECT o_orderkey AS doc_id, {choose('o_custkey', 'first', FIRST)} || ' ' || {choose('o_custkey', 'last', LAST)} AS patient_name,
    'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS document_reference, {_date('o_orderdate', choose('o_orderkey', 'date', DATES))} AS document_date,
    {_money('CAST(o_totalprice AS DECIMAL(20,2))', choose('o_orderkey', 'money', MONEY))} AS total_charge, c_mktsegment AS payer_name,
    'ABC' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS member_id, {choose('o_orderkey', 'type', TYPES)} AS doc_type,
    CASE WHEN {h('o_orderkey', 'title', 5)} = 0 THEN 'PATIENT REFERRAL' ELSE {choose('o_orderkey', 'type', TITLES)} END AS title,
    CASE WHEN {h('o_orderkey', 'scan', 2)} = 0 THEN 'scanned' ELSE 'clean' END AS condition, CASE WHEN {h('o_orderkey', 'lang', 10)} = 0 THEN 'es' ELSE 'en' END AS lang,
    CASE WHEN {h('o_orderkey', 'source', 3)} > 0 THEN 'generator_truth' END AS gold_source, strftime(o_orderdate, '%Y-%m-%d') AS iso,
    CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) AS plain
  FROM orders JOIN customer ON o_custkey = c_custkey),
rendered AS (SELECT *, title || chr(10) || 'Patient Name: ' || patient_name || '    Reference #: ' || document_reference || chr(10) || 'Date: ' || document_date || chr(10)
    || 'Total Charge: ' || total_charge || chr(10) || 'Payer: ' || payer_name || chr(10) || 'Member ID: ' || member_id AS text FROM rendered0)"""
GOLD = "gold AS (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {f} AS value, document_reference AS ref, iso, plain FROM rendered" for f in FIELDS) + ")"
PRED = f"""pred0 AS (SELECT s.approach, g.*, {h("CAST(doc_id AS VARCHAR) || field || s.approach", 'damage', 10)} AS code
  FROM gold g, (SELECT unnest(['a', 'b']) AS approach) s),
pred AS (SELECT approach, doc_id, field, value AS gold, CASE WHEN code = 1 THEN ref
    WHEN code = 2 THEN CASE field WHEN 'document_date' THEN iso WHEN 'total_charge' THEN plain ELSE upper(value) END
    WHEN code = 3 THEN left(value, CAST(floor(length(value) / 2) AS INTEGER))
    WHEN code = 4 THEN CASE field {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in INVENTED.items())} END
    WHEN code > 4 THEN value END AS pred FROM pred0)"""
EXPECTED = "expected AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{f}')" for t, fs in (("remittance_advice", ("patient_name", "member_id", "payer_name", "document_reference", "document_date", "total_charge")),
                                    ("insurance_claim", ("patient_name", "payer_name", "member_id", "document_reference", "document_date", "total_charge")),
                                    ("lab_order", ("patient_name", "document_reference", "document_date"))) for f in fs) + ") t(doc_type, field))"


def d_squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def d_compact(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^a-z0-9]', '', 'g')"


def d_iso(y: str, m: str, d: str) -> str:
    iso = f"lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0')"
    return f"CASE WHEN {y} >= 1 AND try_cast({iso} AS DATE) IS NOT NULL THEN {iso} END"


def d_year(y: str) -> str:
    return f"CASE WHEN {y} >= 100 THEN {y} WHEN {y} <= 30 THEN 2000 + {y} ELSE 1900 + {y} END"


NUM = r"^(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{1,4})$"
MDY = r"^([a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{2,4})$"
DMY = r"^(\d{1,2})(?:st|nd|rd|th)?[\s\-]+(?:de\s+)?([a-z]+)\.?[\s\-,]+(?:de\s+)?(\d{2,4})$"


def d_date(x: str) -> str:
    """ISO date in DuckDB, for English month names and abbreviations."""
    months = arr([m.lower() for m in MONTHS_EN] + [m[:3].lower() for m in MONTHS_EN])

    def of(t):
        g = lambda p, i: f"try_cast(regexp_extract({t}, '{p}', {i}) AS INTEGER)"
        month = lambda p, i: f"(list_position({months}, regexp_extract({t}, '{p}', {i})) - 1) % 12 + 1"
        number = let(f"{{'a': {g(NUM, 1)}, 'b': {g(NUM, 2)}, 'y': {g(NUM, 3)}, 'n': length(regexp_extract({t}, '{NUM}', 1))}}", lambda v: let(d_year(f"{v}.y"), lambda y: (
            f"CASE WHEN {v}.n = 4 THEN {d_iso(f'{v}.a', f'{v}.b', f'{v}.y')} WHEN {v}.a > 12 THEN {d_iso(y, f'{v}.b', f'{v}.a')} ELSE {d_iso(y, f'{v}.a', f'{v}.b')} END")))
        named = lambda p, m, d: let(f"{{'m': {month(p, m)}, 'd': {g(p, d)}, 'y': {g(p, 3)}}}", lambda v: let(d_year(f"{v}.y"), lambda y: d_iso(y, f"{v}.m", f"{v}.d")))
        return f"CASE WHEN regexp_matches({t}, '{NUM}') THEN {number} WHEN regexp_matches({t}, '{MDY}') THEN {named(MDY, 1, 2)} WHEN regexp_matches({t}, '{DMY}') THEN {named(DMY, 2, 1)} END"

    t = rf"trim(lower({d_squash(f'strip_accents({x})')}), ' ,;:')"
    t = rf"regexp_replace({t}, '^[a-z .]{{1,30}}:\s*', '')"
    return let(rf"trim(regexp_replace({t}, '^(?:on|el|dated?|fecha|de)\s+', ''))", of)


def d_amount(x: str) -> str:
    words = r"(?i)\b(?:usd|us\$|dollars?|total|amount|monto|importe)\b"
    clean = lambda t: rf"regexp_replace(regexp_replace({t}, '{words}', ' ', 'g'), '[^\d,.\-]', '', 'g')"
    seps = lambda p: (f"CASE WHEN contains({p}, ',') AND contains({p}, '.') THEN CASE WHEN strpos(reverse({p}), ',') < strpos(reverse({p}), '.') "  # noqa: E731
                      f"THEN replace(replace({p}, '.', ''), ',', '.') ELSE replace({p}, ',', '') END "
                      rf"WHEN contains({p}, ',') THEN CASE WHEN regexp_matches({p}, ',\d{{2}}$') THEN replace({p}, ',', '.') ELSE replace({p}, ',', '') END ELSE {p} END")
    value = lambda u, t: (rf"CASE WHEN regexp_matches({u}, '^(\d+\.?\d*|\.\d+)$') THEN CAST(CASE WHEN (contains({t}, '(') AND contains({t}, ')')) OR starts_with({t}, '-') "  # noqa: E731
                          rf"THEN -round_even(CAST({u} AS DECIMAL(30,8)), 2) ELSE round_even(CAST({u} AS DECIMAL(30,8)), 2) END AS DECIMAL(30,2))::VARCHAR END")
    return let(d_squash(f"strip_accents({x})"), lambda t: let(let(clean(t), lambda p: rf"regexp_replace(regexp_replace({seps(p)}, '[^\d.\-]', '', 'g'), '^-+', '')"),
                                                              lambda u: value(u, t)))


def d_person(x: str) -> str:
    titles = r"(?i)\b(?:dr|doctor|mr|mrs|ms|miss|prof|sr|sra|srta)\b\.?"
    ends = r"(?i)\b(?:m\.?d|d\.?o|r\.?n|n\.?p|p\.?a[- ]?c|d\.?d\.?s|ph\.?d|f\.?a\.?c\.?p|jr|sr|ii|iii|iv|esq)\b\.?"
    r = lambda t, p: f"regexp_replace({t}, '{p}', ' ', 'g')"
    t = r(r(d_squash(f"strip_accents({x})"), titles), ends)
    t = r(r(f"replace({t}, '.', ' ')", ends), r"[^\w\s,''\-]")
    swap = lambda v: f"CASE WHEN contains({v}, ',') AND trim(substr({v}, strpos({v}, ',') + 1)) <> '' THEN substr({v}, strpos({v}, ',') + 1) || ' ' || left({v}, strpos({v}, ',') - 1) ELSE {v} END"
    return f"nullif(trim(lower({d_squash(let(t, swap))}), ' ,-'''), '')"


def d_org(x: str) -> str:
    legal = (r"(?i)\b(?:inc|llc|l\.l\.c|llp|ltd|limited|corp|corporation|co|company|pc|p\.c|pa|p\.a|plc|group|grp|assoc|associates|partners|holdings|sa|s\.a)\b\.?")
    r = lambda t, p: f"regexp_replace({t}, '{p}', ' ', 'g')"
    return f"nullif(trim(lower({d_squash(r(r(r(d_squash(f'strip_accents({x})'), legal), r'[^\w\s&\-]'), legal))}), ' -&'), '')"


def d_code(x: str) -> str:
    return f"nullif(upper(regexp_replace(strip_accents({x}), '[^A-Za-z0-9]', '', 'g')), '')"


def d_norm(field: str, x: str) -> str:
    return (f"CASE {field} WHEN 'patient_name' THEN {d_person(x)} WHEN 'document_date' THEN {d_date(x)} WHEN 'total_charge' THEN {d_amount(x)} "
            f"WHEN 'payer_name' THEN {d_org(x)} ELSE {d_code(x)} END")


def d_appears(value: str, text: str, field: str) -> str:
    days = rf"len(list_filter(regexp_extract_all({text}, '[0-9][0-9/\-.]{{4,12}}[0-9]'), lambda dd: {d_date('dd')} = {d_date(value)})) > 0"
    return f"({d_compact(value)} = '' OR contains({d_compact(text)}, {d_compact(value)}) OR ({field} = 'document_date' AND coalesce({days}, false)))"


OUT = f"""scored AS (
  SELECT p.approach, p.doc_id, p.field, nullif(p.gold, '') AS gold, nullif(p.pred, '') AS pred, r.doc_type, r.condition, r.lang, r.gold_source, r.text,
    {d_norm('p.field', 'p.gold')} AS ng, {d_norm('p.field', 'p.pred')} AS np
  FROM pred p JOIN rendered r USING (doc_id) JOIN expected e ON e.doc_type = r.doc_type AND e.field = p.field),
outcomes AS (SELECT *, CAST(gold IS NOT NULL AND pred IS NOT NULL AND coalesce(ng = np, false) AS INTEGER) AS tp,
    CAST(pred IS NOT NULL AND NOT (gold IS NOT NULL AND coalesce(ng = np, false)) AS INTEGER) AS fp,
    CAST(gold IS NOT NULL AND NOT (pred IS NOT NULL AND coalesce(ng = np, false)) AS INTEGER) AS fn, CAST(gold IS NULL AND pred IS NULL AS INTEGER) AS tn FROM scored)"""
OUTCOMES = "WITH " + ",\n".join((RENDERED, GOLD, PRED, EXPECTED, OUT))
PRF = """tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0) AS f1"""
SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn"
