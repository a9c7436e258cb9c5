"""Rule-based extraction as one narrow plan: everything happens inside a document's row.

Lines, label anchors, candidates and the choice among them are arrays of the row, so a document is never
shuffled. Fields are tried in canonical order; candidate scores are decimals, so ties are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AMOUNT, CPT_STRICT, DATE, DOCTYPE_WORDS, FIELD_KINDS, FIELDS_BY_DOCTYPE, ICD10, LABELS, MEMBER_ID, REFERENCE
from ..functions.normalize import is_valid_npi, normalize_amount, normalize_date
from ..functions.text import compact, fold, let, null_if_empty, squash, strip
from .layout import words_of

MAX_LABEL_WORDS, MAX_NAME = 4, 80
ANCHOR = "struct<fields:array<string>,start:int,end:int,x0:double,x1:double>"
I_DATE = "(?i)" + DATE


def label_keys() -> dict[str, list[str]]:
    """compacted label -> fields, by the same folding as the words of a page."""
    import re
    import unicodedata

    out: dict[str, list[str]] = {}
    for field, labels in LABELS.items():
        for label in labels:
            key = re.sub("[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c)).lower())
            if field not in out.setdefault(key, []):
                out[key].append(field)
    return out


def label_map() -> Column:
    return F.create_map(*[x for k, fs in sorted(label_keys().items()) for x in (F.lit(k), F.array(*[F.lit(f) for f in fs]))])


def is_label(key: Column) -> Column:
    return key.isin(sorted(label_keys()))


def may_begin_label(key: Column) -> Column:
    """key, the compacted first word of a run, can be that of a label."""
    return key.isin(sorted({label[:n] for label in label_keys() for n in range(len(label) + 1)}))


def label_length(keys: Column, i: Column) -> Column:
    """How many words from word i on make a label, at most four, the longest run; 0 if none. keys: compacted words,
    each folded once; those of a run joined are the run's."""
    found = None
    for n in range(MAX_LABEL_WORDS, 0, -1):
        hit = (i + (n - 1) <= F.size(keys)) & is_label(F.array_join(F.slice(keys, i, F.lit(n)), ""))
        found = F.when(hit, n) if found is None else found.when(hit, n)
    return F.when(may_begin_label(F.try_element_at(keys, i)), found.otherwise(0)).otherwise(0)


def anchors_of(words: Column) -> Column:
    """Labels on a line: from left to right the longest run of up to four words that is a label; its words
    are used up. One anchor names all fields that own the label."""
    def of(keys):
        def step(acc, i):
            def taken(n):
                first, last = F.try_element_at(words, i), F.try_element_at(words, i + n - 1)
                a = F.struct(F.try_element_at(label_map(), F.array_join(F.slice(keys, i, n), "")).alias("fields"), first["start"].alias("start"), last["end"].alias("end"),
                             first["x0"].alias("x0"), last["x1"].alias("x1"))
                return F.when(n > 0, F.struct((i + n).alias("next"), F.concat(acc["out"], F.array(a)).alias("out"))).otherwise(acc)
            return F.when(i < acc["next"], acc).otherwise(let(label_length(keys, i), taken))

        return F.aggregate(F.sequence(F.lit(1), F.size(keys)), start, step, lambda acc: acc["out"])

    start = F.struct(F.lit(0).alias("next"), F.expr(f"cast(array() as array<{ANCHOR}>)").alias("out"))
    return F.when(F.size(words) > 0, let(F.transform(words, lambda w: compact(w["text"])), of)).otherwise(F.expr(f"cast(array() as array<{ANCHOR}>)"))


def with_anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with lines: array of (no, text, start, end, words, anchors)."""
    out = docs.withColumn("lines", words_of(F.col(text)))
    return out.withColumn("lines", F.transform("lines", lambda x: F.struct(*[x[k].alias(k) for k in ("no", "text", "start", "end", "words")], anchors_of(x["words"]).alias("anchors"))))


def strip_lead(c: Column) -> Column:
    return F.regexp_replace(c, "^[ :.\\-–\t]+", "")


def value_right(line: Column, anchor: Column) -> Column:
    """Text from the anchor's end to the next anchor that begins behind it, or to the line's end."""
    stop = F.coalesce(F.array_min(F.transform(F.filter(line["anchors"], lambda a: a["start"] > anchor["end"]), lambda a: a["start"])), line["end"])
    raw = F.substring(line["text"], anchor["end"] - line["start"] + 1, stop - anchor["end"])
    return let(squash(strip_lead(raw)), null_if_empty)


def value_below(lines: Column, place: Column, anchor: Column) -> Column:
    """Words in the anchor's column on the first of the next two lines where there are any that are
    not themselves a label."""
    out = None
    for step in (1, 2):
        line = F.try_element_at(lines, place + 1 + step)
        picked = F.filter(line["words"], lambda w: (w["x1"] > anchor["x0"] - 4) & (w["x0"] < anchor["x1"] + 90))
        text = squash(F.array_join(F.transform(picked, lambda w: w["text"]), " "))
        good = let(let(text, lambda t: strip_lead(F.when((t != "") & ~is_label(compact(t)), t))), null_if_empty)
        out = good if out is None else F.coalesce(out, good)
    return out


def cut_at_label(value: Column) -> Column:
    """The value up to the first word at which a label begins."""
    def of(tokens):
        begins = lambda keys: F.try_element_at(F.filter(F.sequence(F.lit(1), F.size(keys)), lambda i: label_length(keys, i) > 0), F.lit(1))
        first = let(F.transform(tokens, compact), begins)
        return let(first, lambda i: F.when(i.isNull(), value).otherwise(strip(F.array_join(F.slice(tokens, F.lit(1), i - 1), " "), " :;,-")))

    return let(F.split(squash(value), " "), of)


def first_match(text: Column, pattern: str) -> Column:
    return let(F.regexp_extract(text, f"({pattern})", 1), null_if_empty)


def _npi(text: Column) -> Column:
    return let(F.regexp_extract_all(text, F.lit(r"\b(\d{10})\b")), lambda found: F.coalesce(
        F.try_element_at(F.filter(found, is_valid_npi), F.lit(1)), F.try_element_at(found, F.lit(1))))


def trim_candidate(field: str, value: Column) -> Column:
    """The part of a raw value that can be the field."""
    kind = FIELD_KINDS.get(field)

    def of(v):
        if kind == "date":
            return F.coalesce(first_match(v, I_DATE), F.when(normalize_date(v).isNotNull(), v))
        if kind == "amount":
            return strip(F.regexp_extract(v, f"({AMOUNT})", 1))
        if field == "referring_provider_npi":
            return _npi(v)
        if field in ("diagnosis_code", "procedure_code"):
            return F.regexp_extract(F.upper(v), rf"(\b{ICD10 if field == 'diagnosis_code' else CPT_STRICT}\b)", 1)
        return F.left(cut_at_label(v), F.lit(MAX_NAME))

    return let(let(strip(squash(value), " :;,-"), lambda v: F.when(v != "", of(v))), null_if_empty)


def type_score(field: str, value: Column) -> Column:
    """How well a value fits the field, in hundredths."""
    kind = FIELD_KINDS.get(field)
    if kind == "date":
        out = F.when(normalize_date(value).isNotNull(), 100).otherwise(0)
    elif kind == "amount":
        out = F.when(normalize_amount(value).isNotNull(), 100).otherwise(0)
    elif field == "referring_provider_npi":
        out = F.when(is_valid_npi(value), 100).otherwise(5)
    elif field in ("diagnosis_code", "procedure_code"):
        pattern = ICD10 if field == "diagnosis_code" else CPT_STRICT
        out = F.when(F.upper(strip(value)).rlike(f"^{pattern}$"), 100).otherwise(10)
    elif kind == "reference":
        out = F.when(value.rlike(r"\d") & (F.length(value) <= 24), 90).otherwise(20)
    else:
        words = F.filter(F.split(squash(value), " "), lambda w: w != "")
        if kind == "person":
            out = let(words, lambda w: F.when((F.size(w) < 2) | (F.size(w) > 5), 20).when(F.forall(w, lambda x: x.rlike(r"^\p{L}")), 90).otherwise(30))
        else:
            bare = F.filter(F.transform(words, lambda w: strip(w, " :;,.-")), lambda w: w != "")
            out = let(bare, lambda w: F.when(F.size(w) == 0, 0).when(~value.rlike(r"\p{L}") | (F.size(w) > 8), 30).when(
                F.size(w) == 1, F.when(F.try_element_at(w, F.lit(1)).rlike(r"^\p{Lu}\p{L}*$"), 75).otherwise(25)).otherwise(90))
    return F.when(F.length(value) > 0, out).otherwise(0)


def fallback(field: str, text: Column, taken: Column, mode: str) -> Column:
    """Document-wide scan by type, for fields without a usable anchor."""
    kind = FIELD_KINDS.get(field)
    if field == "referring_provider_npi":
        return F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d{10})\b")), is_valid_npi), F.lit(1))
    if field == "diagnosis_code":
        return first_match(text, rf"\b{ICD10}\b")
    if field == "procedure_code":
        return F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(rf"\b({CPT_STRICT})\b")), lambda c: ~F.array_contains(taken, c)), F.lit(1))
    if field == "document_reference":
        return first_match(text, "(?i)" + REFERENCE)
    if kind == "date":
        dates = F.array_sort(F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({I_DATE})")), lambda d: F.struct(normalize_date(d).alias("k"), d.alias("v"))),
                                      lambda s: s["k"].isNotNull()))
        place = {"patient_dob": 1, "document_date": -1}.get(field)
        at = lambda found: F.lit(place) if place else F.floor(F.size(found) / 2).cast("int") + 1
        return let(dates, lambda found: F.try_element_at(found, at(found)))["v"]
    if kind == "amount":
        # parity takes any number for an amount; fixed mode wants a currency mark or cents
        keep = (lambda s: s["k"] > 0) if mode == "parity" else (lambda s: (s["k"] > 0) & s["v"].rlike(r"[$]|USD|\.\d{1,2}$"))
        found = F.transform(F.regexp_extract_all(text, F.lit(f"({AMOUNT})")), lambda a: F.struct(normalize_amount(a).cast("double").alias("k"), a.alias("v")))
        amounts = F.array_sort(F.filter(found, lambda s: F.coalesce(keep(s), F.lit(False))))
        place = {"total_charge": -1, "patient_responsibility": 1}.get(field)
        at = lambda found: F.lit(place) if place else F.floor(F.size(found) / 2).cast("int") + 1
        return let(amounts, lambda found: F.try_element_at(found, at(found)))["v"]
    if field == "member_id":
        return first_match(text, MEMBER_ID)
    return F.lit(None).cast("string")


def doctype_by_words(text: Column) -> Column:
    """struct(doc_type, confidence): the first type of which a word occurs, else referral_letter."""
    def of(low):
        out = None
        for kind, words in DOCTYPE_WORDS.items():
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w))
            s = F.struct(F.lit(kind).alias("doc_type"), F.lit(0.6).alias("confidence"))
            out = F.when(hit, s) if out is None else out.when(hit, s)
        return out.otherwise(F.struct(F.lit("referral_letter").alias("doc_type"), F.lit(0.2).alias("confidence")))

    return let(F.lower(fold(text)), of)


def service_lines_of(lines: Column, mode: str = "parity") -> Column:
    """Rows of the service table: lines that begin with a procedure code. parity: the first number of the
    line, which is the code itself, counts as the charge; fixed: code and date are set aside first."""
    def row(x):
        t = x["text"]
        date = first_match(t, I_DATE)
        rest = t if mode == "parity" else F.replace(F.regexp_replace(t, rf"^\s*{CPT_STRICT}\b", " "), F.coalesce(date, F.lit("\0")), F.lit(" "))
        amounts = F.filter(F.regexp_extract_all(rest, F.lit(f"({AMOUNT})")), lambda a: normalize_amount(a).isNotNull())
        if mode != "parity":
            amounts = F.filter(amounts, lambda a: a.rlike(r"[$]|USD|\.\d{1,2}$"))
        return F.struct(first_match(F.ltrim(t), rf"^{CPT_STRICT}\b").alias("procedure_code"), date.alias("date_of_service"),
                        null_if_empty(F.regexp_extract(t, r"\b([1-9])\b(?=\s*(?:\$|USD|\d+[.,]))", 1)).alias("units"),
                        F.try_element_at(amounts, F.lit(1)).alias("charge"), F.try_element_at(amounts, F.lit(2)).alias("paid"))

    return F.transform(F.filter(lines, lambda x: F.ltrim(x["text"]).rlike(rf"^{CPT_STRICT}\b")), row)


def letterhead(text: Column) -> Column:
    """First line with more than eight characters."""
    return F.trim(F.try_element_at(F.filter(F.split(text, "\n", -1), lambda t: F.length(F.trim(t)) > 8), F.lit(1)))


def _best(field: str, lines: Column) -> Column:
    """Best candidate of all anchors of a field: (score, value), the first of the best."""
    def of_line(x, place):
        mine = F.filter(x["anchors"], lambda a: F.array_contains(a["fields"], field))
        return F.flatten(F.transform(mine, lambda a: F.array(
            F.struct(trim_candidate(field, value_right(x, a)).alias("v"), F.lit(5).alias("bonus")),
            F.struct(trim_candidate(field, value_below(lines, place, a)).alias("v"), F.lit(0).alias("bonus")))))

    found = F.filter(F.flatten(F.transform(lines, of_line)), lambda s: s["v"].isNotNull())
    scored = F.transform(found, lambda s, i: F.struct((-(type_score(field, s["v"]) + s["bonus"])).alias("k"), i.alias("i"), s["v"].alias("v")))
    return F.array_min(scored)


def extract(docs: DataFrame, fields: tuple[str, ...] = tuple(FIELD_KINDS), text: str = "text", mode: str = "parity") -> DataFrame:
    """docs with doc_type, doc_type_confidence, fields (map field -> value), confidences, service_lines,
    org_roles. Only fields that the found type carries get a value. mode: parity keeps the known quirks
    of the measured system (number as charge, any number as amount), fixed does not."""
    out = with_anchors(docs, text).withColumn("_type", doctype_by_words(F.col(text)))
    out = out.withColumn("_taken", F.expr("cast(array() as array<string>)"))
    for f in (x for x in FIELD_KINDS if x in fields):
        wanted = F.col("_type.doc_type").isin([t for t, fs in FIELDS_BY_DOCTYPE.items() if f in fs])
        out = out.withColumn(f"_b_{f}", F.when(wanted, _best(f, F.col("lines"))))
        found = F.when(F.col(f"_b_{f}")["k"] <= -50, F.col(f"_b_{f}")["v"])
        scan = trim_candidate(f, F.when(wanted, fallback(f, F.col(text), F.col("_taken"), mode)))
        out = out.withColumn(f"_v_{f}", F.coalesce(found, scan))
        if f not in ("procedure_code",):
            out = out.withColumn("_taken", F.concat("_taken", F.filter(F.array(F.col(f"_v_{f}")), lambda v: v.isNotNull())))
    used = [x for x in FIELD_KINDS if x in fields]
    value = lambda f: F.col(f"_v_{f}") if f in used else F.lit(None).cast("string")
    # as in the measured system a field's confidence is that of its best anchor, also where the scan supplied it
    sure = lambda f: F.coalesce(-F.col(f"_b_{f}")["k"] / 100.0, F.lit(0.35))
    return out.select(
        *docs.columns, F.col("_type.doc_type").alias("found_type"), F.col("_type.confidence").alias("found_type_confidence"),
        F.map_filter(F.create_map(*[c for f in used for c in (F.lit(f), value(f))]), lambda k, v: v.isNotNull()).alias("fields"),
        F.map_filter(F.create_map(*[c for f in used for c in (F.lit(f), F.when(value(f).isNotNull(), sure(f)))]), lambda k, v: v.isNotNull()).alias("confidences"),
        service_lines_of(F.col("lines"), mode).alias("service_lines"), F.struct(letterhead(F.col(text)).alias("referring_org"),
                                                                               value("servicing_facility").alias("servicing_org"),
                                                                               value("payer_name").alias("payer_org")).alias("org_roles"))


def long_form(extracted: DataFrame, approach: str, text: str = "text") -> DataFrame:
    """(approach, doc_id, field, value, start, end): one row per found field; start is the first place of
    the value in the text, null if it does not stand there literally."""
    rows = extracted.select("doc_id", F.col(text).alias("t"), F.explode("fields").alias("field", "value"))
    at = F.nullif(F.instr(F.col("t"), F.col("value")), F.lit(0)) - 1
    return rows.select(F.lit(approach).alias("approach"), "doc_id", "field", "value", at.alias("start"), (at + F.length("value")).alias("end"))
