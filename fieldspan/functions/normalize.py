"""Normalisers shared by extraction and scoring: two values mean the same iff these are equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CPT, FIELD_KINDS, ICD10, MONEY_WORDS, MONTHS, NAME_SUFFIXES, NAME_TITLES, ORG_SUFFIXES
from .text import compact, fold, let, null_if_empty, squash, strip

NUMERIC = r"^(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{1,4})$"
MONTH_FIRST = r"^([a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{2,4})$"
DAY_FIRST = r"^(\d{1,2})(?:st|nd|rd|th)?[\s\-]+(?:de\s+)?([a-z]+)\.?[\s\-,]+(?:de\s+)?(\d{2,4})$"


def date_text(c: Column) -> Column:
    """The date part of a captured value: folded, lower case, without a leading label or preposition."""
    t = strip(F.lower(squash(fold(c))), " ,;:")
    t = F.regexp_replace(t, r"^[a-z .]{1,30}:\s*", "")
    return F.trim(F.regexp_replace(t, r"^(?:on|el|dated?|fecha|de)\s+", ""))


def expand_year(y: Column) -> Column:
    return F.when(y >= 100, y).when(y <= 30, 2000 + y).otherwise(1900 + y)


def safe_date(y: Column, m: Column, d: Column) -> Column:
    """ISO text of a valid date, else null."""
    iso = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when((y >= 1) & iso.try_cast("date").isNotNull(), iso)


def _int(t: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(t, pattern, group).try_cast("int")


def _months() -> Column:
    return F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])


def date_parts(c: Column) -> Column:
    """struct(iso, ambiguous, known): ISO date; whether the order was ambiguous (month first then);
    whether the shape was recognised at all."""
    def of(t):
        a, b, y = (_int(t, NUMERIC, i) for i in (1, 2, 3))
        iso_first = F.length(F.regexp_extract(t, NUMERIC, 1)) == 4

        def by_number(n):
            year = expand_year(n["y"])
            return F.struct(F.when(n["iso"], safe_date(n["a"], n["b"], n["y"])).when(n["a"] > 12, safe_date(year, n["b"], n["a"])).otherwise(
                safe_date(year, n["a"], n["b"])).alias("iso"), (~n["iso"] & (n["a"] <= 12) & (n["b"] <= 12)).alias("ambiguous"), F.lit(True).alias("known"))

        def by_name(m):
            first = safe_date(expand_year(_int(t, MONTH_FIRST, 3)), m["m1"], _int(t, MONTH_FIRST, 2))
            second = safe_date(expand_year(_int(t, DAY_FIRST, 3)), m["m2"], _int(t, DAY_FIRST, 1))
            return F.struct(F.when(m["m1"].isNotNull(), first).when(m["m2"].isNotNull(), second).alias("iso"), F.lit(False).alias("ambiguous"),
                            (m["m1"].isNotNull() | m["m2"].isNotNull()).alias("known"))

        months = F.struct(F.try_element_at(_months(), F.regexp_extract(t, MONTH_FIRST, 1)).alias("m1"),
                          F.try_element_at(_months(), F.regexp_extract(t, DAY_FIRST, 2)).alias("m2"))
        numbers = F.struct(a.alias("a"), b.alias("b"), y.alias("y"), iso_first.alias("iso"))
        return F.when(t.rlike(NUMERIC), let(numbers, by_number)).otherwise(let(months, by_name))

    return let(date_text(c), of)


def normalize_date(c: Column) -> Column:
    """ISO date of the shapes the corpus prints. Rows of other shapes are null here; functions.arrow
    has the tail for them, to be applied to those rows alone. Padded numeric dates, the most common, are only cut."""
    def of(v):
        ymd, mdy = ((1, 6, 9), (7, 1, 4))
        iso = lambda at: F.concat_ws("-", F.substring(v, at[0], 4), F.substring(v, at[1], 2), F.substring(v, at[2], 2))
        valid = lambda at: let(iso(at), lambda d: F.when(d.try_cast("date").isNotNull(), d))
        return (F.when(v.rlike(r"^[1-9]\d{3}[/.\-]\d\d[/.\-]\d\d\z"), valid(ymd)).when(v.rlike(r"^(?:0\d|1[0-2])[/.\-]\d\d[/.\-][1-9]\d{3}\z"), valid(mdy))
                .otherwise(date_parts(v)["iso"]))

    return let(c, of)


def normalize_amount(c: Column) -> Column:
    """Text with two decimals, half-even; null if there is no amount."""
    def separators(t):
        bare, point = F.replace(t, F.lit(","), F.lit("")), F.replace(t, F.lit(","), F.lit("."))
        comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
        european = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
        return (F.when(both, F.when(comma_last, european).otherwise(bare))
                .when(F.contains(t, F.lit(",")), F.when(t.rlike(r",\d{2}$"), point).otherwise(bare)).otherwise(t))

    def one_point(u):
        head, tail = F.regexp_extract(u, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(u, r"^(.*)\.([^.]*)$", 2)
        return F.when(F.regexp_count(u, F.lit(r"\.")) > 1, F.concat(F.replace(head, F.lit("."), F.lit("")), F.lit("."), tail)).otherwise(u)

    def number(u, negative):
        amount = F.bround(u.try_cast("decimal(38,10)"), 2).cast("decimal(38,2)")
        fits = F.length(F.regexp_extract(u, r"^0*(\d*)", 1)) <= 26
        return F.when(fits & u.rlike(r"^(\d+\.?\d*|\.\d+)$"), F.when(negative, -amount).otherwise(amount).cast("string"))

    def of(t):
        negative = (F.contains(t, F.lit("(")) & F.contains(t, F.lit(")"))) | t.startswith("-")
        plain = F.regexp_replace(F.regexp_replace(t, "(?i)" + MONEY_WORDS, " "), r"[^\d,.\-]", "")
        digits = let(plain, lambda p: F.regexp_replace(F.regexp_replace(separators(p), r"[^\d.\-]", ""), "^-+", ""))
        return let(let(digits, one_point), lambda u: number(u, negative))

    # plain sums with two decimals only lose their marks
    plain = r"^(?:USD |\$)?(?:[1-9]\d{0,2}(?:,\d{3}){1,7}|[1-9]\d{0,23}|0)\.\d\d\z"
    return let(c, lambda v: F.when(v.rlike(plain), F.translate(v, "USD $,", "")).otherwise(let(squash(fold(v)), of)))


def normalize_person(c: Column) -> Column:
    """First name, last name in lower case, without titles and letters after the name."""
    titles, suffixes = "(?i)" + NAME_TITLES, "(?i)" + NAME_SUFFIXES
    t = F.regexp_replace(F.regexp_replace(squash(fold(c)), titles, " "), suffixes, " ")
    t = F.regexp_replace(F.replace(t, F.lit("."), F.lit(" ")), suffixes, " ")
    t = F.regexp_replace(t, r"(?U)[^\w\s,'\-]", " ")

    def swap(x):
        at = F.instr(x, ",")
        last, first = F.substring(x, F.lit(1), at - 1), F.substring(x, at + 1, F.length(x))
        return F.when((at > 0) & (F.trim(first) != ""), F.concat(first, F.lit(" "), last)).otherwise(x)

    return let(strip(F.lower(squash(let(t, swap))), " ,-'"), null_if_empty)


def normalize_org(c: Column) -> Column:
    """Lower case, without legal forms and punctuation."""
    legal = "(?i)" + ORG_SUFFIXES
    t = F.regexp_replace(F.regexp_replace(squash(fold(c)), legal, " "), r"(?U)[^\w\s&\-]", " ")
    return let(strip(F.lower(squash(F.regexp_replace(t, legal, " "))), " -&"), null_if_empty)


def normalize_code(c: Column) -> Column:
    """Upper case letters A-Z and digits alone; references and codes."""
    return let(F.upper(F.regexp_replace(fold(c), "[^A-Za-z0-9]", "")), null_if_empty)


normalize_reference = normalize_code


def kind_of(field: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_KINDS.items() for x in kv]), field)


def normalize_field(field: Column, value: Column) -> Column:
    """By the kind of the field; unknown fields: squashed, folded, lower case."""
    kind = kind_of(field)
    by = {"date": normalize_date, "amount": normalize_amount, "person": normalize_person, "org": normalize_org,
          "reference": normalize_code, "code": normalize_code}
    out = None
    for k, f in by.items():
        out = F.when(kind == k, f(value)) if out is None else out.when(kind == k, f(value))
    return F.when(value != "", out.otherwise(null_if_empty(F.lower(squash(fold(value))))))


def values_match(field: Column, a: Column, b: Column) -> Column:
    """Two nulls match, one does not; otherwise both normalise to the same text."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(
        F.coalesce(normalize_field(field, a) == normalize_field(field, b), F.lit(False)))


def is_valid_npi(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return (F.length(digits) == 10) & F.call_function("luhn_check", F.concat(F.lit("80840"), digits))


def npi_check_digit(nine: Column) -> Column:
    """The digit that completes nine digits to a valid number."""
    return F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", 
        F.concat(F.lit("80840"), nine, d.cast("string")))), 1)


def looks_like_icd10(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).rlike(f"^{ICD10}$"), F.lit(False))


def looks_like_cpt(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).rlike(f"^{CPT}$"), F.lit(False))


def appears_in_text(value: Column, text: Column, field: Column, compacted: Column | None = None) -> Column:
    """The value stands in the text when case, accents and punctuation are set aside; dates also in
    another numeric form of the same day. An empty value appears anywhere. compacted: compact(text), where
    it is at hand."""
    page = compact(text) if compacted is None else compacted
    forms = F.regexp_extract_all(text, F.lit(r"([0-9][0-9/\-.]{4,12}[0-9])"))
    same_day = let(normalize_date(value), lambda day: F.exists(forms, lambda d: normalize_date(d) == day))
    stands = let(compact(value), lambda needle: (needle == "") | F.contains(page, needle))
    # what stands in the text as it is also stands in it folded
    return F.coalesce(F.when(value.isNull() | (value == "") | F.contains(text, value) | stands, True).when(kind_of(field) == "date", same_day), F.lit(False))
