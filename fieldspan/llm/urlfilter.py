"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions and the DataFrame-based GBTClassifier only; no Python on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, maybe_broadcast, table

#: (verdict, host, path) of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
         ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled URLs that the trees are fitted on, at most about so many, drawn by a hash of the URL.
#: Suffix statistics and rules still cover every row.
FIT_ROWS = 20_000
FEATURES = ("f_len", "f_host_len", "f_depth", "f_digits", "f_entropy", "f_params", "f_dots", "f_dashes",
            "f_path_len", "f_suffix_rate", "f_suffix_log_n")


def parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path; both empty where the url is null or has no '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path joined) and its verdict; null where none fits."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0),
                          lambda s, c: s - ((F.length(u) - F.length(F.replace(u, c, F.lit("")))) / F.length(c) / n)
                          * F.log2((F.length(u) - F.length(F.replace(u, c, F.lit("")))) / F.length(c) / n))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "f_len": F.length(u), "f_host_len": F.length(host), "f_depth": F.regexp_count(path, F.lit("/")),
        "f_digits": F.regexp_count(u, F.lit("[0-9]")) / n, "f_entropy": entropy,
        "f_params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "f_dots": F.regexp_count(host, F.lit(r"\.")), "f_dashes": F.regexp_count(u, F.lit("[-_]")),
        "f_path_len": F.length(path),
    }


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, label: Column | None = None,
          rounds: int = 10, depth: int = 3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, score (the trees' chance of block).

    Labels are the verdicts of the rules (or `label`: block, allow or null). Suffix statistics: of the
    labelled URLs with the same last host label, the smoothed rate of block and the number. A url that is
    null, empty or without '://' has an empty host and path, fits no rule and goes to the trees as such.
    Where only one verdict is labelled, the trees' verdict is that one; with no label at all, allow.
    Repeated rows are judged alike; other columns are not read; an empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        *([label.alias("given")] if label is not None else []))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "fixed": verdict})
    base = base.withColumn("y", F.when((F.col("given") if label is not None else F.col("fixed")) == "block", 1.0)
                           .when((F.col("given") if label is not None else F.col("fixed")) == "allow", 0.0))
    base = base.withColumns({k: c.cast("double") for k, c in _lexical(F.col("url"), F.col("host"), F.col("path")).items()})
    base = cut(base.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)), "urls")
    counts = {r.y: r.n for r in base.where("y is not null").groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        only = "block" if 1.0 in counts else "allow"
        return base.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", F.lit(only)).alias("verdict"),
                           F.lit(float(only == "block")).alias("score"))
    prior = counts[1.0] / n
    suffixes = cut(base.groupBy("suffix").agg(F.count("y").alias("sn"), F.sum("y").alias("sy")).select(
        "suffix", ((F.coalesce("sy", F.lit(0.0)) + 20 * prior) / (F.col("sn") + 20)).alias("f_suffix_rate"),
        F.log1p(F.col("sn").cast("double")).alias("f_suffix_log_n")), "suffixes")
    rows = base.join(maybe_broadcast(suffixes), "suffix")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    part = min(1.0, fit_rows / n)
    fit = rows.where(F.col("y").isNotNull() & (F.pmod(F.xxhash64("url", "id"), F.lit(1 << 20)) < round(part * (1 << 20))))
    fit = cut(fit.select("features", "y", "url", "id").repartition(4, "id", "url").sortWithinPartitions("id", "url").select("features", "y"), "fit")
    if fit.select("y").distinct().count() < 2:
        return base.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(
            "fixed", F.lit("block" if prior >= 0.5 else "allow")).alias("verdict"), F.lit(prior).alias("score"))
    model = GBTClassifier(featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=depth, maxBins=32, seed=42).fit(fit)
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(
        "fixed", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES = {"op8_urlfilter": op8_urlfilter}
ORACLE: dict[str, str] = {}
