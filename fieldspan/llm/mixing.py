"""Mixing sources to target weights as a time-varying curriculum, in DataFrame functions only.

Source k has the weight schedule w_k(t) = weight_k * (1 + ramp_k * (2t - 1)) over the training time
t in [0, 1]; its integral is weight_k, so the integrated schedules fix the targets. The documents of
a source stand in a fixed random order, and the words before a document are its demand. Position
t of a document solves  integral_0^t w_k / integral_0^1 w_k = words before it / target.
The rows are range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, table, word_count

#: Documents of a source that one prefix-sum window holds, on average.
BUCKET_ROWS = 1024


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size, n) with k, weight and target.

    By code point, null last, the weights repeat. The targets fill `share` of all words by weight;
    none passes cap * its size. Ordered by cap/weight the full sources are a prefix, so the level of
    the rest has a closed form over running sums: the fixed point of resharing the excess.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    k = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("full") / F.col("weight"), "k")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("k", k).withColumn("weight", w).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    s = (s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
         .withColumn("all_w", F.sum("weight").over(whole))
         .withColumn("used", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
         .withColumn("used_w", F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("sat", F.col("full") * (F.col("all_w") - F.col("used_w"))
                     <= F.col("weight") * (F.col("total") - F.col("used")))
    s = (s.withColumn("sat_full", F.sum(F.when(F.col("sat"), F.col("full")).otherwise(0.0)).over(whole))
         .withColumn("sat_w", F.sum(F.when(F.col("sat"), F.col("weight")).otherwise(0.0)).over(whole)))
    rest = F.col("weight") * (F.col("total") - F.col("sat_full")) / (F.col("all_w") - F.col("sat_w"))
    return s.select("source", "source_size", "n", "k", "weight",
                    F.when(F.col("sat"), F.col("full")).otherwise(rest).alias("target"))


def _position(y, ramp):
    """Inverse of the cumulative demand: t with ((1 - r) t + r t^2) = y."""
    a = 1 - ramp
    return 2 * y / (a + F.sqrt(a * a + 4 * ramp * y))


def mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document as demand() gives it, range-sorted by position; documents the mix leaves out come last."""
    return in_order(demand(docs, id_col=id_col, **options), id_col, "source", "start")


def demand(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, ramp: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id_col, source, size, source_size, target, taken, position, then `keep` columns.

    taken: words of the document in the mix, repeats counted; a source is read in passes until its
    target (to the nearest word) is met, the last document in part. position: training time of the
    document's first word (null if nothing is taken); pass p of it stands at p * source_size words
    further. Null text has size 0; a null source is a source of its own; equal or null ids and
    repeated rows are rows like others (the order is by md5 of the id, then id and size); an empty
    table gives no rows; other columns are not read.

    Plan: one scan to a narrow table, one sum by source (combined before the shuffle), prefix sums in
    buckets of about BUCKET_ROWS documents of a source, so that a hot source spreads over many tasks.
    """
    slim = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                           word_count(F.col(text_col).cast("string")).alias("size"),
                           F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10)
                           .cast("long").alias("h"), F.struct(F.lit(0).alias("_"), *keep).alias("kept")), "sizes")
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = cut(targets(by_source, weights, share, cap), "targets")
    wide = slim.alias("d").join(maybe_broadcast(plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "id", "d.source", "size", "h", "source_size", "target", "k", "kept",
        F.floor(F.col("h") / F.lit(float(1 << 60)) * F.ceil(F.col("n") / BUCKET_ROWS)).cast("long").alias("bucket"))
    sums = wide.groupBy("k", "bucket").agg(F.sum("size").alias("in_bucket"))
    base = sums.select("k", "bucket", F.coalesce(F.sum("in_bucket").over(
        Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("k", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    wide = (wide.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(maybe_broadcast(cut(base, "bases")), ["k", "bucket"])
            .withColumn("start", F.col("base") + F.col("local")))
    words = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    extra = F.greatest(F.lit(0).cast("long"), F.least("size", words - passes * F.col("source_size") - F.col("start")))
    wide = wide.withColumn("taken", passes * F.col("size") + extra)
    slope = F.element_at(F.array(F.lit(float(ramp)), F.lit(0.0), F.lit(-float(ramp))), (F.col("k") % 3 + 1).cast("int"))
    return wide.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, _position(F.least(F.col("start") / F.col("target"), F.lit(1.0)), slope)).alias("position"),
        "start", slope.alias("slope"), *[F.col("kept." + c).alias(c) for c in keep])


def passes(docs: DataFrame, *, id_col: str = "doc_id", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per document and pass that takes words of it: id_col, size, pass, words, position, `keep`."""
    m = demand(docs, id_col=id_col, keep=keep, **options).where("taken > 0")
    at = m.select(id_col, "size", "taken", "source_size", "target", "start", "slope", *keep, F.explode(
        F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))).alias("pass"))
    y = F.least((F.col("start") + F.col("pass") * F.col("source_size")) / F.col("target"), F.lit(1.0))
    return at.select(id_col, "size", "pass", F.least("size", F.col("taken") - F.col("pass") * F.col("size")).alias("words"),
                     _position(y, F.col("slope")).alias("position"), *keep)


def in_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows range-sorted by training position, null last: files follow one another in the order of training."""
    by = [F.col("position").asc_nulls_last(), *ties]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def training_order(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, pass, words, position of every document and pass, range-sorted by position."""
    return in_order(passes(docs, id_col=id_col, **options).select(id_col, "pass", "words", "position"), id_col, "pass")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of every document, in the order of training."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
a AS (SELECT *, row_number() OVER (ORDER BY (source IS NULL), source) - 1 AS k FROM s),
b AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        source_size * 2.0::DOUBLE AS cap FROM a),
c AS (SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_w,
        coalesce(sum(cap) OVER w, 0) AS used, coalesce(sum(weight) OVER w, 0) AS used_w FROM b
      WINDOW w AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, cap * (all_w - used_w) <= weight * (total - used) AS sat FROM c),
f AS (SELECT *, sum(CASE WHEN sat THEN cap ELSE 0 END) OVER () AS sat_cap,
        sum(CASE WHEN sat THEN weight ELSE 0 END) OVER () AS sat_w FROM e),
p AS (SELECT source, source_size, k, CASE WHEN sat THEN cap ELSE weight * (total - sat_cap) / (all_w - sat_w) END AS target FROM f),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.k, coalesce(CAST(sum(d.size) OVER (
        PARTITION BY p.k ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start,
        CAST(floor(p.target + 0.5) AS BIGINT) AS words
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN words // greatest(source_size, 1) ELSE 0 END AS passes FROM q),
t AS (SELECT *, passes * size + greatest(0, least(size, words - passes * source_size - start)) AS taken,
        least(start / target, 1.0::DOUBLE) AS y, CASE k % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS z FROM r)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN round(2 * y / ((1 - z) + sqrt((1 - z) * (1 - z) + 4 * z * y)), 6) END AS position FROM t
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLE = {"op7_mixing": OP7_SQL}
