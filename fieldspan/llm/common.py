"""Shared helpers: tables cut into the shared folder, crc folds, size-checked joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: U+0020 and U+0009 to U+000D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table is broadcast; its size is counted first.
SMALL_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the setting is absent a folder of our own is set once if all runs in one process (tests,
    notebooks); on a cluster that is an error, since its executors could not read such a folder.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = tempfile.mkdtemp(prefix="fieldspan-")
        spark.sparkContext.setCheckpointDir(made)
    return "file://" + made


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: a short lineage that
    survives lost executors. The table goes at the end of the session, or with drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldspan/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    atexit.register(_at_exit, spark, path)
    return out


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone by now
        return


def stored(docs: DataFrame) -> DataFrame:
    """docs with a row number rid, written once in buckets by rid into the warehouse that all executors
    share: a later join on rid does not shuffle the texts. The table goes at the end of the session."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"fieldspan_rows_{uuid.uuid4().hex}"
    (docs.withColumn("rid", F.monotonically_increasing_id()).repartition(n, "rid")
     .write.option("compression", "zstd").bucketBy(n, "rid").saveAsTable(name))
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session may be gone by now
        return


def drop(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    _delete(df.sparkSession, df.cut_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a cut table only after its rows have been counted."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df
