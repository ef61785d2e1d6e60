"""Shared folder, materialised tables and small helpers of the llm operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one (``spark.checkpoint.dir``).

    A session of one machine that names none (as in tests) gets a local one; a
    cluster must name it, since executors don't see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/ledgerline-shared"
    return f"{base.rstrip('/')}/ledgerline-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    This cuts the lineage so that a lost executor costs a re-read only.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: A key that holds more than this part of a table's rows is hot; there are at most that many such keys.
HOT_KEYS, SALTS = 200, 64


def join_skewed(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", size: str | None = None, by: list[str] | None = None, least: int = 100) -> DataFrame:
    """Joins ``left`` with ``right``, which has at most one row for each key, whatever the skew of ``left``.

    Keys with more than 1 / ``HOT_KEYS`` of the rows of ``left`` (and more than
    ``least``) are salted: their rows are dealt to ``SALTS`` places by a hash of
    the columns ``by`` (all others, if none are named), and their row of
    ``right`` goes to each.  Hot keys are fewer than ``HOT_KEYS``, which is the
    proven bound of what is broadcast.  ``size`` names a column of ``right``
    that holds at least the number of a key's rows in ``left``; without one
    they are counted.  ``left`` is read twice and should be a stored table.
    """
    most = max(least, left.count() // HOT_KEYS)
    counts = right.select(*on, F.col(size).alias("__n")) if size else left.groupBy(*on).agg(F.count("*").alias("__n"))
    hot = stored(counts.where(F.col("__n") > most).select(*on, F.lit(True).alias("__hot")).limit(HOT_KEYS), "hot")
    if hot.isEmpty():
        return left.join(right.hint("shuffle_merge"), on, how)
    place = F.pmod(F.xxhash64(*(by or [c for c in left.columns if c not in on])), F.lit(SALTS)).cast("int")
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot"), place).otherwise(0)).drop("__hot")
    places = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(places)).drop("__hot")
    return dealt.join(spread.hint("shuffle_merge"), [*on, "__salt"], how).drop("__salt")


def row_key() -> Column:
    """Key of a document row: rows that share an id but not a text stay apart."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns never meet."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def groups_for(rows: int, per_group: int) -> int:
    """Number of coarse hash groups, in proportion to the rows."""
    return max(1, -(-rows // per_group))
