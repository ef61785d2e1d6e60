"""A corpus pipeline: five stages, each a Spark job over what the last one kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontamination, jaccard_join, language_id, line_dedup, mixing
from ledgerline.llm._work import row_key, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier can't place (``und``: null, or no letter) go.

    All others stay, whatever their language, id or label; repeated rows are
    judged alike, and an empty table stays empty.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model, carry=COLUMNS).where("lang_pred <> 'und'").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters in 5 or more documents stay in the last one only.

    No document goes; null texts stay null, and rows with a null id keep all
    lines; rows that share an id count as one document.
    """
    out = line_dedup.drop_repeated_lines(_docs(docs))
    return out.select("doc_id", F.when(F.col("text").isNotNull(), F.col("kept")).alias("text"), "lang", "source", F.when(F.col("text").isNotNull(), F.char_length("kept").cast("long")).alias("n_chars"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, the smallest doc_id (null last), then row key.

    Null and wordless texts all stay; of equal rows one stays.
    """
    return jaccard_join.keep_one(_docs(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, also those with a null id.

    A clean row that shares its id with such a document stays.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.search(docs, items).where(F.size("spans") > 0).select(F.col("row_key").alias("key")).distinct()
    return _docs(docs).withColumn("key", row_key()).join(stored(found, "hit").hint("shuffle_merge"), "key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document that bring its source to its target share; null sources are one source."""
    return mixing.mix(_docs(docs)).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Language ID, the near-copy classes and the drawn copies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
