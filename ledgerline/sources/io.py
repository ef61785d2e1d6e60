"""Readers with explicit schemas, and the sinks of results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below ``spark.checkpoint.dir``; a session of one machine that names none gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/ledgerline-shared"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read from there: what follows doesn't repeat it."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_inputs(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:  # noqa: A002
    """Tables that stand in for uploaded sheets: parquet, orc, csv or json."""
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.options(**({"header": "true"} if format == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).format(format).load(path)


def read_checked(spark: SparkSession, path: str, schema: str, format: str = "json", **options) -> DataFrame:  # noqa: A002
    """Lines of csv or json files with the columns of ``schema`` and ``corrupt``.

    A line that doesn't fit the schema is a row of nulls with the line itself in
    ``corrupt``; all others have null there.  Spark plans the partitions by file
    blocks and prunes columns and filters; the path may be any that Spark reads.
    """
    wanted = f"{schema}, corrupt string"
    reader = spark.read.schema(wanted).options(mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt", **options)
    rows = reader.format(format).load(path)
    fields = [f.name for f in rows.schema.fields if f.name != "corrupt"]
    # csv keeps what it could read of a corrupt line
    return rows.select(*[F.when(F.col("corrupt").isNull(), F.col(f"`{f}`")).alias(f) for f in fields], "corrupt")


def read_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(sheet, row, col, value) of delimited text files, one sheet a file, rows and columns from 1.

    A field may stand in double quotes, doubled within; empty fields are null.
    A sheet is read as a whole, since its rows are numbered: it is one row of
    the scan, as a workbook's sheet is one part of an upload.
    """
    files = spark.read.format("text").option("wholetext", "true").load(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("sheet"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n", -1).alias("lines"))
    lines = files.select("sheet", F.posexplode("lines").alias("row", "line"))
    quote = '"'
    fields = F.split("line", f"{re.escape(sep)}(?=(?:[^{quote}]*{quote}[^{quote}]*{quote})*[^{quote}]*$)", -1)
    cells = lines.select("sheet", (F.col("row") + 1).alias("row"), F.posexplode(fields).alias("col", "raw"))
    bare = F.regexp_replace(F.regexp_replace("raw", f"^{quote}(.*){quote}$", "$1"), quote * 2, quote)
    return cells.select("sheet", "row", (F.col("col") + 1).alias("col"), F.when(bare != "", bare).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_payslips(df: DataFrame, path: str) -> None:
    """A folder for each period; in it ranges of employees, so one employee's rows lie in one place of one file."""
    df.repartitionByRange("period", "employee_id").sortWithinPartitions("period", "employee_id").write.mode("overwrite").partitionBy("period").parquet(path)


def audit_rows(df: DataFrame, event_type: str, actor: str, timestamp: Column, *payload: str) -> DataFrame:
    """One JSON line (column ``value``) for each row."""
    return df.select(F.to_json(F.struct(F.lit(event_type).alias("event_type"), F.to_json(F.struct(*payload)).alias("payload"), F.lit(actor).alias("actor"), timestamp.alias("timestamp"))).alias("value"))


def append_audit(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("append").text(path)


def redact(df: DataFrame, safe: tuple[str, ...], inputs: str, allowed: tuple[str, ...]) -> DataFrame:
    """Only safe columns leave, and of the input map only what is allowed."""
    return df.select(*safe, F.map_filter(inputs, lambda k, v: k.isin(*allowed)).alias(inputs))
