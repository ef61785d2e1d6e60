"""Sheets to typed tables: headers, row selection, merging, column mapping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S


def promote_header(grid: DataFrame, header_row: int, data_start_row: int | None = None) -> DataFrame:
    """Names columns from one row of ``grid (row_no, c1, c2, ...)`` (0-based) and drops what stands above the data."""
    columns = [c for c in grid.columns if c != "row_no"]
    head = grid.where(F.col("row_no") == header_row).select(*columns).first()  # one row
    skip = max((data_start_row or 0) - (header_row + 2), 0)
    names = [str(v) if v not in (None, "") else c for c, v in zip(columns, head or columns, strict=True)]
    return grid.where(F.col("row_no") > header_row + skip).select("row_no", *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])


def combine_headers(cells: DataFrame) -> DataFrame:
    """(sheet, col, label): distinct non-blank parts of the header rows joined by `` | ``, else ``Column_n``."""
    text = F.trim("value")
    parts = cells.groupBy("sheet", "col").agg(F.array_sort(F.collect_list(F.when(text != "", F.struct("row", text.alias("v"))))).alias("p"))
    label = F.array_join(F.array_distinct(F.transform("p", lambda x: x["v"])), " | ")
    return parts.select("sheet", "col", F.when(label != "", label).otherwise(F.concat(F.lit("Column_"), F.col("col").cast("string"))).alias("label"))


def dedupe_labels(labels: DataFrame, before: str = "__", after: str = "") -> DataFrame:
    """The second and later equal labels of a sheet get their number."""
    n = F.row_number().over(Window.partitionBy("sheet", "label").orderBy("col"))
    numbered = F.concat(F.col("label"), F.lit(before), n.cast("string"), F.lit(after))
    return labels.select("sheet", "col", F.when(n > 1, numbered).otherwise(F.col("label")).alias("label"))


def drop_blank_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.na.drop("all", subset=columns)


def select_rows(rows: DataFrame, column: str, equals: str | None = None, among: Iterable[str] | None = None, not_empty: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Rows whose trimmed, case-folded value matches."""
    fold = (lambda c: F.trim(c)) if case_sensitive else (lambda c: F.lower(F.trim(c)))
    value = F.coalesce(fold(F.col(column).cast("string")), F.lit(""))
    if equals is not None:
        return rows.where(value == fold(F.lit(equals)))
    if among is not None:
        return rows.where(value.isin(*[x.strip() if case_sensitive else x.strip().lower() for x in among]))
    return rows.where(value != "") if not_empty else rows


def merge_sheets(long: DataFrame, codes: list[str]) -> DataFrame:
    """One record per employee from ``long (employee_id, code, value)`` of many
    sheets; a code with two different values is a conflict."""
    each = long.groupBy("employee_id", "code").agg(F.max("value").alias("value"), F.count_distinct("value").alias("n"))
    return each.groupBy("employee_id").agg(*[F.max(F.when(F.col("code") == c, F.col("value"))).alias(c) for c in codes], F.count_if(F.col("n") > 1).alias("conflicts"))


def merge_employee_sheets(rows: DataFrame, *fields: str) -> DataFrame:
    """Later rows win; an id twice in one sheet is an error."""
    per_sheet = rows.groupBy("employee_id", "sheet").agg(F.count("*").alias("n"), *[F.max_by(F.struct(f), "place").alias(f) for f in fields], F.max("place").alias("place"))
    return per_sheet.groupBy("employee_id").agg(*[F.max_by(f, "place")[f].alias(f) for f in fields], F.bool_or(F.col("n") > 1).alias("duplicated"))


def id_column(labels: DataFrame) -> DataFrame:
    """(sheet, id_column): a preferred name, else one with employee and id or code in it."""
    name = S.normalize_label(F.col("label"))
    rank = F.when(name.isin("employee_id", "ma_nhan_vien", "ma_nv", "employee_code"), 0).when(name.rlike("employee|nhan_vien") & name.rlike("id|code|ma"), 1)
    return labels.withColumn("rank", rank).where("rank is not null").groupBy("sheet").agg(F.min_by("label", F.struct("rank", "col")).alias("id_column"))


def map_columns(headers: DataFrame, required: DataFrame, source: str | None) -> DataFrame:
    """(sheet, field_code, label): required codes in order; the catalog's match
    beats the name's, the leftmost column wins, and each column serves once.
    ``label`` is null where nothing fits.

    A sheet's header is one sorted array, and its codes, in order, take their
    columns from it in one aggregate, which carries the columns taken so far.
    """
    known = {a: code for code, _, aliases in S.FIELD_CATALOG for a in (*aliases, code)}
    alias = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    resolved = lambda c: F.coalesce(F.try_element_at(alias, c), c)
    h = headers.select("sheet", "col", "label", resolved(S.suggest_code(F.col("label"), source)).alias("code"), S.normalize_label(F.col("label")).alias("name"))
    r = required.select("sheet", "field_code", S.normalize_label(F.col("field_code")).alias("name")).withColumn("expected", resolved(F.col("name")))
    columns = h.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("col", "label", "code", "name"))).alias("columns"))
    codes = r.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("field_code", "name", "expected"))).alias("codes"))
    both = codes.join(columns.hint("shuffle_merge"), "sheet", "left").withColumn("columns", F.coalesce(F.transform("columns", lambda x, i: x.withField("i", i)), F.array().cast("array<struct<col:bigint,label:string,code:string,name:string,i:int>>")))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<struct<field_code:string,label:string>>").alias("found"))

    def take(a: Column, c: Column) -> Column:
        fits = F.filter("columns", lambda x: ~F.array_contains(a["taken"], x["i"]) & ((x["code"] == c["expected"]) | (x["name"] == c["name"])))
        best = F.array_min(F.transform(fits, lambda x: F.struct((x["code"] != c["expected"]).alias("late"), x["col"].cast("bigint").alias("col"), x["i"].alias("i"), x["label"].alias("label"))))
        taken = F.when(best.isNull(), a["taken"]).otherwise(F.concat(a["taken"], F.array(best["i"])))
        return F.struct(taken.alias("taken"), F.concat(a["found"], F.array(F.struct(c["field_code"].alias("field_code"), best["label"].alias("label")))).alias("found"))

    return both.select("sheet", F.inline(F.aggregate("codes", start, take, lambda a: a["found"])))


def usable_text(text: Column) -> Column:
    """At least 24 letters or digits and at most 2 % replacement characters."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) >= 24) & (F.regexp_count(text, F.lit("�")) <= 0.02 * F.char_length(text))
