"""Spreadsheet grids as cell tables ``(sheet, row, col, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.ingest import dedupe_labels

#: Fixed limits of header search and table ends.
HEADER_ROWS, HEADER_SCORE, GAP_ROWS = 20, 0.35, 30


def filled(cells: DataFrame) -> DataFrame:
    return cells.where(F.trim(F.coalesce("value", F.lit(""))) != "")


def used_extent(cells: DataFrame) -> DataFrame:
    """(sheet, last_row, last_col) of the cells that aren't blank."""
    return filled(cells).groupBy("sheet").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Empty cells inside a merged range take its top-left value."""
    inner = ranges.select("sheet", "min_row", "min_col", F.explode(F.sequence("min_row", "max_row")).alias("row"), "max_col").select("sheet", "min_row", "min_col", "row", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    corner = filled(cells).select("sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("value").alias("corner"))
    offered = inner.join(corner.hint("shuffle_merge"), ["sheet", "min_row", "min_col"]).groupBy("sheet", "row", "col").agg(F.min("corner").alias("corner"))
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    return cells.join(offered.hint("shuffle_merge"), ["sheet", "row", "col"], "full_outer").select("sheet", "row", "col", F.when(blank, F.coalesce("corner", "value")).otherwise(F.col("value")).alias("value"))


def score_header_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, score): 0.3 fill + 0.5 text + 0.2 distinct; fewer than two cells score 0."""
    value = F.trim("value")
    rows = filled(cells).groupBy("sheet", "row").agg(F.count("*").alias("n"), F.count_if(~F.replace(value, F.lit("."), F.lit("")).rlike(r"^\d+$")).alias("texts"), F.count_distinct(value).alias("kinds"))
    width = used_extent(cells).select("sheet", "last_col")
    score = F.col("n") / F.col("last_col") * 0.3 + F.col("texts") / F.col("n") * 0.5 + F.col("kinds") / F.col("n") * 0.2
    return rows.join(width.hint("shuffle_merge"), "sheet").select("sheet", "row", F.when(F.col("n") < 2, 0.0).otherwise(F.round(score, 9)).alias("score"))


def detect_header(cells: DataFrame) -> DataFrame:
    """(sheet, header_row, span, score): the best of the first rows, with a
    second header row if that fills gaps of the first only."""
    scores = score_header_rows(cells).where(F.col("row") <= HEADER_ROWS)
    best = scores.groupBy("sheet").agg(F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row"))).alias("b")).select("sheet", F.col("b.row").alias("header_row"), F.col("b.score").alias("score")).where(F.col("score") >= HEADER_SCORE)
    top = filled(cells).where(F.col("row") <= HEADER_ROWS + 1)
    columns = best.select("sheet", F.col("header_row").alias("row")).join(top.hint("shuffle_merge"), ["sheet", "row"]).groupBy("sheet").agg(F.collect_set("col").alias("above"))
    second = best.select("sheet", (F.col("header_row") + 1).alias("row")).join(top.hint("shuffle_merge"), ["sheet", "row"]).groupBy("sheet").agg(F.collect_set("col").alias("below"))
    next_score = best.select("sheet", (F.col("header_row") + 1).alias("row")).join(score_header_rows(cells.where(F.col("row") <= HEADER_ROWS + 1).unionByName(_widest(cells))).hint("shuffle_merge"), ["sheet", "row"]).select("sheet", F.col("score").alias("next_score"))
    joined = best.join(columns.hint("shuffle_merge"), "sheet", "left").join(second.hint("shuffle_merge"), "sheet", "left").join(next_score.hint("shuffle_merge"), "sheet", "left")
    two = (F.col("next_score") >= HEADER_SCORE * 0.6) & F.col("below").isNotNull() & ~F.arrays_overlap("above", "below")
    return joined.select("sheet", "header_row", F.when(two, 2).otherwise(1).alias("span"), "score")


def _widest(cells: DataFrame) -> DataFrame:
    """One far cell for each sheet, so that a cut-off grid keeps its width."""
    return used_extent(cells).select("sheet", F.lit(1 << 30).alias("row"), F.col("last_col").alias("col"), F.lit("x").alias("value"))


def split_tables(cells: DataFrame, gap: int = GAP_ROWS) -> DataFrame:
    """(sheet, row, table_no): a run of at least ``gap`` blank rows ends a table."""
    rows = filled(cells).select("sheet", "row").distinct()
    w = Window.partitionBy("sheet").orderBy("row")
    new = F.coalesce((F.col("row") - F.lag("row").over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("new", new).select("sheet", "row", F.sum("new").over(w).alias("table_no"))


def column_letters(col: Column) -> Column:
    """1 as A, 27 as AA (up to two letters)."""
    letter = lambda n: F.chr(F.lit(65) + n)
    first = F.floor((col - 27) / 26)
    return F.when(col <= 26, letter((col - 1).cast("int"))).otherwise(F.concat(letter(first.cast("int")), letter(F.pmod(col - 1, F.lit(26)).cast("int"))))


def build_labels(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, col, label): header parts joined by a space, ``Col<X>`` if empty, ``(n)`` for repeats."""
    every = used_extent(cells).select("sheet", F.explode(F.sequence(F.lit(1), "last_col")).alias("col"))
    first, last = F.min(F.col("header_row")), F.max(F.col("header_row") + F.col("span"))
    span = headers.groupBy("sheet").agg(first.alias("first"), last.alias("end"))
    parts = filled(cells).join(span.hint("shuffle_merge"), "sheet").where((F.col("row") >= F.col("first")) & (F.col("row") < F.col("end"))).groupBy("sheet", "col").agg(F.array_sort(F.collect_list(F.struct("row", F.trim("value").alias("v")))).alias("p"))
    text = F.array_join(F.array_distinct(F.transform("p", lambda x: x["v"])), " ")
    labels = every.join(span.hint("shuffle_merge"), "sheet").join(parts.hint("shuffle_merge"), ["sheet", "col"], "left").select("sheet", "col", F.coalesce(text, F.concat(F.lit("Col"), column_letters(F.col("col")))).alias("label"))
    return dedupe_labels(labels, " (", ")")


def rows_to_text(cells: DataFrame, headers: DataFrame, labels: DataFrame, row_cap: int | None = None) -> DataFrame:
    """(sheet, row, text): ``label: value | label: value`` of the rows below the header."""
    body = filled(cells).join(headers.select("sheet", (F.col("header_row") + F.col("span")).alias("from")).hint("shuffle_merge"), "sheet").where(F.col("row") >= F.col("from"))
    if row_cap is not None:
        body = body.where(F.col("row") < F.col("from") + row_cap)
    labelled = body.join(labels.hint("shuffle_merge"), ["sheet", "col"]).select("sheet", "row", "col", F.concat(F.col("label"), F.lit(": "), F.trim("value")).alias("part"))
    return _joined(labelled)


def _joined(parts: DataFrame) -> DataFrame:
    ordered = parts.groupBy("sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "part"))).alias("p"))
    return ordered.select("sheet", "row", F.array_join(F.transform("p", lambda x: x["part"]), " | ").alias("text"))


def freeform_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, row, text) of sheets without a header."""
    return _joined(filled(cells).join(headers.hint("shuffle_merge"), "sheet", "left_anti").select("sheet", "row", "col", F.trim("value").alias("part")))


def contract_header(cells: DataFrame, search_rows: int = 12) -> DataFrame:
    """(sheet, header_row, score): 10 for each NOTE, 1 for each contract label."""
    key = S.match_key(F.col("value"))
    score = F.sum(F.when(key == "note", 10).when(key.rlike("thoi vu|chinh thuc"), 1).otherwise(0))
    rows = filled(cells).where(F.col("row") <= search_rows).groupBy("sheet", "row").agg(score.alias("score")).where("score > 0")
    return rows.groupBy("sheet").agg(F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row"))).alias("b")).select("sheet", F.col("b.row").alias("header_row"), F.col("b.score").alias("score"))


def unpivot_matrix(cells: DataFrame) -> DataFrame:
    """(sheet, customer, contract_type, component, cell, value, is_formula, note_col) of salary matrices."""
    head = contract_header(cells).select("sheet", "header_row")
    placed = filled(cells).join(head.hint("shuffle_merge"), "sheet")
    contract = placed.where(F.col("row") == F.col("header_row")).select("sheet", "col", F.trim("value").alias("contract_type"))
    customer = placed.where(F.col("row") == F.col("header_row") - 1).select("sheet", "col", F.trim("value").alias("customer"))
    # the header's columns: a few per sheet
    every = contract.select("sheet", "col").union(customer.select("sheet", "col")).distinct().join(contract.hint("shuffle_merge"), ["sheet", "col"], "left").join(customer.hint("shuffle_merge"), ["sheet", "col"], "left")
    note = S.match_key(F.col("contract_type")) == "note"
    across = Window.partitionBy("sheet").orderBy("col")
    first = F.min(F.when(~note, F.col("col"))).over(Window.partitionBy("sheet"))
    carried = every.select("sheet", "col", "contract_type", F.last("customer", ignorenulls=True).over(across).alias("customer"), F.min(F.when(note, F.col("col"))).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("note_col"), (first - 1).alias("component_col"))
    values = carried.where(F.col("contract_type").isNotNull() & F.col("customer").isNotNull() & (S.match_key(F.col("contract_type")) != "note") & (F.col("component_col") >= 1))
    body = placed.where(F.col("row") > F.col("header_row")).select("sheet", "row", "col", "value")
    component = body.select("sheet", "row", F.col("col").alias("component_col"), F.trim("value").alias("component"))
    joined = body.join(values.hint("shuffle_merge"), ["sheet", "col"]).join(component.hint("shuffle_merge"), ["sheet", "row", "component_col"])
    return joined.select("sheet", "customer", "contract_type", "component", F.concat(column_letters(F.col("col")), F.col("row").cast("string")).alias("cell"), "value", F.startswith("value", F.lit("=")).alias("is_formula"), "note_col")


def lookup_matrix(matrix: DataFrame, keys: DataFrame) -> DataFrame:
    """(key columns, status, cell): each normalized key must match exactly one cell."""
    names = ("customer", "contract_type", "component")
    k = [S.match_key(F.col(c)).alias(f"k_{c}") for c in names]
    found = matrix.select("sheet", *k, "cell").groupBy("sheet", *[f"k_{c}" for c in names]).agg(F.count("*").alias("n"), F.min("cell").alias("cell"))
    asked = keys.select("sheet", *names, *k)
    joined = asked.join(found.hint("shuffle_merge"), ["sheet", *[f"k_{c}" for c in names]], "left")
    status = F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") > 1, "AMBIGUOUS").otherwise("FOUND")
    return joined.select("sheet", *names, status.alias("status"), F.when(F.col("n") == 1, F.col("cell")).alias("cell"))
