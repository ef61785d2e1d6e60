"""Formulas as tables: repair of written rules, and checks before use."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.rules import FUNCTIONS
from ledgerline.sources.io import written

SOURCES = ("employee", "attendance", "rate_config", "regulatory", "literal")
SECTIONS = ("line_items", "deductions", "employer_cost")
#: Categories that are deductions, and input columns that describe overtime rules.
DEDUCTIONS = ("BHXH", "PIT", "DEDUCTION_OTHER")
OT_ATTRIBUTES = ("shift_type", "day_type")
#: Names by which a rounding may be written.
ROUND_NAMES = ("round", "round_to_nearest", "round_to_nearest_currency", "nearest_currency")
FLOOR_NAMES = ("round_down", "floor", "floor_currency")


def rewrite_expression(text: Column) -> Column:
    """Pseudo-syntax to expressions: ``employee.``, true / false, if-then-else."""
    out = F.regexp_replace(F.replace(F.trim(text), F.lit("employee."), F.lit("")), r"(?i)\btrue\b", "True")
    out = F.regexp_replace(out, r"(?i)\bfalse\b", "False")
    return F.regexp_replace(out, r"(?i)^if\s+(.+?)\s+then\s+(.+?)\s+else\s+(.+)$", "($2) if ($1) else ($3)")


def rounding_name(raw: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(v.isin("", "none", "no", "null"), None).when(v.isin(*ROUND_NAMES), "round").when(v.isin(*FLOOR_NAMES), "round_down_1000").otherwise(v)


def _read(text: str | None) -> dict:
    """What an expression reads and whether it is allowed."""
    if text is None:
        return {"ok": True, "names": [], "bad": []}
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, ValueError):
        return {"ok": False, "names": [], "bad": []}
    fine = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.Call, ast.Name, ast.Constant, ast.Load, ast.List, ast.Tuple, ast.boolop, ast.cmpop, ast.unaryop, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod)
    nodes = list(ast.walk(tree))
    called = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
    bad = {type(n).__name__ for n in nodes if not isinstance(n, fine) or isinstance(n, ast.Is | ast.IsNot)} | {"Call" for n in nodes if isinstance(n, ast.Call) and (not isinstance(n.func, ast.Name) or n.func.id not in FUNCTIONS or n.keywords)} | {"Constant" for n in nodes if isinstance(n, ast.Constant) and not isinstance(n.value, int | float | bool | str)}
    return {"ok": True, "names": sorted({n.id for n in nodes if isinstance(n, ast.Name) and id(n) not in called}), "bad": sorted(bad)}


def expression_facts(text: Column) -> Column:
    """struct(ok, names, bad) of an expression."""

    @F.pandas_udf("struct<ok:boolean,names:array<string>,bad:array<string>>")
    def facts(texts: pd.Series) -> pd.DataFrame:
        read = {t: _read(t) for t in texts.unique()}
        return pd.DataFrame([read[t] for t in texts])

    return facts(text)


def clean_rules(rules: DataFrame) -> DataFrame:
    """Rules ``(formula_id, place, output_field, expression, condition, rounding, section)`` repaired:
    rewritten expressions, prose conditions dropped, ``net`` rules dropped, repeated outputs numbered."""
    out = rules.withColumns({"expression": rewrite_expression(F.col("expression")), "condition": rewrite_expression(F.col("condition")), "rounding": rounding_name(F.col("rounding"))})
    out = out.withColumn("condition", F.when(expression_facts(F.col("condition"))["ok"], F.col("condition")))
    n = F.row_number().over(Window.partitionBy("formula_id", "output_field").orderBy("place"))
    out = out.withColumn("nth", n).withColumn("output_field", F.when(F.col("nth") > 1, F.concat_ws("_", "output_field", F.col("nth").cast("string"))).otherwise(F.col("output_field")))
    return out.where(F.coalesce(F.lower(F.trim("section")), F.lit("")) != "net").drop("nth")


def prepare_variables(variables: DataFrame) -> DataFrame:
    """Variables ``(name, source, field_code, value)`` ready to run: a rate or regulatory
    one becomes a literal if it has a value, else an input of the employee of its name."""
    open_source = F.col("source").isin("rate_config", "regulatory")
    without = open_source & F.col("value").isNull()
    return variables.withColumns({"source": F.when(without, "employee").when(open_source, "literal").otherwise(F.col("source")), "field_code": F.when(without, F.col("name")).otherwise(F.col("field_code"))})


def circular_outputs(reads: DataFrame) -> DataFrame:
    """(formula_id, output_field) of ``reads (formula_id, output_field, name)``, where ``name`` is
    another rule's output, that no order of evaluation reaches.

    A formula's reads are one array.  A round takes out what reads no output
    that is left; after as many rounds as there are outputs nothing changes.
    """
    item = F.struct("output_field", "name")
    packed = reads.groupBy("formula_id").agg(F.collect_set(item).alias("reads"), F.count_distinct("output_field").alias("n"))
    after = lambda left, _: F.filter(left, lambda r: F.exists(left, lambda o: o["output_field"] == r["name"]))
    left = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.col("reads"), after)
    return packed.select("formula_id", F.explode(F.array_distinct(F.transform(left, lambda r: r["output_field"]))).alias("output_field"))


def lint_formulas(variables: DataFrame, rules: DataFrame, known_codes: tuple[str, ...], categories: DataFrame | None = None) -> DataFrame:
    """(formula_id, place, issue): what keeps a formula from running.

    ``categories (formula_id, code, section)`` are the sections that a formula
    gives its outputs; they must agree with the ``category`` of a rule, if the
    rules have that column.  Issues that only warn begin with ``warning``.
    Each check reads the rules again, so they are parsed once and written.
    """
    issue = lambda df, text: df.select("formula_id", F.coalesce(F.col("place").cast("int"), F.lit(-1)).alias("place"), text.alias("issue"))
    variables = written(variables, "variables")
    facts = rules.withColumn("e", expression_facts(F.col("expression"))).withColumn("c", expression_facts(F.col("condition"))).withColumn("names", F.array_union(F.coalesce("e.names", F.array().cast("array<string>")), F.coalesce("c.names", F.array().cast("array<string>"))))
    facts = written(facts, "facts")
    rules = facts.select(*rules.columns)
    outputs = rules.select("formula_id", F.col("output_field").alias("name"))
    known = variables.select("formula_id", "name").unionByName(outputs).distinct()
    reads = facts.select("formula_id", "place", "output_field", F.explode("names").alias("name")).where(~F.col("name").isin("True", "False"))
    unit = F.regexp_extract("rounding", r"^round_down_(\d+(?:\.\d+)?)$", 1)
    bad_rounding = F.col("rounding").isNotNull() & ~F.col("rounding").isin("round", "round_down") & ((unit == "") | (unit.try_cast("double") <= 0))
    v = variables.withColumn("place", F.lit(None).cast("int"))
    found = [
        issue(facts.where("not e.ok"), F.lit("invalid syntax")),
        issue(facts.where("size(e.bad) > 0 or size(c.bad) > 0"), F.concat(F.lit("forbidden: "), F.array_join(F.array_union("e.bad", "c.bad"), ","))),
        issue(reads.join(known.hint("shuffle_merge"), ["formula_id", "name"], "left_anti"), F.concat(F.lit("unknown variable: "), F.col("name"))),
        issue(rules.where(~F.col("output_field").isin(*known_codes)), F.concat(F.lit("not in catalog: "), F.col("output_field"))),
        issue(rules.where(F.col("section").isNotNull() & ~F.col("section").isin(*SECTIONS)), F.concat(F.lit("invalid section: "), F.col("section"))),
        issue(rules.where(bad_rounding), F.concat(F.lit("invalid rounding: "), F.col("rounding"))),
        issue(v.where(~F.col("source").isin(*SOURCES)), F.concat(F.lit("invalid source: "), F.col("source"))),
        issue(v.where(F.col("source").isin("employee", "attendance") & (F.col("field_code") != S.canonical_code(F.col("field_code")))), F.concat(F.lit("alias code: "), F.col("field_code"))),
        issue(v.groupBy("formula_id", "name", "place").count().where("count > 1"), F.concat(F.lit("duplicate variable: "), F.col("name"))),
    ]
    v_rows = variables.select("formula_id").distinct().withColumn("place", F.lit(None).cast("int"))
    found += [
        issue(v.where(F.lower("field_code").isin(*OT_ATTRIBUTES) & (F.col("source") == "attendance")), F.concat(F.lit("overtime attribute as input: "), F.col("field_code"))),
        issue(outputs.groupBy("formula_id", "name").count().where("count > 1").withColumn("place", F.lit(None).cast("int")), F.concat(F.lit("duplicate output: "), F.col("name"))),
        issue(v_rows.join(rules.select("formula_id").distinct().hint("shuffle_merge"), "formula_id", "left_anti"), F.lit("no rules")),
    ]
    inner = reads.join(outputs.distinct().hint("shuffle_merge"), ["formula_id", "name"]).select("formula_id", "output_field", "name")
    found.append(circular_outputs(inner).select("formula_id", F.lit(-1).alias("place"), F.concat(F.lit("circular: "), F.col("output_field")).alias("issue")))
    if categories is not None:
        found += _category_issues(rules, categories, known_codes, issue)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _category_issues(rules: DataFrame, categories: DataFrame, known_codes: tuple[str, ...], issue) -> list[DataFrame]:
    """Income and deductions must be told apart alike by the formula's sections and its rules' categories."""
    c = categories.withColumn("place", F.lit(None).cast("int"))
    said = F.concat_ws("=", "code", "section")
    out = [issue(c.where(~F.col("code").isin(*known_codes) | ~F.col("section").isin(*SECTIONS)), F.concat(F.lit("invalid field category: "), said))]
    if "category" in rules.columns:
        of_rule = rules.where("category is not null").groupBy("formula_id", F.col("output_field").alias("code")).agg(F.max_by("category", "place").alias("category"))
        both = c.join(of_rule.hint("shuffle_merge"), ["formula_id", "code"])
        deducts = F.col("category").isin(*DEDUCTIONS)
        out.append(issue(both.where(((F.col("section") == "deductions") & ~deducts) | ((F.col("section") == "line_items") & deducts)), F.concat(F.lit("inconsistent with "), F.col("category"), F.lit(": "), said)))
    seen = c.groupBy("formula_id").agg(F.collect_set("section").alias("s")).withColumn("place", F.lit(None).cast("int"))
    income, deductions = F.array_contains("s", "line_items"), F.array_contains("s", "deductions")
    out.append(issue(seen.where(income & ~deductions), F.lit("warning: income without deductions")))
    out.append(issue(seen.where(deductions & ~income), F.lit("warning: deductions without income")))
    return out
