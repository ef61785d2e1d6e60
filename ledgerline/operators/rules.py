"""Pay rules as Spark columns.

A rule's expression is Python-like text.  It is read once per formula on the
driver with the standard ``ast`` module and turned into a Column; nothing is
interpreted per row.  What the whitelist doesn't name is refused.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "min": lambda *a: F.least(*a),
    "max": lambda *a: F.greatest(*a),
    "round": lambda x, n=None: F.bround(x, 0) if n is None else F.bround(x, n),
    "prorate": S.prorate,
    "round_down": S.round_down,
    "tax_bracket_vn": S.progressive_tax,
}
MAX_NODES = 128

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.FloorDiv: S.floor_div, ast.Mod: S.floor_mod}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


class RuleError(ValueError):
    """A rule that can't be compiled."""


def compile_expression(text: str, names: Mapping[str, Column], functions: Mapping[str, Callable[..., Column]] = FUNCTIONS) -> Column:
    """The Column of an expression over named columns."""
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise RuleError(f"invalid expression: {text}") from e
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        raise RuleError("expression is too long")

    def column(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool() | str()):
                return F.lit(node.value)
            case ast.Constant(value=int() | float()):
                return F.lit(float(node.value))
            case ast.Name(id=name) if name in names:
                return names[name]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](column(a), column(b))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -column(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return column(x)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~column(x)
            case ast.BoolOp(op=op, values=parts):
                return reduce((lambda a, b: a & b) if isinstance(op, ast.And) else (lambda a, b: a | b), map(column, parts))
            case ast.IfExp(test=t, body=a, orelse=b):
                return F.when(column(t), column(a)).otherwise(column(b))
            case ast.Compare():
                return reduce(lambda a, b: a & b, pairs(node))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in functions:
                return functions[name](*map(column, args))
        raise RuleError(f"not allowed: {ast.dump(node)[:60]}")

    def pairs(node: ast.Compare):
        left = node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, ast.In | ast.NotIn):
                if not isinstance(right, ast.List | ast.Tuple):
                    raise RuleError("membership needs a list")
                inside = reduce(lambda a, b: a | b, [column(left) == column(x) for x in right.elts], F.lit(False))
                yield ~inside if isinstance(op, ast.NotIn) else inside
            elif type(op) in _COMPARE:
                yield _COMPARE[type(op)](column(left), column(right))
            else:
                raise RuleError("comparison not allowed")
            left = right

    return column(tree.body)


def names_in(text: str | None, functions=FUNCTIONS) -> set[str]:
    """Names that an expression reads."""
    if not text:
        return set()
    return {n.id for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name)} - set(functions)


@dataclass(frozen=True)
class Variable:
    name: str
    source: str
    field_code: str | None = None
    value: float | None = None


@dataclass(frozen=True)
class Rule:
    output: str
    expression: str
    condition: str | None = None
    rounding: str | None = None
    section: str | None = None
    category: str | None = None


@dataclass(frozen=True)
class Formula:
    formula_id: str
    variables: tuple[Variable, ...]
    rules: tuple[Rule, ...]
    categories: Mapping[str, str] = field(default_factory=dict)
    status: str = "active"


def levels(rules: tuple[Rule, ...]) -> list[list[Rule]]:
    """Rules by dependency level; rules of one level don't read each other."""
    outputs = [r.output for r in rules]
    if len(set(outputs)) < len(outputs):
        raise RuleError("duplicate output")
    needs = {r.output: (names_in(r.expression) | names_in(r.condition)) & set(outputs) for r in rules}
    out, done = [], set()
    while len(done) < len(rules):
        ready = [r for r in rules if r.output not in done and needs[r.output] <= done]
        if not ready:
            raise RuleError(f"circular rules: {sorted(set(outputs) - done)}")
        out.append(ready)
        done |= {r.output for r in ready}
    return out


def run_rules(inputs: DataFrame, formula: Formula, mode: str = "payroll", functions: Mapping[str, Callable[..., Column]] | None = None) -> DataFrame:
    """Adds a column for each rule's output.

    ``payroll``: dependency order, a false condition gives 0.  ``sequential``:
    declaration order, a false condition gives null.
    """
    known = {**FUNCTIONS, **(functions or {})}
    names = {v.name: F.col(f"`{v.name}`") for v in formula.variables}
    out = inputs
    for level in levels(formula.rules) if mode == "payroll" else [[r] for r in formula.rules]:
        columns = {}
        for r in level:
            value = S.rounded(compile_expression(r.expression, names, known).cast("double"), r.rounding)
            if r.condition:
                value = F.when(compile_expression(r.condition, names, known), value)
                value = value.otherwise(F.lit(0.0)) if mode == "payroll" else value
            columns[r.output] = value
        out = out.withColumns(columns)
        names |= {c: F.col(f"`{c}`") for c in columns}
    return out


def sections(formula: Formula) -> dict[str, str]:
    """Each output's section: its own, mapped, its category's, or by its name."""
    by_category = dict.fromkeys(("BHXH", "PIT", "DEDUCTION_OTHER"), "deductions") | dict.fromkeys(("BASIC", "ALLOWANCE", "BONUS", "SALARY_OT"), "line_items")

    def by_name(code: str) -> str:
        if code == "PIT_PROGRESSIVE" or code.endswith("_EE") or code.startswith("PIT_"):
            return "deductions"
        return "employer_cost" if code.endswith("_ER") else "line_items"

    return {r.output: r.section or formula.categories.get(r.output) or by_category.get(r.category or "") or by_name(r.output) for r in formula.rules}


def payroll_items(results: DataFrame, formula: Formula, *keys: str) -> DataFrame:
    """Long form: (keys, section, field_code, amount)."""
    where = sections(formula)
    items = F.array(*[F.struct(F.lit(where[r.output]).alias("section"), F.lit(r.output).alias("field_code"), F.col(f"`{r.output}`").alias("amount")) for r in formula.rules])
    return results.select(*keys, F.inline(items))


def with_totals(results: DataFrame, formula: Formula) -> DataFrame:
    """Adds gross, total_deductions, employer_cost and net; a row-wise sum, no shuffle."""
    where = sections(formula)

    def total(section: str) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"`{r.output}`") for r in formula.rules if where[r.output] == section], F.lit(0.0))

    return results.withColumns({"gross": total("line_items"), "total_deductions": total("deductions"), "employer_cost": total("employer_cost")}).withColumn("net", F.col("gross") - F.col("total_deductions"))


def explain_rules(inputs: DataFrame, formula: Formula, *keys: str) -> DataFrame:
    """(keys, rule, inputs, passed, result): per rule what it read (in hundredths) and gave, before rounding."""
    plain = Formula(formula.formula_id, formula.variables, tuple(Rule(r.output, r.expression, r.condition) for r in formula.rules))
    ran = run_rules(inputs, plain)
    names = {v.name: F.col(f"`{v.name}`") for v in formula.variables} | {r.output: F.col(f"`{r.output}`") for r in formula.rules}
    rows = []
    for r in formula.rules:
        read = sorted(names_in(r.expression) | names_in(r.condition))
        seen = F.concat_ws(";", *[F.concat(F.lit(f"{n}="), F.coalesce(F.floor(names[n] * 100).cast("string"), F.lit(""))) for n in read])
        passed = compile_expression(r.condition, names) if r.condition else F.lit(True)
        rows.append(F.struct(F.lit(r.output).alias("rule"), seen.alias("inputs"), passed.alias("passed"), names[r.output].alias("result")))
    return ran.select(*keys, F.inline(F.array(*rows)))
