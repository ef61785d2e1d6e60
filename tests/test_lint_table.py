"""e5: every issue of the whole table against a plain reading of the same rules."""

import ast
from collections import Counter

from ledgerline.functions import scalars as S
from ledgerline.operators import formulas
from ledgerline.plans import change_queries
from pyspark.sql import functions as F

ALLOWED = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.Call, ast.Name, ast.Constant, ast.Load, ast.List, ast.Tuple, ast.boolop, ast.cmpop, ast.unaryop, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod)


def facts(text):
    """(syntax is right, names read, kinds of forbidden nodes)."""
    if text is None:
        return True, set(), set()
    try:
        nodes = list(ast.walk(ast.parse(text, mode="eval")))
    except SyntaxError:
        return False, set(), set()
    called = [n.func for n in nodes if isinstance(n, ast.Call)]
    return True, {n.id for n in nodes if isinstance(n, ast.Name) and n not in called}, {type(n).__name__ for n in nodes if not isinstance(n, ALLOWED)}


def circular(reads):
    """Outputs that no order reaches; ``reads`` maps each output to the outputs it reads."""
    left = {o: set(r) for o, r in reads.items() if r}
    while True:
        free = [o for o, r in left.items() if not r & left.keys()]
        if not free:
            return set(left)
        for o in free:
            del left[o]


def plain(variables, rules, codes, categories, canonical):
    out = Counter()
    for f in {v["formula_id"] for v in variables} | {r["formula_id"] for r in rules} | {c["formula_id"] for c in categories}:
        vs, rs, cs = ([x for x in rows if x["formula_id"] == f] for rows in (variables, rules, categories))
        outputs = {r["output_field"] for r in rs}
        known, reads = {v["name"] for v in vs} | outputs, {}
        for r in rs:
            (ok, names, bad), (_, more, worse) = facts(r["expression"]), facts(r["condition"])
            if not ok:
                out[f, r["place"], "invalid syntax"] += 1
            if bad | worse:
                out[f, r["place"], "forbidden: " + ",".join(sorted(bad | worse))] += 1
            for n in (names | more) - known - {"True", "False"}:
                out[f, r["place"], f"unknown variable: {n}"] += 1
            reads.setdefault(r["output_field"], set()).update((names | more) & outputs)
            if r["output_field"] not in codes:
                out[f, r["place"], f"not in catalog: {r['output_field']}"] += 1
            if r["section"] is not None and r["section"] not in formulas.SECTIONS:
                out[f, r["place"], f"invalid section: {r['section']}"] += 1
            if r["rounding"] is not None and r["rounding"] not in ("round", "round_down", "round_down_1000"):
                out[f, r["place"], f"invalid rounding: {r['rounding']}"] += 1
        for v in vs:
            if v["source"] not in formulas.SOURCES:
                out[f, -1, f"invalid source: {v['source']}"] += 1
            elif v["field_code"] != canonical[v["field_code"]]:
                out[f, -1, f"alias code: {v['field_code']}"] += 1
        for o, n in Counter(r["output_field"] for r in rs).items():
            if n > 1:
                out[f, -1, f"duplicate output: {o}"] += 1
        for n, m in Counter(v["name"] for v in vs).items():
            if m > 1:
                out[f, -1, f"duplicate variable: {n}"] += 1
        if vs and not rs:
            out[f, -1, "no rules"] += 1
        for o in circular(reads):
            out[f, -1, f"circular: {o}"] += 1
        said = {}
        for r in sorted(rs, key=lambda r: r["place"]):
            if r["category"] is not None:
                said[r["output_field"]] = r["category"]
        for c in cs:
            if c["code"] not in codes or c["section"] not in formulas.SECTIONS:
                out[f, -1, f"invalid field category: {c['code']}={c['section']}"] += 1
            kind = said.get(c["code"])
            if kind and (c["section"] == "deductions") != (kind in formulas.DEDUCTIONS) and c["section"] in ("deductions", "line_items"):
                out[f, -1, f"inconsistent with {kind}: {c['code']}={c['section']}"] += 1
        sections = {c["section"] for c in cs}
        if "line_items" in sections and "deductions" not in sections:
            out[f, -1, "warning: income without deductions"] += 1
        if "deductions" in sections and "line_items" not in sections:
            out[f, -1, "warning: deductions without income"] += 1
    return out


def test_lint_of_the_whole_table(spark, sf_dir, monkeypatch):
    seen, real = [], formulas.lint_formulas
    monkeypatch.setattr(formulas, "lint_formulas", lambda *x: seen.append(x) or real(*x))
    got = Counter((r["formula_id"], r["place"], r["issue"]) for r in change_queries.e5(spark, sf_dir).collect())
    variables, rules, codes, categories = seen[0]
    canonical = {r["c"]: r["k"] for r in variables.select(F.col("field_code").alias("c"), S.canonical_code(F.col("field_code")).alias("k")).distinct().collect()}
    want = plain(*([r.asDict() for r in df.collect()] for df in (variables, rules)), codes, [r.asDict() for r in categories.collect()], canonical)
    assert got == want
    assert {k[2].split(":")[0] for k in got} >= {"invalid syntax", "forbidden", "unknown variable", "not in catalog", "circular", "invalid source", "alias code", "invalid section"}


def test_rules_are_parsed_once(spark, sf_dir):
    """The checks read parsed rules from a table; none of them parses again."""
    plan = change_queries.e5(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
