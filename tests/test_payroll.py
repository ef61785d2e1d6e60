"""Pay rules, totals, flags and inputs on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import ingest, payroll
from ledgerline.operators.rules import Formula, Rule, RuleError, Variable, compile_expression, levels, run_rules, sections, with_totals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("income", "tax"), [(0, 0), (-5, 0), (5_000_000, 250_000), (10_000_000, 750_000), (18_000_000, 1_950_000), (90_000_000, 5_000_000 * 0.05 + 5_000_000 * 0.1 + 8_000_000 * 0.15 + 14_000_000 * 0.2 + 20_000_000 * 0.25 + 28_000_000 * 0.3 + 10_000_000 * 0.35)])
def test_tax(spark, income, tax):
    assert one(spark, S.progressive_tax(F.lit(float(income)))) == pytest.approx(tax)


def test_arithmetic(spark):
    assert one(spark, S.floor_mod(F.lit(7.0), F.lit(-3.0))) == -2.0
    assert one(spark, S.floor_div(F.lit(1.0), F.lit(0.1))) == 9.0
    assert one(spark, S.floor_mod(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.round_down(F.lit(4_002_999.0))) == 4_002_000.0 and one(spark, S.round_down(F.lit(1.0), 0)) is None
    assert one(spark, S.prorate(F.lit(26.0), F.lit(13.0), F.lit(26.0))) == 13.0 and one(spark, S.prorate(F.lit(1.0), F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.rounded(F.lit(2.5), "round")) == 2.0 and one(spark, S.rounded(F.lit(2999.0), "round_down")) == 2000.0
    with pytest.raises(ValueError):
        S.rounded(F.lit(1.0), "up")


CASE = Formula(
    "f", (Variable("basic", "rate_config", "BASIC"), Variable("meal", "rate_config", "MEAL"), Variable("days", "attendance", "days"), Variable("std", "attendance", "std"), Variable("ot", "attendance", "ot")),
    (Rule("NET_SI", "BASIC_PAY - SI_EE", section="employer_cost"), Rule("BASIC_PAY", "prorate(basic, days, std)", rounding="round_down_1000"), Rule("OT_PAY", "basic / std / 8 * 1.5 * ot"), Rule("SI_EE", "BASIC_PAY * 0.08")),
)


def case(spark):
    emp = spark.createDataFrame([("1", "c", "official"), ("2", "c", "other"), ("3", "c", "official")], "employee_id string, company_id string, employee_type string")
    att = spark.createDataFrame([("1", "2024-01", 22.0, 26.0, 8.0), ("2", "2024-01", 26.0, 26.0, 0.0)], "employee_id string, period string, days double, std double, ot double")
    rates = spark.createDataFrame([("c", 1, "BASIC", "official", 4_730_000.0), ("c", 2, "BASIC", "*", 4_000_000.0), ("c", 3, "MEAL", "official", 1.0), ("c", 4, "MEAL", "official", 2.0)], "company_id string, row_no int, field_code string, employee_type string, value double")
    return payroll.bind_inputs(emp, att, rates, CASE)


def test_run(spark):
    bound = case(spark)
    rows = {r["employee_id"]: r for r in bound.collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["meal"] == 2.0 and rows["2"]["errors"] == ["missing meal"]
    r = with_totals(run_rules(bound, CASE), CASE).where("employee_id = '1'").first()
    assert r["BASIC_PAY"] == 4_002_000 and r["SI_EE"] == pytest.approx(320_160) and r["gross"] == pytest.approx(4_002_000 + 4_730_000 / 26 / 8 * 1.5 * 8)
    assert r["net"] == pytest.approx(r["gross"] - 320_160) and r["NET_SI"] == pytest.approx(4_002_000 - 320_160)
    assert [[x.output for x in level] for level in levels(CASE.rules)] == [["BASIC_PAY", "OT_PAY"], ["SI_EE"], ["NET_SI"]]
    assert sections(CASE) == {"NET_SI": "employer_cost", "BASIC_PAY": "line_items", "OT_PAY": "line_items", "SI_EE": "deductions"}
    with pytest.raises(Exception, match="missing meal"):
        payroll.bind_inputs(*_inputs(spark), CASE, strict=True).collect()


def _inputs(spark):
    emp = spark.createDataFrame([("2", "c", "other")], "employee_id string, company_id string, employee_type string")
    att = spark.createDataFrame([("2", "2024-01", 26.0, 26.0, 0.0)], "employee_id string, period string, days double, std double, ot double")
    rates = spark.createDataFrame([("c", 2, "BASIC", "*", 4_000_000.0)], "company_id string, row_no int, field_code string, employee_type string, value double")
    return emp, att, rates


@pytest.mark.parametrize("text", ["__import__('os')", "x.y", "lambda: 1", "x ** 2", "unknown + 1", "min(x, key=1)", "[i for i in x]", "x if", "x in 5", "+".join(["x"] * 200)])
def test_refused(spark, text):
    with pytest.raises(RuleError):
        compile_expression(text, {"x": F.lit(1.0)})


def test_conditions(spark):
    names = {"x": F.lit(3.0), "s": F.lit("full")}
    for text, want in (("1 < x <= 3", True), ("s in ('full', 'half')", True), ("s not in ['full']", False), ("not x > 5 and s == 'full'", True), ("x // 2 + x % 2", 2.0), ("-x if x > 1 else 0", -3.0), ("x / 0", None)):
        assert one(spark, compile_expression(text, names)) == want
    rule = Formula("f", (Variable("x", "literal"),), (Rule("A", "x", condition="x > 5"),))
    df = spark.createDataFrame([(3.0,)], "x double")
    assert run_rules(df, rule).first()["A"] == 0.0 and run_rules(df, rule, mode="sequential").first()["A"] is None
    with pytest.raises(RuleError):
        levels((Rule("A", "B"), Rule("B", "A")))


def test_flags(spark):
    f = Formula("f", (), (Rule("X", "0"),))
    df = spark.createDataFrame([(2_500_000.0, 3_000_000.0, 300_000.0, -1.0, 2_000_000.0, 210.0, 11.0, 22.0)], "net double, gross double, total_deductions double, X double, baseline double, ot_hours double, paid double, sched double")
    codes = lambda **o: [x["code"] for x in payroll.anomaly_flags(df, f, **o).first()["flags"]]
    assert codes(minimum_wage=F.lit(3_500_000.0), max_ot_hours=F.lit(200.0)) == ["NET_RECONCILIATION_MISMATCH", "NEGATIVE_AMOUNT", "NET_SALARY_DEVIATION", "BELOW_MINIMUM_WAGE", "OT_HOURS_EXCEEDED"]
    assert codes(minimum_wage=F.lit(3_500_000.0), prorate_minimum_wage=True) == ["NET_RECONCILIATION_MISMATCH", "NEGATIVE_AMOUNT", "NET_SALARY_DEVIATION"]


def test_impact(spark):
    t = "employee_id string, period string, gross double, net double"
    a = spark.createDataFrame([("1", "p", 10.0e6, 9.0e6), ("2", "p", 1.0, 1.0), ("3", "p", 1.0, 1.0)], t)
    b = spark.createDataFrame([("1", "p", 10.5e6, 9.45e6), ("2", "p", 1.0, 1.0), ("4", "p", 1.0, 1.0)], t)
    got = {r["employee_id"]: (r["status"], r["gross_delta"], r["net_delta"]) for r in payroll.impact_report(a, b).collect()}
    assert got == {"1": ("CHANGED", 500_000.0, 450_000.0), "2": ("UNCHANGED", 0.0, 0.0), "3": ("MISSING_AFTER", None, None), "4": ("MISSING_BEFORE", None, None)}


def test_ingest(spark):
    assert one(spark, S.id_text(F.lit("21083.0"))) == "21083" and one(spark, S.id_text(F.lit(" 007 "))) == "007"
    assert one(spark, S.hours(F.lit("2.5h"))) == 2.5 and one(spark, S.hours(F.lit("2 days"))) is None
    labels = {"Lương cơ bản (VND)": "basic_salary", "Ngày công chuẩn": "standard_working_days", "Số ngày công": "total_working_days", "Giờ tăng ca đêm ngày lễ 300%": "salary_ot_night_holiday_300", "Đơn giá": "don_gia", "": "field"}
    for text, code in labels.items():
        assert one(spark, S.suggest_code(F.lit(text))) == code
    assert one(spark, S.normalize_label(F.lit("Đi làm"))) == "di_lam" and one(spark, S.slug(F.lit("Đi làm"))) == "i_lam"
    rows = spark.createDataFrame([(26.0, 26.0, 2.0, 3.5, None), (26.0, 20.0, None, None, 7.0)], "scheduled_work_days double, paid_days double, a double, b double, overtime_hours double")
    got = payroll.derive_attendance(rows, ("a", "b")).collect()
    assert (got[0]["overtime_hours"], got[0]["is_full_month"]) == (5.5, True) and (got[1]["overtime_hours"], got[1]["is_partial_month"]) == (7.0, True)
    headers = spark.createDataFrame([("s", 1, "Base pay"), ("s", 2, "Lương tháng"), ("s", 3, "basic"), ("s", 4, "Meal Allowance")], "sheet string, col int, label string")
    need = spark.createDataFrame([("s", c) for c in ("base_salary", "basic_salary", "meal_allowance", "iban")], "sheet string, field_code string")
    assert {r["field_code"]: r["label"] for r in ingest.map_columns(headers, need, None).collect()} == {"base_salary": "Lương tháng", "basic_salary": "basic", "meal_allowance": "Meal Allowance", "iban": None}
