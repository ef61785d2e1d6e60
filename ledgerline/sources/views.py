"""Payroll roles played by the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.rules import Formula, Rule, Variable
from ledgerline.plans.base import table


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("employee_id"), F.col("c_nationkey").cast("string").alias("company_id"), F.col("c_mktsegment").alias("employee_type"), (5000000 + F.col("c_acctbal") * 1000).alias("basic_salary"), ((F.col("c_custkey") % 5) * 100000).cast("double").alias("salary_advance"))


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly attendance; overtime from line items of the month's orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("employee_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0)).alias(name) for flag, name in (("N", "n"), ("R", "r"), ("A", "a"))])
    joined = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("employee_id", "period").agg(
        F.lit(26.0).alias("scheduled_work_days"), F.max(20 + F.col("o_orderkey") % 7).cast("double").alias("paid_days"),
        *[F.round(F.sum(F.coalesce(c, F.lit(0.0))) / 10, 4).alias(n) for c, n in (("n", "ot_normal_hours"), ("r", "ot_rest_hours"), ("a", "ot_holiday_hours"))],
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    row = lambda no, kind, value, when: F.when(when, F.struct((k * 10 + no).alias("row_no"), F.lit("MEAL").alias("field_code"), F.lit(kind).alias("employee_type"), value.cast("double").alias("value")))
    rows = F.array_compact(F.array(row(0, "*", 20000 + k * 100, F.lit(True)), row(1, "BUILDING", 25000 + k * 100, k % 3 == 0), row(2, "*", 21000 + k * 100, k % 4 == 0)))
    return n.select(k.cast("string").alias("company_id"), F.inline(rows))


FORMULA = Formula(
    "monthly",
    (
        Variable("basic", "employee", "basic_salary"), Variable("advance", "employee", "salary_advance"), Variable("sched", "attendance", "scheduled_work_days"), Variable("paid", "attendance", "paid_days"),
        Variable("ot1", "attendance", "ot_normal_hours"), Variable("ot2", "attendance", "ot_rest_hours"), Variable("ot3", "attendance", "ot_holiday_hours"), Variable("meal", "rate_config", "MEAL"), Variable("relief", "literal", None, 6000000.0),
    ),
    (
        Rule("NET_BASE", "BASIC_ + OT - SI_EE", section="employer_cost"),
        Rule("PIT_10", "tax_bracket_vn(NET_BASE - relief)", condition="NET_BASE > relief", rounding="round"),
        Rule("BASIC_", "prorate(basic, paid, sched)", rounding="round_down_1000", category="BASIC"),
        Rule("OT", "basic / sched / 8 * (ot1 * 1.5 + ot2 * 2 + ot3 * 3)", rounding="round", category="SALARY_OT"),
        Rule("MEAL_", "meal * paid", category="ALLOWANCE"),
        Rule("BONUS", "500000", condition="paid == sched and ot1 + ot2 + ot3 > 10"),
        Rule("SI_EE", "BASIC_ * 0.08"),
        Rule("SI_ER", "BASIC_ * 0.175"),
        Rule("ADVANCE_", "advance", condition="advance > 0"),
    ),
    {"ADVANCE_": "deductions"},
)

SECOND = Formula(FORMULA.formula_id + "-2", FORMULA.variables, tuple(Rule(r.output, r.expression.replace("0.08", "0.085"), r.condition, r.rounding, r.section, r.category) for r in FORMULA.rules if r.output != "BONUS") + (Rule("SENIORITY", "basic * 0.01", category="BONUS"),), FORMULA.categories)

EMP = "emp AS (SELECT CAST(c_custkey AS VARCHAR) AS employee_id, CAST(c_nationkey AS VARCHAR) AS company_id, c_mktsegment AS employee_type, 5000000 + c_acctbal * 1000 AS basic_salary, CAST((c_custkey % 5) * 100000 AS DOUBLE) AS salary_advance FROM customer)"
ATT = """li AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a FROM lineitem GROUP BY l_orderkey),
att AS (SELECT CAST(o_custkey AS VARCHAR) AS employee_id, strftime(o_orderdate, '%Y-%m') AS period, 26.0::DOUBLE AS scheduled_work_days, CAST(max(20 + o_orderkey % 7) AS DOUBLE) AS paid_days, round(sum(coalesce(n, 0)) / 10, 4) AS ot_normal_hours, round(sum(coalesce(r, 0)) / 10, 4) AS ot_rest_hours, round(sum(coalesce(a, 0)) / 10, 4) AS ot_holiday_hours FROM orders LEFT JOIN li ON o_orderkey = l_orderkey GROUP BY ALL)"""
RATES = """rates AS (SELECT CAST(n_nationkey AS VARCHAR) AS company_id, n_nationkey * 10 AS row_no, 'MEAL' AS field_code, '*' AS employee_type, CAST(20000 + n_nationkey * 100 AS DOUBLE) AS value FROM nation
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_nationkey * 10 + 1, 'MEAL', 'BUILDING', CAST(25000 + n_nationkey * 100 AS DOUBLE) FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_nationkey * 10 + 2, 'MEAL', '*', CAST(21000 + n_nationkey * 100 AS DOUBLE) FROM nation WHERE n_nationkey % 4 = 0)"""
BOUND = f"""{EMP}, {ATT}, {RATES},
exact AS (SELECT company_id, employee_type, max_by(value, row_no) AS v FROM rates WHERE employee_type <> '*' GROUP BY ALL), anyone AS (SELECT company_id, max_by(value, row_no) AS v FROM rates WHERE employee_type = '*' GROUP BY ALL),
bound AS (SELECT emp.employee_id, emp.company_id, period, basic_salary AS basic, salary_advance AS advance, scheduled_work_days AS sched, paid_days AS paid, ot_normal_hours AS ot1, ot_rest_hours AS ot2, ot_holiday_hours AS ot3, coalesce(exact.v, anyone.v) AS meal, 6000000.0::DOUBLE AS relief
FROM emp JOIN att USING (employee_id) LEFT JOIN exact ON emp.company_id = exact.company_id AND emp.employee_type = exact.employee_type LEFT JOIN anyone ON emp.company_id = anyone.company_id)"""


def _tax(x: str) -> str:
    from ledgerline.functions.scalars import TAX_BRACKETS

    parts, lower = [], 0
    for upper, rate in TAX_BRACKETS:
        parts.append(f"greatest(0.0::DOUBLE, {f'least({x}, {upper}.0::DOUBLE)' if upper else x} - {lower}.0::DOUBLE) * {rate}::DOUBLE")
        lower = upper
    return "(" + " + ".join(parts) + ")"


def paid_sql(second: bool = False, name: str = "paid", plain: bool = False) -> str:
    """CTE of results: the rules written out by hand."""
    s = "0.085" if second else "0.08"
    bonus = "basic * 0.01::DOUBLE AS SENIORITY" if second else "CASE WHEN paid = sched AND ot1 + ot2 + ot3 > 10 THEN 500000.0::DOUBLE ELSE 0 END AS BONUS"
    extra = "SENIORITY" if second else "BONUS"
    p = name
    sql = f"""{p}1 AS (SELECT *, floor(basic * paid / sched / 1000) * 1000 AS BASIC_, round_even(basic / sched / 8 * (ot1 * 1.5::DOUBLE + ot2 * 2 + ot3 * 3), 0) AS OT, meal * paid AS MEAL_, {bonus}, CASE WHEN advance > 0 THEN advance ELSE 0 END AS ADVANCE_ FROM bound),
{p}2 AS (SELECT *, BASIC_ * {s}::DOUBLE AS SI_EE, BASIC_ * 0.175::DOUBLE AS SI_ER FROM {p}1),
{p}3 AS (SELECT *, BASIC_ + OT - SI_EE AS NET_BASE FROM {p}2),
{p}4 AS (SELECT *, CASE WHEN NET_BASE > relief THEN round_even({_tax('(NET_BASE - relief)')}, 0) ELSE 0 END AS PIT_10 FROM {p}3),
{p} AS (SELECT *, round(BASIC_ + OT + MEAL_ + {extra}, 2) AS gross, round(PIT_10 + SI_EE + ADVANCE_, 2) AS total_deductions, round(NET_BASE + SI_ER, 2) AS employer_cost, round(BASIC_ + OT + MEAL_ + {extra} - (PIT_10 + SI_EE + ADVANCE_), 2) AS net FROM {p}4)"""
    if plain:
        sql = sql.replace("floor(basic * paid / sched / 1000) * 1000", "basic * paid / sched").replace("round_even(basic / sched", "(basic / sched").replace("+ ot3 * 3), 0)", "+ ot3 * 3))")
        sql = sql.replace(f"round_even({_tax('(NET_BASE - relief)')}, 0)", _tax("(NET_BASE - relief)"))
    return sql
