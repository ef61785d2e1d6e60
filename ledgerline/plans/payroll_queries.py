"""Queries of the payroll run: binding, rules, totals, flags, reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ledgerline.operators import payroll as P
from ledgerline.operators import rules as R
from ledgerline.plans.base import query, table
from ledgerline.sources import io, views as V

FM = V.FORMULA
PAID = f"WITH {V.BOUND}, {V.paid_sql()}"


def bound(spark, d):
    return P.bind_inputs(V.employees(spark, d), V.attendance(spark, d), V.rates(spark, d), FM)


def paid(spark, d, formula=FM):
    return P.run_payroll(bound(spark, d), formula)


def flagged(spark, d):
    rows = P.baseline(paid(spark, d)).withColumn("ot_hours", F.col("ot1") + F.col("ot2") + F.col("ot3"))
    number = F.col("company_id").cast("int")
    wage = F.when(number % 2 == 0, 3500000.0 + 100000 * number)
    hours = F.when(number % 3 == 0, 15.0 + number)
    return P.anomaly_flags(rows, FM, minimum_wage=wage, max_ot_hours=hours, change_percent=F.when(number % 5 == 0, 10.0).otherwise(20.0))


@query("d1_emp_att", f"WITH {V.EMP}, {V.ATT} SELECT emp.employee_id, period, employee_type, paid_days FROM emp JOIN att USING (employee_id)")
def d1(spark, d):
    return V.employees(spark, d).join(V.attendance(spark, d), "employee_id").select("employee_id", "period", "employee_type", "paid_days")


@query("d2_rate_lookup", f"""WITH {V.EMP}, {V.RATES} SELECT employee_id, coalesce((SELECT max_by(value, row_no) FROM rates r WHERE r.company_id = emp.company_id AND r.employee_type = emp.employee_type), (SELECT max_by(value, row_no) FROM rates r WHERE r.company_id = emp.company_id AND r.employee_type = '*')) AS meal FROM emp""")
def d2(spark, d):
    return P.rate_lookup(V.employees(spark, d), V.rates(spark, d), "MEAL", "meal").select("employee_id", "meal")


@query("d3_bind", f"WITH {V.BOUND} SELECT employee_id, period, basic, advance, sched, paid, ot1, ot2, ot3, meal, relief, 0 AS n_errors FROM bound")
def d3(spark, d):
    return bound(spark, d).select("employee_id", "period", *[v.name for v in FM.variables], F.size("errors").alias("n_errors"))


@query("e1_run_rules", PAID + " SELECT employee_id, period, BASIC_ AS basic_out, OT, MEAL_ AS meal_out, BONUS, round(SI_EE, 4) AS SI_EE, PIT_10, ADVANCE_ AS advance_out FROM paid")
def e1(spark, d):
    r = R.run_rules(bound(spark, d), FM)
    return r.select("employee_id", "period", F.col("BASIC_").alias("basic_out"), "OT", F.col("MEAL_").alias("meal_out"), "BONUS", F.round("SI_EE", 4).alias("SI_EE"), "PIT_10", F.col("ADVANCE_").alias("advance_out"))


ORDERED = replace(FM, rules=tuple(r for level in R.levels(FM.rules) for r in level))


@query("e2_sequential", PAID + " SELECT employee_id, period, BASIC_ AS basic_out, CASE WHEN paid = sched AND ot1 + ot2 + ot3 > 10 THEN BONUS END AS BONUS, CASE WHEN NET_BASE > relief THEN PIT_10 END AS PIT_10, CASE WHEN advance > 0 THEN advance END AS advance_out FROM paid")
def e2(spark, d):
    r = R.run_rules(bound(spark, d), ORDERED, mode="sequential")
    return r.select("employee_id", "period", F.col("BASIC_").alias("basic_out"), "BONUS", "PIT_10", F.col("ADVANCE_").alias("advance_out"))


@query("e3_payroll", PAID + " SELECT employee_id, period, gross, total_deductions, employer_cost, net FROM paid")
def e3(spark, d):
    return paid(spark, d).select("employee_id", "period", *[F.round(c, 2).alias(c) for c in ("gross", "total_deductions", "employer_cost", "net")])


@query("e4_section_totals", PAID + " SELECT employee_id, 'deductions' AS section, round(sum(ADVANCE_), 2) AS total FROM paid GROUP BY employee_id")
def e4(spark, d):
    mapped = replace(FM, rules=tuple(r for r in FM.rules if r.output in FM.categories))
    return R.payroll_items(paid(spark, d), mapped, "employee_id").groupBy("employee_id", "section").agg(F.round(F.sum("amount"), 2).alias("total"))


def _explained() -> str:
    """Each rule's inputs, condition and result before rounding, in SQL."""
    parts = []
    conditions = {"PIT_10": "NET_BASE > relief", "BONUS": "paid = sched AND ot1 + ot2 + ot3 > 10", "ADVANCE_": "advance > 0"}
    for r in FM.rules:
        names = sorted(R.names_in(r.expression) | R.names_in(r.condition))
        inputs = " || ';' || ".join(f"'{n}=' || CAST(CAST(floor({n} * 100) AS BIGINT) AS VARCHAR)" for n in names)
        parts.append(f"SELECT employee_id, period, '{r.output}' AS rule, {inputs} AS inputs, {conditions.get(r.output, 'true')} AS passed, floor({r.output} * 100) / 100 AS result FROM paid")
    return " UNION ALL ".join(parts)


@query("e6_explain", f"WITH {V.BOUND}, {V.paid_sql(plain=True)} " + _explained())
def e6(spark, d):
    return R.explain_rules(bound(spark, d), FM, "employee_id", "period").withColumn("result", F.floor(F.col("result") * 100) / 100)


@query("e9_gate", f"WITH {V.EMP} SELECT employee_id, company_id = CAST(CAST(employee_id AS BIGINT) % 25 AS VARCHAR) AS company_ok, CAST(employee_id AS BIGINT) % 4 = 0 AS status_ok, true AS outputs_ok FROM emp")
def e9(spark, d):
    number = F.col("employee_id").cast("bigint")
    unique = len({r.output for r in FM.rules}) == len(FM.rules)
    rows = V.employees(spark, d).withColumns({"formula_company": (number % 25).cast("string"), "status": F.when(number % 4 == 0, "active").otherwise("draft")})
    return rows.select("employee_id", (F.col("company_id") == F.col("formula_company")).alias("company_ok"), (F.col("status") == "active").alias("status_ok"), F.lit(unique).alias("outputs_ok"))


@query("e10_udf", f"WITH {V.BOUND} SELECT employee_id, period, CASE WHEN basic * 0.1::DOUBLE > 700000 THEN 700000 ELSE basic * 0.1::DOUBLE END AS CAPPED FROM bound")
def e10(spark, d):
    extra = replace(FM, rules=(R.Rule("CAPPED", "cap(basic * 0.1, 700000)"),))
    return R.run_rules(bound(spark, d), extra, functions={"cap": lambda x, most: F.when(x > most, most).otherwise(x)}).select("employee_id", "period", "CAPPED")


@query("d4_merge_sheets", """WITH s AS (SELECT o_custkey, o_orderstatus AS code, max(o_orderpriority) AS v, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY ALL)
SELECT CAST(o_custkey AS VARCHAR) AS employee_id, max(v) FILTER (WHERE code = 'F') AS F, max(v) FILTER (WHERE code = 'O') AS O, max(v) FILTER (WHERE code = 'P') AS P, count(*) FILTER (WHERE n > 1) AS conflicts FROM s GROUP BY o_custkey""")
def d4(spark, d):
    from ledgerline.operators.ingest import merge_sheets

    long = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("employee_id"), F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("value"))
    return merge_sheets(long, ["F", "O", "P"])


@query("d5_merge_employees", """SELECT CAST(o_custkey AS VARCHAR) AS employee_id, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS basic_salary, count(*) - count(DISTINCT strftime(o_orderdate, '%Y-%m')) > 0 AS duplicated FROM orders GROUP BY o_custkey""")
def d5(spark, d):
    from ledgerline.operators.ingest import merge_employee_sheets

    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("employee_id"), F.date_format("o_orderdate", "yyyy-MM").alias("sheet"), F.struct("o_orderdate", "o_orderkey").alias("place"), F.col("o_totalprice").alias("basic_salary"))
    return merge_employee_sheets(rows, "basic_salary")


@query("d6_unknown_emp", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def d6(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_anti")


_SPECS = "specs AS (SELECT CAST(n_nationkey AS VARCHAR) AS company_id, v AS version, CASE WHEN v = 3 AND n_nationkey % 2 = 0 THEN 'draft' ELSE 'active' END AS status, CASE v WHEN 1 THEN DATE '1995-06-01' WHEN 2 THEN DATE '1998-01-01' ELSE DATE '2000-01-01' END AS effective_date FROM nation, (VALUES (1), (2), (3)) AS t(v))"


@query("d7_formula_asof", f"WITH {V.EMP}, {_SPECS}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, company_id FROM orders JOIN emp ON employee_id = CAST(o_custkey AS VARCHAR)) SELECT o_orderkey, max(version) AS version FROM o LEFT JOIN specs ON o.company_id = specs.company_id AND status = 'active' AND effective_date <= day GROUP BY o_orderkey")
def d7(spark, d):
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("version"), F.lit(x).cast("date").alias("effective_date")) for n, x in ((1, "1995-06-01"), (2, "1998-01-01"), (3, "2000-01-01"))]))
    specs = table(spark, d, "nation").select(F.col("n_nationkey"), v.alias("s")).select(F.col("n_nationkey").cast("string").alias("company_id"), "s.version", "s.effective_date", F.when((F.col("s.version") == 3) & (F.col("n_nationkey") % 2 == 0), "draft").otherwise("active").alias("status"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("employee_id"), F.to_date("o_orderdate").alias("day")).join(V.employees(spark, d).select("employee_id", "company_id"), "employee_id")
    return P.formula_asof(o, specs, "day").select("o_orderkey", "version")


_FLAGS = PAID + """, base AS (SELECT *, last_value(net IGNORE NULLS) OVER (PARTITION BY employee_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline, CAST(company_id AS INTEGER) AS c, ot1 + ot2 + ot3 AS ot_hours FROM paid),
flags AS (SELECT employee_id, company_id, period, 'NET_NON_POSITIVE' AS code, 'critical' AS severity, NULL AS field_code, round(net, 2) AS actual FROM base WHERE net <= 0
UNION ALL SELECT employee_id, company_id, period, 'NEGATIVE_AMOUNT', 'warning', f, round(x, 2) FROM (SELECT employee_id, company_id, period, unnest(['NET_BASE', 'PIT_10', 'BASIC_', 'OT', 'MEAL_', 'BONUS', 'SI_EE', 'SI_ER', 'ADVANCE_']) AS f, unnest([NET_BASE, PIT_10, BASIC_, OT, MEAL_, BONUS, SI_EE, SI_ER, ADVANCE_]) AS x FROM base) WHERE x < 0
UNION ALL SELECT employee_id, company_id, period, 'NET_SALARY_DEVIATION', 'warning', NULL, round(abs(net - baseline) / abs(baseline) * 100, 2) FROM base WHERE baseline <> 0 AND abs(net - baseline) / abs(baseline) * 100 > CASE WHEN c % 5 = 0 THEN 10 ELSE 20 END
UNION ALL SELECT employee_id, company_id, period, 'BELOW_MINIMUM_WAGE', 'critical', NULL, round(gross, 2) FROM base WHERE c % 2 = 0 AND gross < 3500000 + 100000 * c
UNION ALL SELECT employee_id, company_id, period, 'OT_HOURS_EXCEEDED', 'warning', NULL, round(ot_hours, 2) FROM base WHERE c % 3 = 0 AND ot_hours > 15 + c)"""


@query("f3_anomaly", _FLAGS + " SELECT employee_id, period, code, severity, field_code, actual FROM flags")
def f3(spark, d):
    return P.flag_rows(flagged(spark, d), "employee_id", "period").select("employee_id", "period", "code", "severity", "field_code", F.round("actual", 2).alias("actual"))


def _resolved(spark, d):
    r = paid(spark, d).where("cast(employee_id as bigint) % 3 = 0")
    return r.select("employee_id", "period", F.lit("NET_SALARY_DEVIATION").alias("code")).unionByName(r.select("employee_id", "period", F.lit("OT_HOURS_EXCEEDED").alias("code")))


_OPEN = ", still AS (SELECT * FROM flags WHERE NOT (CAST(employee_id AS BIGINT) % 3 = 0 AND code IN ('NET_SALARY_DEVIATION', 'OT_HOURS_EXCEEDED')))"


@query("f4_gate", _FLAGS + _OPEN + """ SELECT employee_id, period, count(code) AS open_flags, count(code) = 0 AS publishable FROM (SELECT DISTINCT employee_id, period FROM paid) LEFT JOIN still USING (employee_id, period) GROUP BY ALL
UNION ALL SELECT NULL, NULL, count(*), count(*) = 0 FROM still""")
def f4(spark, d):
    """Each employee's month, and the whole run (null keys)."""
    results, resolved = flagged(spark, d), _resolved(spark, d)
    flags = P.flag_rows(results, "employee_id", "company_id", "period")
    run = P.publish_gate(flags, resolved, results).select(F.lit(None).cast("string").alias("employee_id"), F.lit(None).cast("string").alias("period"), "open_flags", "publishable")
    return P.publish_gate(flags, resolved, results, "employee_id", "period").unionByName(run)


@query("f5_queue", _FLAGS + " SELECT employee_id, period, code, row_number() OVER (PARTITION BY employee_id ORDER BY period, code, field_code) AS place FROM flags WHERE severity = 'critical'")
def f5(spark, d):
    from pyspark.sql import Window

    rows = P.flag_rows(flagged(spark, d), "employee_id", "period").where("severity = 'critical'")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("employee_id").orderBy("period", "code", "field_code"))).select("employee_id", "period", "code", "place")


@query("b1_payroll_report", _FLAGS + ", names AS (SELECT employee_id, period, string_agg(DISTINCT code, ', ' ORDER BY code) AS flags FROM flags GROUP BY ALL) SELECT paid.employee_id, company_id, paid.period, gross, total_deductions, employer_cost, net, coalesce(flags, '') AS flags FROM paid LEFT JOIN names USING (employee_id, period)")
def b1(spark, d):
    out = P.payroll_report(flagged(spark, d))
    return out.withColumn("flags", F.array_join(F.array_sort(F.split("flags", ", ")), ", "))


@query("b2_payslip", PAID + """ SELECT employee_id, period, s AS section, f AS field_code, round(CASE WHEN s = 'deductions' THEN 0 - x ELSE x END, 2) AS amount FROM (SELECT employee_id, period, unnest(['NET_BASE', 'PIT_10', 'BASIC_', 'OT', 'MEAL_', 'BONUS', 'SI_EE', 'SI_ER', 'ADVANCE_']) AS f,
unnest(['employer_cost', 'deductions', 'line_items', 'line_items', 'line_items', 'line_items', 'deductions', 'employer_cost', 'deductions']) AS s, unnest([NET_BASE, PIT_10, BASIC_, OT, MEAL_, BONUS, SI_EE, SI_ER, ADVANCE_]) AS x FROM paid)""")
def b2(spark, d):
    return P.payslip(paid(spark, d), FM).withColumn("amount", F.round("amount", 2))


@query("b3_audit_rows", """SELECT '{"event_type":"payroll.calculated","payload":"{\\"event_id\\":' || event_id || ',\\"user_id\\":' || user_id || '}","actor":"system","timestamp":"2024-01-01"}' AS value FROM events""")
def b3(spark, d):
    return io.audit_rows(table(spark, d, "events"), "payroll.calculated", "system", F.lit("2024-01-01"), "event_id", "user_id")


@query("b5_redact", "SELECT employee_id, period, code, 'basic_salary' AS allowed_keys FROM (" + _FLAGS + " SELECT * FROM flags) WHERE code = 'OT_HOURS_EXCEEDED'")
def b5(spark, d):
    rows = P.flag_rows(flagged(spark, d).withColumn("inputs", F.create_map(F.lit("basic_salary"), F.col("basic"), F.lit("salary_advance"), F.col("advance"))), "employee_id", "period", "inputs").where("code = 'OT_HOURS_EXCEEDED'")
    return io.redact(rows, ("employee_id", "period", "code"), "inputs", ("basic_salary",)).select("employee_id", "period", "code", F.array_join(F.map_keys("inputs"), ",").alias("allowed_keys"))


@query("f1_derive", f"WITH {V.ATT} SELECT employee_id, period, round(CASE WHEN CAST(employee_id AS BIGINT) % 10 = 0 THEN 6.5 ELSE ot_normal_hours + ot_rest_hours + ot_holiday_hours END, 4) AS overtime_hours, paid_days >= scheduled_work_days AS is_full_month, paid_days > 0 AND paid_days < scheduled_work_days AS is_partial_month FROM att")
def f1(spark, d):
    rows = V.attendance(spark, d).withColumn("overtime_hours", F.when(F.col("employee_id").cast("bigint") % 10 == 0, 6.5))
    return P.derive_attendance(rows, ("ot_normal_hours", "ot_rest_hours", "ot_holiday_hours")).select("employee_id", "period", F.round("overtime_hours", 4).alias("overtime_hours"), "is_full_month", "is_partial_month")


@query("f2_validate", f"""WITH {V.EMP}, {V.ATT}, known AS (SELECT * FROM emp WHERE CAST(employee_id AS BIGINT) % 11 <> 0)
SELECT 'error' AS level, 'wrong_period' AS "check", employee_id || '/' || period AS key FROM att WHERE period <> '1998-01' UNION ALL SELECT 'error', 'unknown_employee', employee_id || '/' || period FROM att WHERE employee_id NOT IN (SELECT employee_id FROM known)
UNION ALL SELECT 'error', 'duplicate_employee', employee_id FROM known WHERE CAST(employee_id AS BIGINT) % 100 = 1""")
def f2(spark, d):
    known = V.employees(spark, d).where("cast(employee_id as bigint) % 11 <> 0")
    twice = known.unionByName(known.where("cast(employee_id as bigint) % 100 = 1"))
    return P.validate_inputs(twice, V.attendance(spark, d), "1998-01")


_IMPACT = f"WITH {V.BOUND}, {V.paid_sql()}, {V.paid_sql(True, 'after')}, a AS (SELECT * FROM paid WHERE CAST(employee_id AS BIGINT) % 97 <> 0), b AS (SELECT * FROM after WHERE CAST(employee_id AS BIGINT) % 89 <> 0), i AS (SELECT employee_id, period, round(b.gross - a.gross, 2) AS gross_delta, round(b.net - a.net, 2) AS net_delta, CASE WHEN a.net IS NULL THEN 'MISSING_BEFORE' WHEN b.net IS NULL THEN 'MISSING_AFTER' WHEN abs(b.gross - a.gross) > 1e-9 OR abs(b.net - a.net) > 1e-9 THEN 'CHANGED' ELSE 'UNCHANGED' END AS status FROM a FULL OUTER JOIN b USING (employee_id, period))"


def _impact(spark, d):
    two = [F.round(c, 2).alias(c) for c in ("gross", "net")]
    before = paid(spark, d).where("cast(employee_id as bigint) % 97 <> 0").select("employee_id", "period", *two)
    after = paid(spark, d, V.SECOND).where("cast(employee_id as bigint) % 89 <> 0").select("employee_id", "period", *two)
    return P.impact_report(before, after).withColumns({c: F.round(c, 2) for c in ("gross_delta", "net_delta")})


@query("d11_impact", _IMPACT + " SELECT employee_id, period, gross_delta, net_delta, status FROM i")
def d11(spark, d):
    return _impact(spark, d)


@query("f6_impact_sum", _IMPACT + " SELECT count(*) AS changed, round(sum(gross_delta), 0) AS gross_delta, round(sum(net_delta), 0) AS net_delta FROM i WHERE status = 'CHANGED'")
def f6(spark, d):
    return _impact(spark, d).where("status = 'CHANGED'").agg(F.count("*").alias("changed"), F.round(F.sum("gross_delta"), 0).alias("gross_delta"), F.round(F.sum("net_delta"), 0).alias("net_delta"))


@query("d12_expected", PAID + " SELECT employee_id, period, CAST(employee_id AS BIGINT) % 2 = 0 AS has_expected, CASE WHEN CAST(employee_id AS BIGINT) % 2 = 0 THEN CAST(employee_id AS BIGINT) % 4 = 0 END AS net_ok FROM paid")
def d12(spark, d):
    got = paid(spark, d).select("employee_id", "period", F.round("net", 2).alias("net"))
    number = F.col("employee_id").cast("bigint")
    expected = got.where(number % 2 == 0).select("employee_id", "period", (F.col("net") + F.when(number % 4 == 0, 0).otherwise(1)).alias("net_expected"))
    both = got.join(expected, ["employee_id", "period"], "left")
    return both.select("employee_id", "period", F.col("net_expected").isNotNull().alias("has_expected"), (F.col("net") == F.col("net_expected")).alias("net_ok"))


@query("g1_baseline", PAID + " SELECT employee_id, period, net, lag(net) OVER (PARTITION BY employee_id ORDER BY period) AS baseline FROM paid")
def g1(spark, d):
    return P.baseline(paid(spark, d).select("employee_id", "period", F.round("net", 2).alias("net")))
