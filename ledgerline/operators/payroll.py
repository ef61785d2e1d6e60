"""Binding of inputs, payroll runs, their checks and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.rules import Formula, payroll_items, run_rules, with_totals


def rate_lookup(people: DataFrame, rates: DataFrame, field_code: str, name: str) -> DataFrame:
    """Adds ``name``: the last rate row of the employee's type, else of ``*``."""
    of_field = rates.where(F.col("field_code") == field_code)
    last = of_field.groupBy("company_id", "employee_type").agg(F.max_by("value", "row_no").alias("v"))
    exact = last.where("employee_type <> '*'").withColumnRenamed("v", "__exact")
    everyone = last.where("employee_type = '*'").select("company_id", F.col("v").alias("__any"))
    joined = people.join(exact.hint("shuffle_merge"), ["company_id", "employee_type"], "left").join(everyone.hint("shuffle_merge"), "company_id", "left")
    return joined.withColumn(name, F.coalesce("__exact", "__any")).drop("__exact", "__any")


def bind_inputs(employees: DataFrame, attendance: DataFrame, rates: DataFrame, formula: Formula, strict: bool = False) -> DataFrame:
    """One column per variable; ``errors`` lists variables without a value."""
    rows = employees.join(attendance, "employee_id")
    for v in formula.variables:
        if v.source == "rate_config":
            rows = rate_lookup(rows, rates, v.field_code, v.name)
        elif v.source in ("employee", "attendance"):
            rows = rows.withColumn(v.name, F.col(v.field_code))
        else:
            rows = rows.withColumn(v.name, F.lit(v.value).cast("double"))
    errors = F.array_compact(F.array(*[F.when(F.col(v.name).isNull(), F.lit(f"missing {v.name}")) for v in formula.variables]))
    rows = rows.withColumn("errors", errors)
    if strict:
        rows = rows.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(F.array_join("errors", ", ")).cast("array<string>")).otherwise(F.col("errors")))
    return rows


def run_payroll(bound: DataFrame, formula: Formula, mode: str = "payroll") -> DataFrame:
    """Rules and totals over bound inputs without errors."""
    if formula.status != "active":
        raise ValueError("only an active formula may run")
    return with_totals(run_rules(bound.where(F.size("errors") == 0), formula, mode), formula)


def baseline(results: DataFrame) -> DataFrame:
    """Adds the last net of an earlier period of the employee."""
    before = Window.partitionBy("employee_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("baseline", F.last("net", ignorenulls=True).over(before))


def anomaly_flags(results: DataFrame, formula: Formula, minimum_wage: Column | None = None, max_ot_hours: Column | None = None, change_percent: Column | float = 20.0, tolerance: Column | float = 1.0, prorate_minimum_wage: bool = False) -> DataFrame:
    """Adds ``flags``: struct(code, severity, field_code, actual, threshold) by rule.

    Needs ``baseline``, ``ot_hours`` and the totals; thresholds that are null don't apply.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("double")
    change, slack = lit(change_percent), lit(tolerance)
    wage, hours = lit(minimum_wage), lit(max_ot_hours)
    if prorate_minimum_wage:
        wage = wage * F.col("paid") / F.col("sched")

    def flag(when: Column, code: str, severity: str, actual: Column, threshold: Column, field_code: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (field_code if field_code is not None else F.lit(None).cast("string")).alias("field_code"), actual.alias("actual"), threshold.alias("threshold")))

    zero = F.lit(0.0)
    deviation = F.abs(F.col("net") - F.col("baseline")) / F.abs(F.col("baseline")) * 100
    expected = F.col("gross") - F.col("total_deductions")
    flags = [
        flag(F.col("net") <= 0, "NET_NON_POSITIVE", "critical", F.col("net"), zero),
        flag(F.abs(expected - F.col("net")) > slack, "NET_RECONCILIATION_MISMATCH", "critical", F.col("net"), expected),
        *[flag(F.col(r.output) < 0, "NEGATIVE_AMOUNT", "warning", F.col(r.output), zero, F.lit(r.output)) for r in formula.rules],
        flag((F.col("baseline") != 0) & (F.when(F.col("baseline") != 0, deviation) > change), "NET_SALARY_DEVIATION", "warning", F.when(F.col("baseline") != 0, deviation), change),
        flag(F.col("gross") < wage, "BELOW_MINIMUM_WAGE", "critical", F.col("gross"), wage),
        flag(F.col("ot_hours") > hours, "OT_HOURS_EXCEEDED", "warning", F.col("ot_hours"), hours),
    ]
    return results.withColumn("flags", F.array_compact(F.array(*flags)))


def flag_rows(flagged: DataFrame, *keys: str) -> DataFrame:
    return flagged.select(*keys, F.inline("flags"))


def publish_gate(flags: DataFrame, resolved: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """(keys, open_flags, publishable) of each group of ``results``, or of the whole run without keys.

    Open are the ``flags`` that aren't among ``resolved (employee_id, period, code)``.
    """
    on = ["employee_id", "period", "code"]
    still = flags.join(resolved.select(*on).distinct().hint("shuffle_merge"), on, "left_anti")
    if keys:
        groups, counts = results.select(*keys).distinct(), still.groupBy(*keys).agg(F.count("*").alias("open_flags"))
        counts = groups.join(counts.hint("shuffle_merge"), list(keys), "left").withColumn("open_flags", F.coalesce("open_flags", F.lit(0)))
    else:
        counts = still.agg(F.count("*").alias("open_flags"))
    return counts.withColumn("publishable", F.col("open_flags") == 0)


def payroll_report(flagged: DataFrame) -> DataFrame:
    codes = F.array_join(F.array_distinct(F.transform("flags", lambda f: f["code"])), ", ")
    return flagged.select("employee_id", "company_id", "period", *[F.round(c, 2).alias(c) for c in ("gross", "total_deductions", "employer_cost", "net")], codes.alias("flags"))


def payslip(results: DataFrame, formula: Formula) -> DataFrame:
    """Long form with signs: income +, deductions -, employer cost +."""
    items = payroll_items(results, formula, "employee_id", "period")
    return items.select("employee_id", "period", "section", "field_code", F.when(F.col("section") == "deductions", 0 - F.col("amount")).otherwise(F.col("amount")).alias("amount"))


def impact_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per employee and period what changed between two result sets."""
    a = before.select("employee_id", "period", F.col("gross").alias("gross_before"), F.col("net").alias("net_before"))
    b = after.select("employee_id", "period", F.col("gross").alias("gross_after"), F.col("net").alias("net_after"))
    both = a.join(b, ["employee_id", "period"], "full_outer")
    gross, net = F.col("gross_after") - F.col("gross_before"), F.col("net_after") - F.col("net_before")
    status = F.when(F.col("net_before").isNull(), "MISSING_BEFORE").when(F.col("net_after").isNull(), "MISSING_AFTER").when((F.abs(gross) > 1e-9) | (F.abs(net) > 1e-9), "CHANGED").otherwise("UNCHANGED")
    return both.select("employee_id", "period", gross.alias("gross_delta"), net.alias("net_delta"), status.alias("status"))


def derive_attendance(rows: DataFrame, ot_columns: tuple[str, ...], given: str = "overtime_hours") -> DataFrame:
    """Adds overtime_hours (unless given) and the full / partial month marks."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ot_columns), F.lit(0.0))
    present = F.coalesce(*ot_columns).isNotNull()
    full = F.col("paid_days") >= F.col("scheduled_work_days")
    return rows.withColumns({given: F.coalesce(F.col(given), F.when(present, total)), "is_full_month": full, "is_partial_month": (F.col("paid_days") > 0) & ~full})


def validate_inputs(employees: DataFrame, attendance: DataFrame, period: str) -> DataFrame:
    """(level, check, key): duplicates, missing ids, wrong periods, unknown employees, negatives."""
    say = lambda level, name, key: (F.lit(level).alias("level"), F.lit(name).alias("check"), key.cast("string").alias("key"))
    parts = [
        employees.groupBy("employee_id").count().where("count > 1").select(*say("error", "duplicate_employee", F.col("employee_id"))),
        employees.where("employee_id is null or employee_id = ''").select(*say("error", "missing_id", F.lit(None))),
        attendance.where(F.col("period") != period).select(*say("error", "wrong_period", F.concat_ws("/", "employee_id", "period"))),
        attendance.join(employees, "employee_id", "left_anti").select(*say("error", "unknown_employee", F.concat_ws("/", "employee_id", "period"))),
        attendance.where("paid_days < 0").select(*say("error", "negative", F.concat_ws("/", "employee_id", "period"))),
        attendance.groupBy().count().where("count = 0").select(*say("warning", "empty_attendance", F.lit(None))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def formula_asof(rows: DataFrame, specs: DataFrame, date: str) -> DataFrame:
    """Adds the active specification of the company with the greatest effective date up to ``date``.

    Versions are few per company: they are grouped into one array per company
    (equi join, one row each), and the fitting one is picked in the row.
    """
    packed = specs.where("status = 'active'").groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("effective_date", "version"))).alias("__specs"))
    fits = F.filter("__specs", lambda s: s["effective_date"] <= F.col(date))
    return rows.join(packed, "company_id", "left").withColumn("__fit", F.try_element_at(fits, F.lit(-1))).withColumn("version", F.col("__fit.version")).drop("__specs", "__fit")
