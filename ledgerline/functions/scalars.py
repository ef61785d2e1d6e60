"""Column functions of the engine: text folding, coercion, pay arithmetic."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters (Spark SQL has no NFKD)."""
    marked, plain = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFKD", chr(point))
        if base.isascii() and base.isalpha() and marks and all(unicodedata.combining(m) for m in marks):
            marked.append(chr(point))
            plain.append(base)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = fold_table()

#: Field-code aliases of the payroll vocabulary.
CODE_ALIASES = {
    "base_salary": "basic_salary",
    "monthly_salary": "basic_salary",
    "luong_co_ban": "basic_salary",
    "luong_cb": "basic_salary",
    "basic": "basic_salary",
    "total_working_days": "worked_days",
    "ngay_cong": "worked_days",
    "so_ngay_cong": "worked_days",
    "standard_working_days": "scheduled_work_days",
    "standard_days": "scheduled_work_days",
    "ngay_cong_chuan": "scheduled_work_days",
    "cong_chuan": "scheduled_work_days",
    "days_with_pay": "paid_days",
    "days_with_salary": "paid_days",
    "actual_paid_day": "paid_days",
    "paid_working_days": "paid_days",
    "tang_ca": "ot_day_normal_150_hours",
    "gio_tang_ca": "ot_day_normal_150_hours",
    "ot": "ot_day_normal_150_hours",
    "ot_day_150_hours": "ot_day_normal_150_hours",
    "salary_ot_day_normal_150": "ot_day_normal_150_hours",
    "salary_ot_night_normal_150": "ot_night_normal_150_hours",
    "salary_ot_day_rest_200": "ot_day_rest_200_hours",
    "salary_ot_night_rest_200": "ot_night_rest_200_hours",
    "salary_ot_day_holiday_300": "ot_day_holiday_300_hours",
    "salary_ot_night_holiday_300": "ot_night_holiday_300_hours",
    "gio_ca_dem": "night_shift_hours",
    "ca_dem": "night_shift_hours",
    "ngay_phep": "annual_leave_days",
    "phep_nam": "annual_leave_days",
    "nghi_thai_san": "maternity_leave_days",
    "thai_san": "maternity_leave_days",
}

#: Input fields with their source and header aliases, in catalog order.
FIELD_CATALOG = (
    ("employment_status", "employee", ("employment_status", "employee_status", "trang_thai_lam_viec", "tinh_trang_lam_viec")),
    ("position", "employee", ("position", "job_title", "vtcv", "vi_tri_cong_viec", "chuc_danh", "cong_viec")),
    ("basic_salary", "employee", ("basic_salary", "base_salary", "monthly_salary", "basic", "luong_co_ban", "luong_cb", "luong_thang", "muc_luong", "tien_luong")),
    ("days_worked_in_month", "attendance", ("days_worked_in_month", "workday_act", "ngay_cong_thuc_te", "ngay_lam_viec_thuc_te")),
    ("days_with_salary", "attendance", ("days_with_salary", "actual_paid_day", "paid_working_days", "ngay_cong_duoc_huong_luong")),
    ("days_without_pay", "attendance", ("days_without_pay", "unpaid_leave_days", "ngay_nghi_k", "ngay_nghi_khong_phep", "nghi_khong_luong")),
    ("total_working_days", "attendance", ("total_working_days", "worked_days", "working_days", "ngay_cong", "so_ngay_cong", "so_cong", "ngay_lam_viec", "cong_thuc_te")),
    ("standard_working_days", "attendance", ("standard_working_days", "scheduled_working_days", "workday_standard", "standard_days", "ngay_cong_chuan", "cong_chuan", "dinh_muc_cong")),
    ("salary_ot_day_normal_150", "attendance", ("salary_ot_day_normal_150", "tang_ca", "gio_tang_ca", "lam_them", "ot", "ot_hours", "ot_day_shift_150_hours")),
    ("night_shift_hours", "attendance", ("night_shift_hours", "gio_ca_dem", "ca_dem", "lam_dem")),
    ("annual_leave_days", "attendance", ("annual_leave_days", "ngay_phep", "phep_nam")),
    ("maternity_leave_days", "attendance", ("maternity_leave_days", "nghi_thai_san", "thai_san")),
    ("salary_advance", "employee", ("salary_advance", "tam_ung", "advance")),
    ("internal_allowance_amount", "employee", ("internal_allowance_amount", "phu_cap_noi_quy", "phu_cap_noi_quy_2")),
    ("insurance_fee", "employee", ("insurance_fee", "bhxh", "bao_hiem", "insurance")),
)

#: Monthly income bands and their rates.
TAX_BRACKETS = ((5_000_000, 0.05), (10_000_000, 0.10), (18_000_000, 0.15), (32_000_000, 0.20), (52_000_000, 0.25), (80_000_000, 0.30), (None, 0.35))


def fold(text: Column) -> Column:
    return F.translate(text, MARKED, PLAIN)


def normalize_label(text: Column) -> Column:
    """Lower-case ASCII snake case; the Vietnamese d counts as d."""
    low = F.translate(fold(F.lower(text)), "đ", "d")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug(text: Column) -> Column:
    """Like a label, but what is not ASCII after folding is dropped."""
    ascii_only = F.regexp_replace(fold(text), r"[^\x00-\x7F]+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(ascii_only, "[^0-9a-zA-Z_]+", "_"), "^_+|_+$", ""))


def _case(value: Column, table: dict[str, str]) -> Column:
    """A fixed mapping as one expression."""
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in table.items()])


def canonical_code(text: Column) -> Column:
    """The registered spelling of a field code; unknown codes are kept."""
    code = slug(text)
    return F.coalesce(_case(code, CODE_ALIASES), code)


def suggest_code(header: Column, source: str | None = None) -> Column:
    """Suggests a field code for a sheet header, overtime variants included."""
    label = normalize_label(header)
    overtime = F.contains(label, F.lit("tang_ca")) | F.contains(label, F.lit("lam_them")) | F.contains(label, F.lit("overtime")) | F.startswith(label, F.lit("ot"))
    shift = F.when(label.rlike("dem|night"), "night").otherwise("day")
    day = F.when(label.rlike("le|holiday"), "holiday").when(label.rlike("nghi|rest|off"), "rest").otherwise("normal")
    rate = F.coalesce(*[F.when(F.contains(label, F.lit(r)), F.lit(r)) for r in ("390", "350", "300", "270", "250", "200", "150")], F.lit("150"))
    fields = [f for f in FIELD_CATALOG if source in (None, f[1])]
    exact = [F.when(label.isin(*sorted({*aliases, code})), F.lit(code)) for code, _, aliases in fields]
    padded = F.concat(F.lit("_"), label, F.lit("_"))
    inside = [F.when(F.coalesce(*[F.when(F.contains(padded, F.lit(f"_{a}_")), F.lit(True)) for a in sorted(aliases, key=len, reverse=True)]), F.lit(code)) for code, _, aliases in fields]
    return F.when(overtime, F.concat_ws("_", F.lit("salary_ot"), shift, day, rate)).otherwise(F.coalesce(*exact, *inside, F.when(label != "", label), F.lit("field")))


def id_text(value: Column) -> Column:
    """Ids as text: whole numbers lose their ``.0``; leading zeros of texts stay."""
    text = F.trim(value.cast("string"))
    number = F.regexp_extract(text, r"^(-?\d+)\.0+$", 1)
    return F.when(number != "", number).otherwise(text)


def hours(value: Column) -> Column:
    """A number, or hours written like ``2.5h``; null if malformed."""
    text = F.lower(F.trim(value.cast("string")))
    return F.regexp_replace(text, r"\s*h$", "").try_cast("double")


def normalize_text(text: Column) -> Column:
    """No-break spaces, line ends and runs of blanks; NFKC is a separate option."""
    out = F.translate(text, " ", " ")
    out = F.regexp_replace(F.regexp_replace(out, "\r\n?", "\n"), "[ \t]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, " ?\n ?", "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def match_key(text: Column) -> Column:
    low = F.translate(fold(F.lower(text)), "đ", "d")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; null for a zero divisor."""
    r = F.try_mod(a, b)
    return F.when((r != 0) & (F.signum(r) != F.signum(b)), r + b).otherwise(r)


def floor_div(a: Column, b: Column) -> Column:
    """Floored quotient rebuilt from the remainder, as floats need it."""
    return F.round(F.try_divide(a - floor_mod(a, b), b), 0)


def prorate(amount: Column, actual: Column, standard: Column) -> Column:
    """amount x actual / standard; null (an error of the row) outside its domain."""
    return F.when((standard > 0) & (actual >= 0), F.try_divide(amount * actual, standard))


def round_down(amount: Column, unit: Column | float = 1000.0) -> Column:
    """Floor to a multiple of ``unit``; null (an error of the row) if it isn't positive."""
    u = unit if isinstance(unit, Column) else F.lit(float(unit))
    return F.when(u > 0, F.floor(F.try_divide(amount, u)).cast("double") * u)


def progressive_tax(income: Column, brackets: tuple = TAX_BRACKETS) -> Column:
    """Progressive tax: each band's part of the income at the band's rate."""
    total, lower = F.lit(0.0), 0.0
    for upper, rate in brackets:
        top = income if upper is None else F.least(income, F.lit(float(upper)))
        total = total + F.greatest(F.lit(0.0), top - F.lit(float(lower))) * F.lit(rate)
        lower = upper
    return F.when(income.isNull(), None).otherwise(total)


def rounded(amount: Column, rounding: str | None) -> Column:
    """None, ``round`` (half to even), ``round_down`` or ``round_down_<unit>``."""
    if rounding is None:
        return amount
    if rounding == "round":
        return F.bround(amount, 0)
    if rounding.startswith("round_down"):
        return round_down(amount, float(rounding.removeprefix("round_down").lstrip("_") or 1000))
    raise ValueError(f"unknown rounding {rounding!r}")


def rounded_by(amount: Column, rounding: Column) -> Column:
    """The same with the rule in a column."""
    unit = F.regexp_extract(rounding, r"^round_down_(\d+(?:\.\d+)?)$", 1)
    return F.when(rounding.isNull(), amount).when(rounding == "round", F.bround(amount, 0)).when(rounding == "round_down", round_down(amount)).when(unit != "", round_down(amount, unit.try_cast("double")))


def infer_ot(text: Column) -> Column:
    """struct(shift, day, rate) of an overtime code or name; null if it is none."""
    rate = F.regexp_extract(text, "(150|200|250|270|300|350|390)", 1)
    day = F.when(text.rlike("(?i)HOLIDAY|NGAY_?LE|_LE(_|$)"), "Holiday").when(text.rlike("(?i)DAY_?OFF|NGAY_?NGHI|REST"), "Rest").otherwise("Normal")
    found = text.rlike("(?i)(^OT_)|(_OT$)|OVERTIME|TANG_?CA") & (rate != "")
    return F.when(found, F.struct(F.when(text.rlike("(?i)NIGHT|CA_?DEM"), "Night").otherwise("Day").alias("shift"), day.alias("day"), (rate.try_cast("double") / 100).alias("rate")))


def ot_code(shift: Column, day: Column, rate: Column) -> Column:
    return F.concat_ws("_", F.lit("SALARY_OT"), F.upper(shift), F.upper(day), F.round(rate * 100, 0).cast("int").cast("string"))


def section_of(section: Column, mapped: Column, category: Column, code: Column) -> Column:
    """Own section, mapped section, that of the category, or what the name says."""
    by_category = F.when(category.isin("BHXH", "PIT", "DEDUCTION_OTHER"), "deductions").when(category.isin("BASIC", "ALLOWANCE", "BONUS", "SALARY_OT"), "line_items")
    deduction = code.isin("SI_EE", "HI_EE", "UI_EE", "PIT_PROGRESSIVE", "PIT_10") | F.endswith(code, F.lit("_EE")) | F.startswith(code, F.lit("PIT_"))
    employer = code.isin("SI_ER", "HI_ER", "UI_ER", "TRADE_UNION_ER") | F.endswith(code, F.lit("_ER"))
    by_name = F.when(deduction, "deductions").when(employer, "employer_cost").otherwise("line_items")
    return F.coalesce(section, mapped, by_category, by_name)


def same_value(a: Column, b: Column) -> Column:
    """Equal numbers up to 1e-9, else equal texts; null equals null."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-9).otherwise(a.eqNullSafe(b))


def data_type_of(value: Column) -> Column:
    return F.when(F.lower(value).isin("true", "false"), "boolean").when(F.startswith(value, F.lit("=")), "formula").when(value.try_cast("double").isNotNull(), "number").otherwise("text")


def value_kind(value: Column) -> Column:
    return F.when(value.rlike(r"^-?\d+$"), "integer").when(value.try_cast("double").isNotNull(), "number").otherwise("string")


def number_mismatch(quote: Column, source: Column) -> Column:
    """Whether the quote has a number that the source hasn't."""
    number = F.lit(r"\d+(?:[.,]\d+)*")
    return F.size(F.array_except(F.regexp_extract_all(quote, number, F.lit(0)), F.regexp_extract_all(source, number, F.lit(0)))) > 0


def extract_json(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a response, code fence or not; null if it isn't an object."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def stable_hash(*columns: Column) -> Column:
    """sha256 of compact JSON with its keys in the order given (sort them)."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def display_number(value: Column, number_format: Column) -> Column:
    """Whole numbers without decimals, up to 4 others, percent formats x 100."""

    def shown(x: Column, digits: int) -> Column:
        fixed = F.format_string(f"%.{digits}f", x)
        return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.regexp_replace(fixed, r"\.?0+$", ""))

    percent = F.concat(shown(value * 100, 2), F.lit("%"))
    return F.when(value.isNull(), "").when(F.contains(number_format, F.lit("%")), percent).otherwise(shown(value, 4))


def display_date(value: Column) -> Column:
    midnight = value == F.date_trunc("day", value)
    return F.when(value.isNull(), "").when(midnight, F.date_format(value, "dd/MM/yyyy")).otherwise(F.date_format(value, "dd/MM/yyyy HH:mm"))
