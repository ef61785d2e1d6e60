"""Queries C1 to C29: projections, coercions and pay arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import changes as C
from ledgerline.operators import formulas as FO
from ledgerline.operators import registry as RG
from ledgerline.plans.base import query, table, values

HEADERS = (
    "Lương cơ bản (VND)", "Ngày công chuẩn", "Số ngày công", "Giờ tăng ca đêm ngày lễ 300%", "Họ và tên", "Đơn giá", "OT Night Rest 270", "Meal Allowance", "BHXH",
    "Phụ cấp nội quy 2", "Ngày phép", "overtime off day", "Tạm ứng", "  ", "basic", "Ngày nghỉ không phép", "Chức danh", "Làm thêm 200", "luong_cb", "ot", "Ca đêm", "standard_days",
)
H = values([(i, h) for i, h in enumerate(HEADERS)], "h_no", "header")
LABEL = f"trim(regexp_replace(translate(translate(lower({{}}), '{S.MARKED}', '{S.PLAIN}'), 'đ', 'd'), '[^a-z0-9]+', '_', 'g'), '_')"
SLUG = f"lower(trim(regexp_replace(regexp_replace(translate({{}}, '{S.MARKED}', '{S.PLAIN}'), '[^\\x00-\\x7F]+', '', 'g'), '[^0-9a-zA-Z_]+', '_', 'g'), '_'))"


HEADS = f"heads AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN header WHEN 1 THEN p_type ELSE p_name END AS header FROM part JOIN {H} ON h_no = p_partkey % 22)"


def headers(spark, sf_dir):
    """A header for each part: a known label, or its type or name."""
    k = F.col("p_partkey")
    known = F.element_at(F.array(*map(F.lit, HEADERS)), (k % len(HEADERS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, known).when(k % 3 == 1, F.col("p_type")).otherwise(F.col("p_name")).alias("header"))


@query("c1_label", f"SELECT doc_id, {LABEL.format('text')} AS label FROM documents")
def c1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize_label(F.col("text")).alias("label"))


@query("c2_canonical", f"WITH {HEADS} SELECT p_partkey, coalesce(code, s) AS code FROM (SELECT p_partkey, {SLUG.format('header')} AS s FROM heads) LEFT JOIN {values(list(S.CODE_ALIASES.items()), 'alias', 'code')} ON s = alias")
def c2(spark, sf_dir):
    return headers(spark, sf_dir).select("p_partkey", S.canonical_code(F.col("header")).alias("code"))


_ALIAS = values([(i, code, a) for i, (code, _, aliases) in enumerate(S.FIELD_CATALOG) for a in sorted({*aliases, code})], "pos", "code", "alias")
_INSIDE = values([(i, code, a) for i, (code, _, aliases) in enumerate(S.FIELD_CATALOG) for a in aliases], "pos", "code", "alias")


_CODE_PARTS = f"""{HEADS}, l AS (SELECT p_partkey, {LABEL.format('header')} AS l FROM heads),
e AS (SELECT p_partkey, min_by(code, pos) AS code FROM l JOIN {_ALIAS} ON l = alias GROUP BY ALL),
i AS (SELECT p_partkey, min_by(code, pos) AS code FROM l JOIN {_INSIDE} ON contains('_' || l || '_', '_' || alias || '_') GROUP BY ALL)"""
_CODE_SQL = """SELECT l.p_partkey, CASE WHEN l LIKE '%tang\\_ca%' ESCAPE '\\' OR l LIKE '%lam\\_them%' ESCAPE '\\' OR l LIKE '%overtime%' OR starts_with(l, 'ot') THEN
 'salary_ot_' || CASE WHEN regexp_matches(l, 'dem|night') THEN 'night' ELSE 'day' END || '_' || CASE WHEN regexp_matches(l, 'le|holiday') THEN 'holiday' WHEN regexp_matches(l, 'nghi|rest|off') THEN 'rest' ELSE 'normal' END || '_' ||
 CASE WHEN contains(l, '390') THEN '390' WHEN contains(l, '350') THEN '350' WHEN contains(l, '300') THEN '300' WHEN contains(l, '270') THEN '270' WHEN contains(l, '250') THEN '250' WHEN contains(l, '200') THEN '200' ELSE '150' END
 ELSE coalesce(e.code, i.code, nullif(l, ''), 'field') END AS code
FROM l LEFT JOIN e USING (p_partkey) LEFT JOIN i USING (p_partkey)"""


@query("c3_suggest_code", f"WITH {_CODE_PARTS} {_CODE_SQL}")
def c3(spark, sf_dir):
    return headers(spark, sf_dir).select("p_partkey", S.suggest_code(F.col("header")).alias("code"))


@query("c5_id_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN '00' || o_custkey ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS id FROM orders")
def c5(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), k, F.lit(".0 "))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("00"), k)).otherwise(F.concat(k, F.lit(".5")))
    return o.select("o_orderkey", S.id_text(raw).alias("id"))


@query("c6_hours", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 4) END AS hours FROM events")
def c6(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.col("value").cast("string")
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(v, F.lit(" hrs"))).when(F.col("event_id") % 2 == 0, F.concat(v, F.lit("h"))).otherwise(F.concat(F.lit(" "), v, F.lit(" H ")))
    return e.select("event_id", F.round(S.hours(raw), 4).alias("hours"))


@query("c7_norm_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM documents""")
def c7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize_text(F.col("text")).alias("text"))


@query("c8_match_key", f"SELECT doc_id, trim(regexp_replace(translate(translate(lower(text), '{S.MARKED}', '{S.PLAIN}'), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def c8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.match_key(F.col("text")).alias("key"))


_MOD = "(CASE WHEN fmod(a, b) <> 0 AND sign(fmod(a, b)) <> sign(b) THEN fmod(a, b) + b ELSE fmod(a, b) END)"


@query("c9_arith", f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_quantity - 25 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a + b AS added, a - b AS less, round(a * b, 4) AS times, CASE WHEN b <> 0 THEN round(a / b, 6) END AS ratio,
CASE WHEN b <> 0 THEN round((a - {_MOD}) / b, 0) END AS floored, CASE WHEN b <> 0 THEN round({_MOD}, 4) END AS rest FROM v""")
def c9(spark, sf_dir):
    a, b = F.col("l_extendedprice"), F.col("l_quantity") - 25
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (a + b).alias("added"), (a - b).alias("less"), F.round(a * b, 4).alias("times"), F.round(F.try_divide(a, b), 6).alias("ratio"), S.floor_div(a, b).alias("floored"), F.round(S.floor_mod(a, b), 4).alias("rest"))


@query("c10_compare", "SELECT l_orderkey, l_linenumber, 10 <= l_quantity AND l_quantity < 20 AS chained, l_returnflag IN ('A', 'R') AS member, l_linestatus NOT IN ('F') AS outside, l_discount <> 0.05 AS differs FROM lineitem")
def c10(spark, sf_dir):
    from ledgerline.operators.rules import compile_expression

    env = {c: F.col(c) for c in ("l_quantity", "l_returnflag", "l_linestatus", "l_discount")}
    texts = {"chained": "10 <= l_quantity < 20", "member": "l_returnflag in ('A', 'R')", "outside": "l_linestatus not in ['F']", "differs": "l_discount != 0.05"}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[compile_expression(t, env).alias(n) for n, t in texts.items()])


@query("c11_logic", "SELECT o_orderkey, (o_totalprice > 100000 AND o_orderstatus = 'O') OR NOT (o_custkey > 500) AS flag, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def c11(spark, sf_dir):
    from ledgerline.operators.rules import compile_expression

    env = {c: F.col(c) for c in ("o_totalprice", "o_orderstatus", "o_custkey")}
    return table(spark, sf_dir, "orders").select("o_orderkey", compile_expression("(o_totalprice > 100000 and o_orderstatus == 'O') or not (o_custkey > 500)", env).alias("flag"), compile_expression("'high' if o_totalprice > 200000 else 'mid' if o_totalprice > 50000 else 'low'", env).alias("band"))


@query("c12_math", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS size, least(l_quantity, 10, l_tax * 100) AS lo, greatest(l_quantity, 30) AS hi, round_even(l_quantity / 2, 0) AS even FROM lineitem")
def c12(spark, sf_dir):
    from ledgerline.operators.rules import compile_expression

    env = {"q": F.col("l_quantity"), "t": F.col("l_tax")}
    texts = {"size": "abs(q - 25)", "lo": "min(q, 10, t * 100)", "hi": "max(q, 30)", "even": "round(q / 2)"}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[compile_expression(t, env).alias(n) for n, t in texts.items()])


@query("c13_prorate", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 2 > 0 AND l_quantity >= 3 THEN l_extendedprice * (l_quantity - 3) / (l_linenumber - 2) END AS amount FROM lineitem")
def c13(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.prorate(F.col("l_extendedprice"), F.col("l_quantity") - 3, (F.col("l_linenumber") - 2).cast("double")).alias("amount"))


@query("c14_round_down", "SELECT o_orderkey, floor(o_totalprice / 1000) * 1000 AS thousand, CASE WHEN o_custkey % 5 > 0 THEN round(floor(o_totalprice / ((o_custkey % 5) * 250.0)) * ((o_custkey % 5) * 250.0), 2) END AS by_unit FROM orders")
def c14(spark, sf_dir):
    unit = (F.col("o_custkey") % 5) * 250.0
    return table(spark, sf_dir, "orders").select("o_orderkey", S.round_down(F.col("o_totalprice")).alias("thousand"), F.round(S.round_down(F.col("o_totalprice"), unit), 2).alias("by_unit"))


def tax_sql(x: str) -> str:
    parts, lower = [], 0
    for upper, rate in S.TAX_BRACKETS:
        parts.append(f"greatest(0.0, {f'least({x}, {upper}.0)' if upper else x} - {lower}.0) * CAST({rate} AS DOUBLE)")
        lower = upper
    return "(" + " + ".join(parts) + ")"


@query("c15_tax", f"SELECT o_orderkey, round({tax_sql('(o_totalprice * 400 - 2000000)')}, 2) AS tax FROM orders")
def c15(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.progressive_tax(F.col("o_totalprice") * 400 - 2000000), 2).alias("tax"))


@query("c16_rounding", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN round_even(o_totalprice, 0) WHEN 2 THEN floor(o_totalprice / 1000) * 1000 ELSE floor(o_totalprice / 500) * 500 END AS amount FROM orders")
def c16(spark, sf_dir):
    rule = F.when(F.col("o_orderkey") % 4 == 1, "round").when(F.col("o_orderkey") % 4 == 2, "round_down").when(F.col("o_orderkey") % 4 == 3, "round_down_500")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.rounded_by(F.col("o_totalprice"), rule).alias("amount"))


_OT = "(CASE e.event_id % 6 WHEN 0 THEN 'OT_HOURS_150' WHEN 1 THEN 'OT_HOLIDAY_NIGHT_SHIFT_390_HOURS' WHEN 2 THEN 'tang_ca_ca_dem_200_ngay_nghi' WHEN 3 THEN 'overtime 270 day off' WHEN 4 THEN 'OT_HOURS' ELSE 'bonus_150' END || ' ' || e.event_type)"


@query("c17_infer_ot", f"""WITH v AS (SELECT event_id, {_OT} AS t FROM events e), w AS (SELECT *, regexp_matches(t, '(?i)(^OT_)|(_OT$)|OVERTIME|TANG_?CA') AND regexp_matches(t, '150|200|250|270|300|350|390') AS ok FROM v)
SELECT event_id, CASE WHEN ok THEN CASE WHEN regexp_matches(t, '(?i)NIGHT|CA_?DEM') THEN 'Night' ELSE 'Day' END END AS shift,
CASE WHEN ok THEN CASE WHEN regexp_matches(t, '(?i)HOLIDAY|NGAY_?LE|_LE(_|$)') THEN 'Holiday' WHEN regexp_matches(t, '(?i)DAY_?OFF|NGAY_?NGHI|REST') THEN 'Rest' ELSE 'Normal' END END AS day,
CASE WHEN ok THEN CAST(regexp_extract(t, '150|200|250|270|300|350|390') AS DOUBLE) / 100 END AS rate FROM w""")
def c17(spark, sf_dir):
    ot = S.infer_ot(_ot_text())
    return table(spark, sf_dir, "events").select("event_id", ot.alias("x")).select("event_id", "x.shift", "x.day", "x.rate")


def _ot_text():
    k = F.col("event_id") % 6
    name = F.when(k == 0, "OT_HOURS_150").when(k == 1, "OT_HOLIDAY_NIGHT_SHIFT_390_HOURS").when(k == 2, "tang_ca_ca_dem_200_ngay_nghi").when(k == 3, "overtime 270 day off").when(k == 4, "OT_HOURS").otherwise("bonus_150")
    return F.concat(name, F.lit(" "), F.col("event_type"))


@query("c18_ot_code", "SELECT event_id, 'SALARY_OT_' || CASE WHEN user_id % 2 = 0 THEN 'DAY' ELSE 'NIGHT' END || '_' || CASE event_id % 3 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'REST' ELSE 'HOLIDAY' END || '_' || CASE event_id % 3 WHEN 0 THEN '150' WHEN 1 THEN '270' ELSE '390' END AS code FROM events")
def c18(spark, sf_dir):
    k = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select("event_id", S.ot_code(F.when(F.col("user_id") % 2 == 0, "Day").otherwise("Night"), F.when(k == 0, "Normal").when(k == 1, "Rest").otherwise("Holiday"), F.when(k == 0, 1.5).when(k == 1, 2.7).otherwise(3.9)).alias("code"))


_CODES = "(CASE p_partkey % 6 WHEN 0 THEN 'SI_EE' WHEN 1 THEN 'MEAL' WHEN 2 THEN 'UI_ER' WHEN 3 THEN 'PIT_X' WHEN 4 THEN 'BONUS' ELSE 'FUND_EE' END)"


@query("c20_section", f"""SELECT p_partkey, coalesce(CASE WHEN p_size % 7 = 0 THEN 'employer_cost' END, CASE WHEN p_size % 5 = 0 THEN 'deductions' END,
CASE p_partkey % 4 WHEN 0 THEN 'deductions' WHEN 1 THEN 'line_items' END,
CASE WHEN c IN ('SI_EE', 'PIT_X', 'FUND_EE') THEN 'deductions' WHEN c = 'UI_ER' THEN 'employer_cost' ELSE 'line_items' END) AS section FROM (SELECT *, {_CODES} AS c FROM part)""")
def c20(spark, sf_dir):
    k = F.col("p_partkey") % 6
    code = F.when(k == 0, "SI_EE").when(k == 1, "MEAL").when(k == 2, "UI_ER").when(k == 3, "PIT_X").when(k == 4, "BONUS").otherwise("FUND_EE")
    category = F.when(F.col("p_partkey") % 4 == 0, "PIT").when(F.col("p_partkey") % 4 == 1, "BONUS").when(F.col("p_partkey") % 4 == 2, "WORKDAY")
    return table(spark, sf_dir, "part").select("p_partkey", S.section_of(F.when(F.col("p_size") % 7 == 0, "employer_cost"), F.when(F.col("p_size") % 5 == 0, "deductions"), category, code).alias("section"))


@query("c21_hash", "SELECT doc_id, sha256(text) AS checksum, substr(md5(text), 1, 8) AS short FROM documents")
def c21(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), F.substring(F.md5("text"), 1, 8).alias("short"))


@query("c22_same_value", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN o_orderpriority = o_orderstatus ELSE false END AS same FROM orders""")
def c22(spark, sf_dir):
    k, v = F.col("o_orderkey") % 4, F.col("o_totalprice")
    a = F.when(k < 2, v.cast("string")).when(k == 2, F.col("o_orderpriority"))
    b = F.when(k == 0, (v + 1e-11).cast("string")).when(k == 1, (v + 1).cast("string")).when(k == 2, F.col("o_orderstatus")).otherwise(F.lit("x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.same_value(a, b).alias("same"))


@query("c23_data_type", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'boolean' WHEN 1 THEN 'formula' WHEN 2 THEN 'number' WHEN 3 THEN 'number' ELSE 'text' END AS kind, CASE event_id % 5 WHEN 2 THEN 'integer' WHEN 3 THEN 'number' ELSE 'string' END AS kind2 FROM events")
def c23(spark, sf_dir):
    k = F.col("event_id") % 5
    v = F.when(k == 0, "True").when(k == 1, "=A1*2").when(k == 2, F.col("user_id").cast("string")).when(k == 3, F.concat(F.col("user_id").cast("string"), F.lit(".25"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", S.data_type_of(v).alias("kind"), S.value_kind(v).alias("kind2"))


@query("c24_numbers", r"""WITH v AS (SELECT doc_id, 'pay ' || (doc_id % 100) || ' of ' || (doc_id % 7) || '.5' AS quote, text FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(quote, '\d+(?:[.,]\d+)*'), lambda n: NOT list_contains(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), n))) > 0 AS mismatch FROM v""")
def c24(spark, sf_dir):
    quote = F.concat(F.lit("pay "), (F.col("doc_id") % 100).cast("string"), F.lit(" of "), (F.col("doc_id") % 7).cast("string"), F.lit(".5"))
    return table(spark, sf_dir, "documents").select("doc_id", S.number_mismatch(quote, F.col("text")).alias("mismatch"))


@query("c25_prepare", """SELECT p_partkey, CASE WHEN s IN ('rate_config', 'regulatory') THEN CASE WHEN v IS NULL THEN 'employee' ELSE 'literal' END ELSE s END AS source, CASE WHEN s IN ('rate_config', 'regulatory') AND v IS NULL THEN p_name ELSE f END AS field_code, v AS value
FROM (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN 'employee' WHEN 1 THEN 'rate_config' WHEN 2 THEN 'regulatory' ELSE 'literal' END AS s, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS v, p_brand AS f FROM part)""")
def c25(spark, sf_dir):
    k = F.col("p_partkey") % 4
    source = F.when(k == 0, "employee").when(k == 1, "rate_config").when(k == 2, "regulatory").otherwise("literal")
    v = F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), source.alias("source"), F.col("p_brand").alias("field_code"), v.alias("value"))
    return FO.prepare_variables(rows).select("p_partkey", "source", "field_code", "value")


@query("c26_access_meta", """SELECT p_partkey, array_to_string(list_filter(['company=' || p_brand, CASE WHEN p_size % 3 > 0 THEN 'scope=' || p_type END, CASE WHEN p_partkey % 4 > 0 THEN 'effective_date=' || strftime(DATE '1995-01-01' + p_size, '%Y-%m-%d') END, CASE WHEN p_size % 5 = 0 THEN 'required_permission=' || (p_size % 4) END], lambda x: x IS NOT NULL), ';') AS metadata FROM part""")
def c26(spark, sf_dir):
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size"))
    bag = RG.access_metadata(F.col("p_brand"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")), F.when(F.col("p_partkey") % 4 > 0, day), F.when(F.col("p_size") % 5 == 0, F.col("p_size") % 4))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(bag), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


def _responses(spark, sf_dir):
    """Model responses: a JSON object in prose or in a fence, at times cut off."""
    word = F.when(F.col("turn") % 4 == 0, F.col("role")).when(F.col("turn") % 4 == 1, " Parameter_Change").when(F.col("turn") % 4 == 2, "editorial").otherwise("SCOPE_CHANGE")
    body = F.to_json(F.struct(word.alias("category"), F.col("turn").alias("confidence"), F.lit("2024-01-05").alias("effective_date")))
    k = F.col("conv_id") % 3
    text = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Answer: "), body, F.lit(" done"))).otherwise(F.substring(body, 1, 12))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("response"))


_WORD = "CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN ' Parameter_Change' WHEN 2 THEN 'editorial' ELSE 'SCOPE_CHANGE' END"


@query("c27_extract_json", f"""SELECT conv_id, turn, CASE WHEN conv_id % 3 < 2 THEN '{{"category":"' || {_WORD} || '","confidence":' || turn || ',"effective_date":"2024-01-05"}}' END AS body FROM conversations""")
def c27(spark, sf_dir):
    return _responses(spark, sf_dir).select("conv_id", "turn", S.extract_json(F.col("response")).alias("body"))


@query("c28_type_changes", f"""SELECT conv_id, turn, CASE WHEN conv_id % 3 < 2 THEN CASE WHEN upper(trim({_WORD})) IN {tuple(C.CATEGORY_RISK)} THEN upper(trim({_WORD})) ELSE 'AMBIGUOUS_OR_CONFLICT' END END AS category, CASE WHEN conv_id % 3 < 2 THEN DATE '2024-01-05' END AS effective_date, CASE WHEN conv_id % 3 < 2 THEN CAST(turn AS DOUBLE) ELSE 0 END AS confidence, CAST(0 AS INTEGER) AS n_refs FROM conversations""")
def c28(spark, sf_dir):
    rows = _responses(spark, sf_dir).select("conv_id", "turn", C.type_changes(F.col("response")).alias("x"))
    return rows.select("conv_id", "turn", "x.category", "x.effective_date", "x.confidence", F.size("x.evidence_refs").alias("n_refs"))


@query("c29_stable_hash", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events""")
def c29(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.stable_hash(F.col("event_type"), F.col("user_id")).alias("h"))


@query("a14_display", r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN regexp_replace(printf('%.2f', l_discount * 100), '\.?0+$', '') || '%' ELSE regexp_replace(printf('%.4f', l_quantity + l_tax), '\.?0+$', '') END AS shown, strftime(l_shipdate, '%d/%m/%Y') AS day FROM lineitem WHERE l_quantity + l_tax <> floor(l_quantity + l_tax) OR l_linenumber % 2 = 0 UNION ALL
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), strftime(l_shipdate, '%d/%m/%Y') FROM lineitem WHERE l_quantity + l_tax = floor(l_quantity + l_tax) AND l_linenumber % 2 = 1""")
def a14(spark, sf_dir):
    even = F.col("l_linenumber") % 2 == 0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.display_number(F.when(even, F.col("l_discount")).otherwise(F.col("l_quantity") + F.col("l_tax")), F.when(even, "0%").otherwise("General")).alias("shown"), S.display_date(F.col("l_shipdate")).alias("day"))
