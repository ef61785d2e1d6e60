"""Queries of change control, formulas as data, and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import changes as C
from ledgerline.operators import formulas as FO
from ledgerline.operators import registry as G
from ledgerline.operators import retrieval as R
from ledgerline.operators.versions import VersionedSheets, digest
from ledgerline.plans.base import query, table
from ledgerline.sources.io import shared_folder, written

CATS = tuple(C.CATEGORY_RISK)
_CAT = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATS)) + " END"
ITEMS = f"""items AS (SELECT o_orderkey AS item_id, o_custkey AS changeset_id, {_CAT} AS category, CASE WHEN o_orderkey % 13 > 0 THEN 'pay.' || (o_orderkey % 20) END AS field_path,
CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 50 AS VARCHAR) END AS old_value, CAST(o_orderkey % 45 AS VARCHAR) AS proposed_value, CASE WHEN o_orderkey % 9 > 0 THEN ['e' || o_custkey, 'e' || (o_custkey + 1)] ELSE [] END AS evidence_refs,
CASE WHEN o_orderkey % 2 = 0 THEN 'all' END AS scope, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderdate AS DATE) END AS effective_date, (o_orderkey % 100) / 100.0::DOUBLE AS confidence, CASE WHEN o_orderkey % 4 = 0 THEN 'which?' END AS clarifying_question,
CASE WHEN o_orderkey % 10 > 0 THEN 'fc' END AS formula_candidate_id, ['v' || o_custkey] AS affected FROM orders),
refs AS (SELECT item_id, unnest(evidence_refs) AS ref FROM items), bad AS (SELECT item_id, list(DISTINCT ref) AS fabricated FROM refs WHERE ref NOT IN (SELECT 'e' || c_custkey FROM customer WHERE c_custkey % 4 > 0) GROUP BY item_id),
fab AS (SELECT items.item_id, coalesce(fabricated, []) AS fabricated FROM items LEFT JOIN bad USING (item_id)), dep AS (SELECT item_id, CASE WHEN p_partkey IS NULL THEN 0 ELSE 2 END AS n_dep FROM items LEFT JOIN part ON p_partkey % 5 = 0 AND affected[1] = 'v' || p_partkey),
v AS (SELECT items.*, len(fabricated) AS n_fab, n_dep, (coalesce(field_path, '') = '')::INT + (len(evidence_refs) = 0)::INT + (len(fabricated) > 0)::INT + (category IN ('PARAMETER_CHANGE', 'FORMULA_CHANGE') AND (old_value IS NULL OR proposed_value IS NULL))::INT + (category = 'SCOPE_CHANGE' AND scope IS NULL)::INT + (category = 'AMBIGUOUS_OR_CONFLICT' AND clarifying_question IS NULL)::INT + (effective_date IS NULL AND category NOT IN ('EDITORIAL', 'AMBIGUOUS_OR_CONFLICT'))::INT AS n_errors,
coalesce(category IN ('PARAMETER_CHANGE', 'FORMULA_CHANGE') AND old_value = proposed_value, false)::INT + (confidence < 0.6)::INT AS n_warnings,
CASE WHEN category = 'REGULATORY_REFERENCE' THEN 'CRITICAL' WHEN n_dep > 0 AND category IN ('EDITORIAL', 'PARAMETER_CHANGE') THEN 'HIGH' WHEN category = 'EDITORIAL' AND confidence < 0.6 THEN 'MEDIUM' WHEN category = 'EDITORIAL' THEN 'LOW' WHEN category = 'PARAMETER_CHANGE' THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM items JOIN fab USING (item_id) JOIN dep USING (item_id))"""


def items(spark, d):
    k = F.col("o_orderkey")
    text = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    category = F.element_at(F.array(*map(F.lit, CATS)), (k % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("item_id"), F.col("o_custkey").alias("changeset_id"), category.alias("category"), F.when(k % 13 > 0, text("pay.", 20)).alias("field_path"), F.when(k % 7 > 0, (k % 50).cast("string")).alias("old_value"), (k % 45).cast("string").alias("proposed_value"),
        F.when(k % 9 > 0, F.array(*[F.concat(F.lit("e"), (F.col("o_custkey") + n).cast("string")) for n in (0, 1)])).otherwise(F.array().cast("array<string>")).alias("evidence_refs"), F.when(k % 2 == 0, "all").alias("scope"), F.when(k % 11 > 0, F.to_date("o_orderdate")).alias("effective_date"), ((k % 100) / 100).alias("confidence"),
        F.when(k % 4 == 0, "which?").alias("clarifying_question"), F.when(k % 10 > 0, "fc").alias("formula_candidate_id"), F.array(F.concat(F.lit("v"), F.col("o_custkey").cast("string"))).alias("affected"),
    )


def evidence(spark, d):
    """A piece of evidence for three of four customers."""
    return table(spark, d, "customer").where("c_custkey % 4 > 0").select(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("evidence_id"))


def edges(spark, d):
    """Two dependents for every fifth part."""
    k = F.col("p_partkey")
    dependent = F.explode(F.array(*[F.concat(F.lit("r"), (k + n).cast("string")) for n in (0, 1)]))
    return table(spark, d, "part").where(k % 5 == 0).select(F.concat(F.lit("v"), k.cast("string")).alias("name"), dependent.alias("dependent"))


def checked(spark, d):
    i = items(spark, d)
    fab = C.fabricated_refs(i, evidence(spark, d)).groupBy("item_id").agg(F.collect_set("ref").alias("fabricated"))
    dep = C.dependents(i, edges(spark, d))
    joined = i.join(fab.hint("shuffle_merge"), "item_id", "left").join(dep.hint("shuffle_merge"), "item_id", "left").withColumn("fabricated", F.coalesce("fabricated", F.array().cast("array<string>")))
    n = F.coalesce(F.size("dependency_ids"), F.lit(0))
    return C.validate_changes(joined).withColumn("risk_level", C.assign_risk(F.col("category"), F.when(n > 0, n).otherwise(0), F.col("confidence")))


@query("d10_fabricated", f"WITH {ITEMS} SELECT DISTINCT item_id, ref FROM (SELECT item_id, unnest(fabricated) AS ref FROM fab)")
def d10(spark, d):
    return C.fabricated_refs(items(spark, d), evidence(spark, d)).distinct()


@query("d17_dependents", f"WITH {ITEMS} SELECT item_id, 'r' || p_partkey || ',r' || (p_partkey + 1) AS deps FROM items JOIN part ON p_partkey % 5 = 0 AND affected[1] = 'v' || p_partkey")
def d17(spark, d):
    return C.dependents(items(spark, d), edges(spark, d)).select("item_id", F.array_join("dependency_ids", ",").alias("deps"))


@query("f12_validate_changes", f"WITH {ITEMS} SELECT item_id, n_errors, n_warnings FROM v")
def f12(spark, d):
    return checked(spark, d).select("item_id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query("f13_risk", f"WITH {ITEMS} SELECT item_id, risk_level FROM v")
def f13(spark, d):
    return checked(spark, d).select("item_id", "risk_level")


@query("f11_changesets", f"""WITH {ITEMS} SELECT changeset_id, CASE WHEN bool_and(category = 'EDITORIAL') THEN 'LOW' ELSE ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(CASE risk_level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END)] END AS risk_level, count(*) AS n_items, count(*) FILTER (WHERE n_errors > 0 OR category = 'AMBIGUOUS_OR_CONFLICT') AS n_unclear,
bool_or(category = 'AMBIGUOUS_OR_CONFLICT') AS blocks_release, bool_or(category = 'FORMULA_CHANGE') AS has_formula_change, bool_or(category = 'PARAMETER_CHANGE') AS has_parameter_change FROM v GROUP BY changeset_id""")
def f11(spark, d):
    return C.build_changesets(checked(spark, d))


@query("f14_changeset_gate", f"""WITH {ITEMS} SELECT changeset_id, sum(CASE WHEN category <> 'EDITORIAL' THEN (len(evidence_refs) = 0)::INT + (effective_date IS NULL)::INT + (category = 'SCOPE_CHANGE' AND scope IS NULL)::INT + (category = 'AMBIGUOUS_OR_CONFLICT' AND clarifying_question IS NULL)::INT + (category = 'FORMULA_CHANGE' AND formula_candidate_id IS NULL)::INT ELSE 0 END) AS n_errors,
count(*) FILTER (WHERE category <> 'EDITORIAL' AND confidence < 0.6) AS n_warnings, bool_or(category = 'AMBIGUOUS_OR_CONFLICT' OR (category <> 'EDITORIAL' AND confidence < 0.6)) AS needs_clarification, bool_or(category = 'AMBIGUOUS_OR_CONFLICT') AS blocks_release FROM items GROUP BY changeset_id""")
def f14(spark, d):
    return C.validate_changesets(items(spark, d))


@query("f15_draft_ops", f"WITH {ITEMS} SELECT item_id, changeset_id, field_path, old_value AS before, proposed_value AS after, 'integer' AS data_type FROM v WHERE category = 'PARAMETER_CHANGE' AND n_errors = 0")
def f15(spark, d):
    return C.draft_operations(checked(spark, d))


_TARGET = "target AS (SELECT 'S' || s_nationkey AS sheet, 'B' || s_suppkey AS cell, CAST(s_suppkey % 50 AS VARCHAR) AS value FROM supplier)"
_OPS = "ops AS (SELECT o_orderkey AS op_id, o_orderkey AS item_id, CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END AS changeset_id, 'S' || s_nationkey AS sheet, CASE WHEN o_orderkey % 10 = 0 THEN 'Z1' ELSE 'B' || s_suppkey END AS cell, CAST(CASE WHEN o_orderkey % 8 = 0 THEN 999 ELSE s_suppkey % 50 END AS VARCHAR) AS before, CAST(1000 + o_orderkey % 45 AS VARCHAR) AS after FROM orders JOIN supplier ON s_suppkey = o_orderkey % 100 WHERE o_orderkey % 6 = 1)"
_SEEN = _TARGET + ", " + _OPS + ", seen AS (SELECT ops.*, CASE WHEN target.cell IS NULL THEN 'INVALID_TARGET' WHEN value = before THEN 'READY' ELSE 'CONFLICT' END AS status FROM ops LEFT JOIN target USING (sheet, cell))"
_NEXT = _SEEN + ", ok AS (SELECT changeset_id FROM seen GROUP BY changeset_id HAVING bool_and(status = 'READY')), fine AS (SELECT sheet, cell, max_by(after, op_id) AS after FROM seen WHERE changeset_id IN (SELECT changeset_id FROM ok) GROUP BY ALL), nxt AS (SELECT sheet, cell, coalesce(after, value) AS value FROM target LEFT JOIN fine USING (sheet, cell))"


def target(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("sheet"), F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("cell"), (F.col("s_suppkey") % 50).cast("string").alias("value"))


def ops(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").where(k % 6 == 1).join(table(spark, d, "supplier"), F.col("s_suppkey") == k % 100)
    return o.select(k.alias("op_id"), k.alias("item_id"), F.when(k % 17 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("changeset_id"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("sheet"), F.when(k % 10 == 0, "Z1").otherwise(F.concat(F.lit("B"), F.col("s_suppkey").cast("string"))).alias("cell"), F.when(k % 8 == 0, 999).otherwise(F.col("s_suppkey") % 50).cast("string").alias("before"), (1000 + k % 45).cast("string").alias("after"))


@query("f16_op_checks", f"WITH {_OPS} SELECT 'not_in_set' AS \"check\", CAST(op_id AS VARCHAR) AS key FROM ops JOIN orders ON o_orderkey = op_id WHERE changeset_id <> o_custkey UNION ALL SELECT 'duplicate_target', changeset_id || '/' || sheet || '/' || cell FROM ops GROUP BY changeset_id, sheet, cell HAVING count(*) > 1")
def f16(spark, d):
    return C.op_checks(ops(spark, d), items(spark, d))


@query("d13_preview", f"WITH {_SEEN} SELECT op_id, sheet, cell, status FROM seen")
def d13(spark, d):
    return C.preview_ops(ops(spark, d), target(spark, d)).select("op_id", "sheet", "cell", "status")


def _versioned(spark, d):
    """The target as version 1, the operations drafted on it as version 2."""
    sheets = VersionedSheets(spark, shared_folder(spark, "sheets"))
    sheets.create(target(spark, d))
    return sheets, sheets.apply(ops(spark, d), digest(sheets.read()))


@query("d14_apply", f"WITH {_NEXT} SELECT * FROM nxt")
def d14(spark, d):
    sheets, version = _versioned(spark, d)
    return sheets.read(version)


@query("d15_restore", f"WITH {_TARGET} SELECT sheet, cell, value FROM target")
def d15(spark, d):
    """What is read after version 1 has been made the last one again."""
    sheets, _ = _versioned(spark, d)
    return sheets.read(sheets.restore(1))


@query("b4_reconcile", f"WITH {_NEXT} SELECT op_id, coalesce(value = after, false) AS matches FROM ops LEFT JOIN nxt USING (sheet, cell)")
def b4(spark, d):
    return C.reconcile(C.apply_ops(target(spark, d), ops(spark, d)), ops(spark, d))


_STATUS = ("draft", "ready_for_review", "in_review", "approved", "rejected", "applying", "completed", "needs_clarification")
_WHO = ("system", "analyst", "reviewer", "approver")


@query("g5_transitions", "WITH l AS (SELECT user_id AS entity_id, event_id AS seq, [" + ", ".join(f"'{s}'" for s in _STATUS) + "][CAST(event_id % 8 AS INT) + 1] AS status, [" + ", ".join(f"'{s}'" for s in _WHO) + "][CAST(event_id % 4 AS INT) + 1] AS actor, CASE WHEN event_id % 3 = 0 THEN 'why' END AS reason FROM events), p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY entity_id ORDER BY seq), 'draft') AS previous FROM l), t AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{w}')" for a, b, ws in C.TRANSITIONS for w in ws) + ") AS x(a, b, w)) SELECT entity_id, seq, previous, CASE WHEN t.a IS NULL THEN 'illegal' WHEN status = 'rejected' AND reason IS NULL THEN 'reason missing' END AS issue FROM p LEFT JOIN t ON a = previous AND b = status AND w = actor")
def g5(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    log = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), pick(_STATUS, 8).alias("status"), pick(_WHO, 4).alias("actor"), F.when(F.col("event_id") % 3 == 0, "why").alias("reason"))
    return C.check_transitions(log).select("entity_id", "seq", "previous", "issue")


@query("g6_expired", "SELECT c_custkey AS entity_id, c_custkey % 3 > 0 AND c_custkey % 5 = 0 AS expired FROM customer")
def g6(spark, d):
    c = table(spark, d, "customer")
    approvals = c.select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 3 > 0, "b1").alias("approved_baseline"))
    now = c.select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 5 == 0, "b2").otherwise("b1").alias("current_baseline"))
    return C.expired_approvals(approvals, now)


def formula_rules(spark, d, version=1):
    p = table(spark, d, "part")
    keep = p.where("p_partkey % 11 > 0") if version == 1 else p.where("p_partkey % 13 > 0")
    expression = F.when((F.col("p_partkey") % 5 == 0) & F.lit(version == 2), F.concat("p_name", F.lit(" * 2"))).otherwise(F.col("p_name"))
    place = F.when((F.col("p_partkey") % 7 == 0) & F.lit(version == 2), F.col("p_partkey") + 1).otherwise(F.col("p_partkey"))
    return keep.select(F.col("p_brand").alias("formula"), F.concat(F.lit("OUT_"), F.col("p_partkey").cast("string")).alias("output_field"), expression.alias("expression"), place.alias("place"))


@query("e7_formula_diff", "SELECT p_brand AS formula, 'OUT_' || p_partkey AS output_field, CASE WHEN p_partkey % 11 = 0 THEN 'added' WHEN p_partkey % 13 = 0 THEN 'removed' WHEN p_partkey % 5 = 0 THEN 'changed' WHEN p_partkey % 7 = 0 THEN 'moved' ELSE 'same' END AS change FROM part WHERE NOT (p_partkey % 11 = 0 AND p_partkey % 13 = 0)")
def e7(spark, d):
    return C.diff_formulas(formula_rules(spark, d), formula_rules(spark, d, 2))


@query("e8_overrides", "SELECT p_brand AS formula, 'v' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'literal' ELSE 'employee' END ELSE 'attendance' END AS source, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END ELSE 1.0 END AS value, p_type AS category FROM part")
def e8(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("name")
    variables = p.select(F.col("p_brand").alias("formula"), name, F.lit("attendance").alias("source"), F.lit(1.0).alias("value"), F.col("p_type").alias("category"))
    edits = p.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("formula"), name, F.lit("employee").alias("source"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("value"))
    return C.apply_overrides(variables, edits)


def raw_rules(spark, d):
    """Rules as a model may write them: one formula per supplier, a rule per row."""
    k = F.col("p_partkey") % 8
    expression = F.coalesce(*[F.when(k == i, F.lit(t)) for i, t in enumerate(("basic / 26", "if paid > 20 then basic else 0", "employee.basic * 2", "bonus + unknown_name", "R0 + R1", "basic ** 2", "min(basic, 10", "R7 * 1.1"))])
    condition = F.when(k == 0, "when the month is full").when(k == 2, "paid == true").when(k == 3, "paid > 3")
    rounding = F.when(k == 1, "Floor").when(k == 3, "nearest_currency").when(k == 4, "none").when(k == 5, "round_up")
    section = F.when(k == 4, "net").when(k == 2, "deductions").when(k == 6, "other")
    output = F.when(F.col("p_partkey") % 24 == 9, "R0").otherwise(F.concat(F.lit("R"), k.cast("string")))
    return table(spark, d, "part").select((F.col("p_partkey") / 8).cast("long").alias("formula_id"), k.alias("place"), output.alias("output_field"), expression.alias("expression"), condition.alias("condition"), rounding.alias("rounding"), section.alias("section"))


_RAW_RULES = """raw AS (SELECT p_partkey // 8 AS formula_id, p_partkey % 8 AS place, CASE WHEN p_partkey % 24 = 9 THEN 'R0' ELSE 'R' || (p_partkey % 8) END AS output_field,
CASE p_partkey % 8 WHEN 0 THEN 'basic / 26' WHEN 1 THEN 'if paid > 20 then basic else 0' WHEN 2 THEN 'employee.basic * 2' WHEN 3 THEN 'bonus + unknown_name' WHEN 4 THEN 'R0 + R1' WHEN 5 THEN 'basic ** 2' WHEN 6 THEN 'min(basic, 10' ELSE 'R7 * 1.1' END AS expression,
CASE p_partkey % 8 WHEN 0 THEN 'when the month is full' WHEN 2 THEN 'paid == true' WHEN 3 THEN 'paid > 3' END AS condition,
CASE p_partkey % 8 WHEN 1 THEN 'Floor' WHEN 3 THEN 'nearest_currency' WHEN 4 THEN 'none' WHEN 5 THEN 'round_up' END AS rounding,
CASE p_partkey % 8 WHEN 4 THEN 'net' WHEN 2 THEN 'deductions' WHEN 6 THEN 'other' END AS section FROM part)"""


def _rewritten(c: str) -> str:
    plain = f"regexp_replace(regexp_replace(replace(trim({c}), 'employee.', ''), '(?i)\\btrue\\b', 'True', 'g'), '(?i)\\bfalse\\b', 'False', 'g')"
    return f"regexp_replace({plain}, '(?i)^if\\s+(.+?)\\s+then\\s+(.+?)\\s+else\\s+(.+)$', '(\\2) if (\\1) else (\\3)')"


@query("c19_clean_rules", f"""WITH {_RAW_RULES}, n AS (SELECT *, row_number() OVER (PARTITION BY formula_id, output_field ORDER BY place) AS nth, {_rewritten("condition")} AS said, lower(trim(coalesce(rounding, ''))) AS rounds FROM raw)
SELECT formula_id, place, CASE WHEN nth > 1 THEN output_field || '_' || nth ELSE output_field END AS output_field, {_rewritten("expression")} AS expression, CASE WHEN regexp_matches(said, '^\\w+ *(==|!=|<=?|>=?) *\\w+$') THEN said END AS condition,
CASE WHEN rounds IN ('', 'none', 'no', 'null') THEN NULL WHEN rounds IN {FO.ROUND_NAMES!r} THEN 'round' WHEN rounds IN {FO.FLOOR_NAMES!r} THEN 'round_down_1000' ELSE rounds END AS rounding, section FROM n WHERE lower(trim(coalesce(section, ''))) <> 'net'""")
def c19(spark, d):
    """Conditions of one comparison are sentences of the rule language, the rest is prose."""
    return FO.clean_rules(raw_rules(spark, d))


@query("e5_lint")
def e5(spark, d):
    variables = table(spark, d, "part").select((F.col("p_partkey") / 8).cast("long").alias("formula_id"), F.explode(F.array(F.lit("basic"), F.lit("paid"))).alias("name")).distinct()
    variables = variables.withColumn("source", F.when((F.col("formula_id") % 4 == 0) & (F.col("name") == "paid"), "magic").otherwise("employee")).withColumn("field_code", F.when(F.col("formula_id") % 3 == 0, "base_salary").otherwise("basic_salary"))
    rules = FO.clean_rules(raw_rules(spark, d)).withColumn("category", F.when(F.col("place") % 3 == 0, "PIT").when(F.col("place") % 3 == 1, "BASIC"))
    rules = written(rules, "rules")
    categories = rules.select("formula_id", F.col("output_field").alias("code"), F.when(F.col("formula_id") % 2 == 0, "line_items").when(F.col("place") % 2 == 0, "deductions").otherwise("line_items").alias("section"))
    return FO.lint_formulas(variables, rules, tuple(f"R{i}" for i in range(7)), categories)


UP = "up AS (SELECT p_partkey AS policy_id, p_brand AS policy_key, CASE WHEN p_partkey % 29 = 0 THEN 'OTHER' ELSE p_type END AS category, p_partkey AS uploaded, sha256(p_name) AS checksum, DATE '1995-01-01' + p_size AS effective_date, CASE WHEN p_partkey % 4 > 0 THEN DATE '1995-01-15' + p_size + CAST(p_partkey % 30 AS INT) END AS expiry_date FROM part)"
_W = "WINDOW w AS (PARTITION BY policy_key ORDER BY uploaded, policy_id)"


def uploads(spark, d):
    k = F.col("p_partkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size"))
    return table(spark, d, "part").select(k.alias("policy_id"), F.col("p_brand").alias("policy_key"), F.when(k % 29 == 0, "OTHER").otherwise(F.col("p_type")).alias("category"), k.alias("uploaded"), F.sha2("p_name", 256).alias("checksum"), start.alias("effective_date"), F.when(k % 4 > 0, F.date_add(F.lit("1995-01-15").cast("date"), F.col("p_size") + (k % 30).cast("int"))).alias("expiry_date"))


@query("g2_versions", f"WITH {UP} SELECT policy_id, CAST(row_number() OVER w AS INT) AS version, CASE WHEN lead(policy_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM up {_W}")
def g2(spark, d):
    return G.assign_versions(uploads(spark, d)).select("policy_id", "version", "status")


@query("g3_dedup", f"WITH {UP} SELECT policy_id, nullif(first_value(policy_id) OVER (PARTITION BY policy_key, checksum ORDER BY uploaded, policy_id), policy_id) AS duplicate_of FROM up")
def g3(spark, d):
    return G.dedup_uploads(uploads(spark, d)).select("policy_id", "duplicate_of")


@query("g4_category_change", f"WITH {UP} SELECT policy_id, lag(category) OVER w AS previous_category, coalesce(category <> lag(category) OVER w, false) AS changed FROM up {_W}")
def g4(spark, d):
    return G.category_changes(uploads(spark, d)).select("policy_id", "previous_category", "changed")


@query("g10_listing", f"WITH {UP} SELECT policy_id, CAST(row_number() OVER w AS INT) AS version_place, CAST(row_number() OVER (PARTITION BY category ORDER BY uploaded DESC, policy_id DESC) AS INT) AS newest_place FROM up {_W}")
def g10(spark, d):
    return G.listing(uploads(spark, d)).select("policy_id", "version_place", "newest_place")


@query("d8_overlaps", f"""WITH {UP}, act AS (SELECT * FROM up WHERE policy_id % 3 = 0) SELECT a.policy_id AS policy_a, b.policy_id AS policy_b, a.category, greatest(a.effective_date, b.effective_date) AS overlap_start,
least(a.expiry_date, b.expiry_date) AS overlap_end FROM act a JOIN act b ON a.category = b.category AND a.policy_id < b.policy_id AND a.policy_key <> b.policy_key AND greatest(a.effective_date, b.effective_date) <= coalesce(least(a.expiry_date, b.expiry_date), DATE '2200-12-31')""")
def d8(spark, d):
    return G.overlaps(uploads(spark, d).withColumn("status", F.when(F.col("policy_id") % 3 == 0, "active").otherwise("archived")))


@query("f18_uploads", f"WITH {UP} SELECT policy_id, (policy_id % 6 = 0)::INT + coalesce(policy_id % 10 = 0 AND policy_id % 4 > 0, false)::INT AS n_errors FROM up")
def f18(spark, d):
    u = uploads(spark, d).withColumn("title", F.when(F.col("policy_id") % 6 > 0, "t")).withColumn("expiry_date", F.when(F.col("policy_id") % 10 == 0, F.when(F.col("expiry_date").isNotNull(), F.lit("1990-01-01").cast("date"))).otherwise(F.col("expiry_date")))
    return G.check_uploads(u, ("policy_key", "title")).select("policy_id", F.size("errors").alias("n_errors"))


ASKERS = [("ann", "src0", ["en", "de"], 2, "2024-06-01"), ("bob", "src1", ["fr"], 3, "2024-03-01"), ("cy", "src0", ["es", "en"], 0, "2025-03-01")]
_ITEM = "it AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS item_company, CASE WHEN doc_id % 7 > 0 THEN lang END AS sc, DATE '2024-01-01' + CAST(doc_id % 400 AS INT) AS eff, CASE WHEN doc_id % 3 = 0 THEN DATE '2024-02-01' + CAST(doc_id % 400 AS INT) END AS expd, CAST(doc_id % 4 AS INT) AS req FROM documents)"
_ASK = "ask AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{c}', {s!r}, {p}, DATE '{t}')" for a, c, s, p, t in ASKERS) + ") AS x(asker, company, scopes, permission, as_of))"
DECIDED = f"{_ITEM}, {_ASK}, dec AS (SELECT asker, doc_id, CASE WHEN item_company <> company THEN 'company' WHEN NOT list_contains(scopes, sc) THEN 'scope' WHEN eff > as_of THEN 'not_effective' WHEN expd < as_of THEN 'expired' WHEN permission < req THEN 'permission' END AS reason FROM it, ask)"


def askers(spark):
    from datetime import date

    return spark.createDataFrame([(a, c, s, p, date.fromisoformat(t)) for a, c, s, p, t in ASKERS], "asker string, company string, scopes array<string>, permission int, as_of date")


def access_items(spark, d):
    k = F.col("doc_id")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.when(k % 5 > 0, F.col("source")).alias("item_company"), F.when(k % 7 > 0, F.array("lang")).alias("item_scopes"), start.alias("effective_date"), F.when(k % 3 == 0, F.date_add(F.lit("2024-02-01").cast("date"), (k % 400).cast("int"))).alias("expiry_date"), (k % 4).cast("int").alias("required_permission"))


@query("d9_access", f"WITH {DECIDED} SELECT * FROM dec")
def d9(spark, d):
    return G.access_decisions(access_items(spark, d), askers(spark)).select("asker", "doc_id", "reason")


@query("i9_metadata", "SELECT doc_id, 'lang=' || lang || ';source=' || CASE WHEN doc_id % 2 = 0 THEN 'chunk' ELSE source END AS metadata FROM documents")
def i9(spark, d):
    docs = table(spark, d, "documents")
    chunk = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("chunk"))).otherwise(F.create_map().cast("map<string,string>"))
    base = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    merged = R.merged_metadata(base, chunk)
    return docs.select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("metadata"))


@query("i10_point_id", "SELECT doc_id, substr(sha256(source || '|' || doc_id || '|' || sha256(text)), 1, 32) AS point_id FROM documents")
def i10(spark, d):
    return table(spark, d, "documents").select("doc_id", R.point_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("point_id"))

