"""Change control: checks, risk, change sets, operations and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S

#: Risk levels in order, and the level of each category.
RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
CATEGORY_RISK = {"EDITORIAL": "LOW", "PARAMETER_CHANGE": "MEDIUM", "FORMULA_CHANGE": "HIGH", "SCOPE_CHANGE": "HIGH", "REGULATORY_REFERENCE": "MEDIUM", "AMBIGUOUS_OR_CONFLICT": "HIGH"}
LOW_CONFIDENCE = 0.6
#: Legal status changes and who may make them.
TRANSITIONS = (
    ("draft", "ready_for_review", ("system",)),
    ("draft", "needs_clarification", ("system",)),
    ("needs_clarification", "draft", ("analyst", "system")),
    ("needs_clarification", "rejected", ("analyst", "reviewer")),
    ("ready_for_review", "in_review", ("reviewer", "system")),
    ("in_review", "approved", ("approver",)),
    ("in_review", "rejected", ("reviewer", "approver")),
    ("in_review", "needs_clarification", ("reviewer", "approver")),
    ("approved", "applying", ("system",)),
    ("applying", "completed", ("system",)),
    ("applying", "failed", ("system",)),
    ("failed", "rolled_back", ("approver", "system")),
    ("completed", "rolled_back", ("approver", "system")),
)


def risk_order(risk: Column) -> Column:
    return F.coalesce(*[F.when(risk == r, F.lit(i)) for i, r in enumerate(RISKS)])


def risk_name(order: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), order.cast("int") + 1)


def assign_risk(category: Column, n_dependents: Column, confidence: Column) -> Column:
    """Category's level; rules and law are critical, dependents raise it, low confidence raises LOW."""
    base = F.coalesce(*[F.when(category == c, F.lit(r)) for c, r in CATEGORY_RISK.items()])
    return F.when(category == "REGULATORY_REFERENCE", "CRITICAL").when((n_dependents > 0) & base.isin("LOW", "MEDIUM"), "HIGH").when((confidence < LOW_CONFIDENCE) & (base == "LOW"), "MEDIUM").otherwise(base)


def fabricated_refs(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """(item_id, ref): references that aren't among the evidence."""
    return items.select("item_id", F.explode("evidence_refs").alias("ref")).join(evidence.select(F.col("evidence_id").alias("ref")).distinct().hint("shuffle_merge"), "ref", "left_anti").select("item_id", "ref")


def dependents(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item_id, dependency_ids): one hop from the names that a change affects, distinct and sorted."""
    named = changes.select("item_id", F.explode("affected").alias("name")).join(edges.hint("shuffle_merge"), "name")
    return named.groupBy("item_id").agg(F.array_sort(F.collect_set("dependent")).alias("dependency_ids"))


def validate_changes(items: DataFrame) -> DataFrame:
    """Adds ``errors`` and ``warnings``, arrays of messages."""
    is_ = lambda *c: F.col("category").isin(*c)
    old, new = F.col("old_value"), F.col("proposed_value")
    says = lambda *pairs: F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(text)) for when, text in pairs]))
    errors = says(
        (F.coalesce("field_path", F.lit("")) == "", "field_path is required"), (F.coalesce(F.size("evidence_refs"), F.lit(0)) <= 0, "no evidence_refs"), (F.size("fabricated") > 0, "fabricated evidence_refs"),
        (is_("PARAMETER_CHANGE", "FORMULA_CHANGE") & (old.isNull() | new.isNull()), "old_value and new_value are required"), (is_("SCOPE_CHANGE") & F.col("scope").isNull(), "scope is required"),
        (is_("AMBIGUOUS_OR_CONFLICT") & (F.coalesce("clarifying_question", F.lit("")) == ""), "clarifying_question is required"), (F.col("effective_date").isNull() & ~is_("EDITORIAL", "AMBIGUOUS_OR_CONFLICT"), "effective_date is required"),
    )
    warnings = says((is_("PARAMETER_CHANGE", "FORMULA_CHANGE") & (old.try_cast("double") == new.try_cast("double")), "old_value equals new_value"), (F.col("confidence") < LOW_CONFIDENCE, "low confidence"))
    return items.withColumns({"errors": errors, "warnings": warnings})


def build_changesets(items: DataFrame) -> DataFrame:
    """(changeset_id, risk_level, n_items, n_unclear, blocks_release, has_formula_change, has_parameter_change)."""
    unclear = (F.size("errors") > 0) | (F.col("category") == "AMBIGUOUS_OR_CONFLICT")
    grouped = items.groupBy("changeset_id").agg(
        F.max(risk_order(F.col("risk_level"))).alias("risk"), F.bool_and(F.col("category") == "EDITORIAL").alias("editorial"), F.count("*").alias("n_items"), F.count_if(unclear).alias("n_unclear"),
        F.bool_or(F.col("category") == "AMBIGUOUS_OR_CONFLICT").alias("blocks_release"), F.bool_or(F.col("category") == "FORMULA_CHANGE").alias("has_formula_change"), F.bool_or(F.col("category") == "PARAMETER_CHANGE").alias("has_parameter_change"),
    )
    return grouped.select("changeset_id", F.when(F.col("editorial"), "LOW").otherwise(risk_name(F.col("risk"))).alias("risk_level"), "n_items", "n_unclear", "blocks_release", "has_formula_change", "has_parameter_change")


def validate_changesets(items: DataFrame) -> DataFrame:
    """(changeset_id, n_errors, n_warnings, needs_clarification, blocks_release): coverage of the items that aren't editorial."""
    c = F.col("category")
    missing = lambda *when: sum((F.when(F.coalesce(w, F.lit(False)), 1).otherwise(0) for w in when), F.lit(0))
    ambiguous, low = c == "AMBIGUOUS_OR_CONFLICT", F.col("confidence") < LOW_CONFIDENCE
    errors = missing(F.coalesce(F.size("evidence_refs"), F.lit(0)) <= 0, F.col("effective_date").isNull(), (c == "SCOPE_CHANGE") & F.col("scope").isNull(), ambiguous & (F.coalesce("clarifying_question", F.lit("")) == ""), (c == "FORMULA_CHANGE") & F.col("formula_candidate_id").isNull())
    real = c != "EDITORIAL"
    return items.groupBy("changeset_id").agg(F.sum(F.when(real, errors).otherwise(0)).alias("n_errors"), F.count_if(real & low).alias("n_warnings"), F.bool_or(ambiguous | (real & low)).alias("needs_clarification"), F.bool_or(ambiguous).alias("blocks_release"))


def draft_operations(items: DataFrame) -> DataFrame:
    """Operations of the parameter changes that are ready."""
    ready = (F.size("errors") == 0) & F.col("old_value").isNotNull() & F.col("proposed_value").isNotNull() & F.col("effective_date").isNotNull()
    return items.where((F.col("category") == "PARAMETER_CHANGE") & ready).select("item_id", "changeset_id", "field_path", F.col("old_value").alias("before"), F.col("proposed_value").alias("after"), S.value_kind(F.col("proposed_value")).alias("data_type"))


def op_checks(ops: DataFrame, items: DataFrame) -> DataFrame:
    """(check, key): operations outside their set, and targets hit twice."""
    stray = ops.join(items.select("item_id", "changeset_id").hint("shuffle_merge"), ["item_id", "changeset_id"], "left_anti").select(F.lit("not_in_set").alias("check"), F.col("op_id").cast("string").alias("key"))
    twice = ops.groupBy("changeset_id", "sheet", "cell").count().where("count > 1").select(F.lit("duplicate_target").alias("check"), F.concat_ws("/", F.col("changeset_id").cast("string"), "sheet", "cell").alias("key"))
    return stray.unionByName(twice)


def preview_ops(ops: DataFrame, target: DataFrame) -> DataFrame:
    """Adds status READY / CONFLICT / INVALID_TARGET by what the target holds now."""
    now = target.select("sheet", "cell", F.col("value").alias("current"), F.lit(True).alias("there"))
    joined = ops.join(now, ["sheet", "cell"], "left")
    return joined.withColumn("status", F.when(F.col("there").isNull(), "INVALID_TARGET").when(S.same_value(F.col("current"), F.col("before")), "READY").otherwise("CONFLICT")).drop("there")


def apply_ops(target: DataFrame, ops: DataFrame) -> DataFrame:
    """The next version of the target: change sets apply as a whole, and only
    if each of their operations is READY; else their cells stay."""
    seen = preview_ops(ops, target)
    whole = Window.partitionBy("changeset_id")
    fine = seen.withColumn("ok", F.bool_and(F.col("status") == "READY").over(whole)).where("ok").groupBy("sheet", "cell").agg(F.max_by("after", "op_id").alias("after"))
    return target.join(fine, ["sheet", "cell"], "left").select("sheet", "cell", F.coalesce("after", "value").alias("value"))


def reconcile(target: DataFrame, ops: DataFrame) -> DataFrame:
    """(op_id, matches): whether the re-read target holds what was to be written."""
    joined = ops.join(target.select("sheet", "cell", "value"), ["sheet", "cell"], "left")
    return joined.select("op_id", S.same_value(F.col("value"), F.col("after")).alias("matches"))


def check_transitions(log: DataFrame, table=TRANSITIONS, start: str = "draft") -> DataFrame:
    """Adds ``previous`` and ``issue`` (null if legal): each entity's status changes in order."""
    previous = F.coalesce(F.lag("status").over(Window.partitionBy("entity_id").orderBy("seq")), F.lit(start))
    step = F.concat_ws(">", F.col("previous"), F.col("status"))
    legal = F.coalesce(*[F.when((step == f"{a}>{b}") & F.col("actor").isin(*who), F.lit(True)) for a, b, who in table], F.lit(False))
    issue = F.when(~legal, "illegal").when((F.col("status") == "rejected") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "reason missing")
    return log.withColumn("previous", previous).withColumn("issue", issue)


def expired_approvals(approvals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(entity_id, expired): whether the baseline changed since the approval."""
    return approvals.join(snapshots, "entity_id", "left").select("entity_id", (F.col("approved_baseline").isNotNull() & ~F.col("approved_baseline").eqNullSafe(F.col("current_baseline"))).alias("expired"))


def diff_formulas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(formula, output_field, change) of rules ``(formula, output_field, expression, place)``; order changes included."""
    a = old.select("formula", "output_field", F.col("expression").alias("old"), F.col("place").alias("old_place"))
    b = new.select("formula", "output_field", F.col("expression").alias("new"), F.col("place").alias("new_place"))
    both = a.join(b, ["formula", "output_field"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").when(F.col("old_place") != F.col("new_place"), "moved").otherwise("same")
    return both.select("formula", "output_field", change.alias("change"))


def apply_overrides(variables: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited variables: a fixed value makes an input a literal; metadata stays with its name."""
    e = edits.select("formula", "name", F.col("source").alias("new_source"), F.col("value").alias("new_value"), F.lit(True).alias("edited"))
    joined = variables.join(e, ["formula", "name"], "left")
    source = F.when(F.col("edited"), F.when(F.col("new_value").isNotNull() & F.col("new_source").isin("employee", "attendance"), "literal").otherwise(F.col("new_source"))).otherwise(F.col("source"))
    return joined.select("formula", "name", source.alias("source"), F.when(F.col("edited"), F.col("new_value")).otherwise(F.col("value")).alias("value"), "category")


def type_changes(response: Column) -> Column:
    """A model's JSON answer as struct(category, confidence, effective_date, evidence_refs).

    The category is upper-cased and must be one of the known ones, else it is
    AMBIGUOUS_OR_CONFLICT; an answer without an object has a null category.
    """
    x = F.from_json(S.extract_json(response), "category string, confidence double, effective_date string, evidence_refs array<string>")
    category = F.upper(F.trim(x["category"]))
    return F.struct(
        F.when(category.isNull() | category.isin(*CATEGORY_RISK), category).otherwise("AMBIGUOUS_OR_CONFLICT").alias("category"),
        F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"), x["effective_date"].try_cast("date").alias("effective_date"),
        F.coalesce(x["evidence_refs"], F.array().cast("array<string>")).alias("evidence_refs"),
    )
