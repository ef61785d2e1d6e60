"""Versions of sheets, vectors in balls, interval overlaps, column assignment, readers."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import ingest, registry, retrieval
from ledgerline.operators.versions import ChangedTarget, VersionedSheets, digest
from ledgerline.sources import io

CELLS = "sheet string, cell string, value string"
OPS = "op_id long, changeset_id long, sheet string, cell string, before string, after string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_are_checked_and_pruned(spark, tmp_path):
    cells = spark.createDataFrame([(f"s{i % 20}", f"B{i}", str(i)) for i in range(200)], CELLS)
    sheets = VersionedSheets(spark, f"file://{tmp_path}/sheets", buckets=8)
    assert sheets.create(cells) == 1 and rows(sheets.read()) == rows(cells)
    drafted = digest(sheets.read())
    assert drafted == digest(cells.repartition(7)) != digest(cells.limit(199))
    ops = spark.createDataFrame([(1, 1, "s3", "B3", "3", "new"), (2, 2, "s4", "B4", "4", "x"), (3, 2, "s4", "B24", "wrong", "y"), (4, 3, "s5", "none", "1", "2")], OPS)
    assert sheets.apply(ops, drafted) == 2
    want = [(s, c, "new" if c == "B3" else v) for s, c, v in rows(cells)]  # set 2 conflicts and set 3 has no target
    assert rows(sheets.read()) == sorted(want, key=str) and rows(sheets.read(1)) == rows(cells)
    folders = sorted(p.name for p in (tmp_path / "sheets" / "version=2").glob("bucket=*"))
    assert len(folders) == 1  # the sheets of other buckets aren't written again
    with pytest.raises(ChangedTarget):
        sheets.apply(ops, drafted)
    assert sheets.last() == 2
    plan = sheets.read(1)._jdf.queryExecution().executedPlan().toString()
    assert "version" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert sheets.restore(1) == 3 and rows(sheets.read()) == rows(cells) and rows(sheets.read(2)) == sorted(want, key=str)
    assert sheets.restore(3) == 3
    none = spark.createDataFrame([], OPS)
    assert sheets.apply(none, digest(sheets.read())) == 3
    empty = VersionedSheets(spark, f"file://{tmp_path}/empty")
    empty.create(spark.createDataFrame([], CELLS))
    assert empty.read().count() == 0 and empty.apply(ops, digest(empty.read())) == 0


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_vectors_in_balls_are_exact(spark, metric):
    """3,000 vectors around 30 centres, ties, nulls and other lengths: all equal to comparing every pair."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8)) * 6
    v = [(i, (centres[i % 30] + rng.normal(size=8) * 0.2).tolist()) for i in range(2900)]
    v += [(3000 + i, v[i][1]) for i in range(50)] + [(4000, None), (4001, [1.0, 2.0]), (4002, [2.0, 1.0]), (4003, [])]
    vectors = spark.createDataFrame(v, "chunk long, vec array<double>")
    queries = vectors.where("chunk % 200 = 0 or chunk > 4000").withColumnRenamed("chunk", "query")
    want = [(r["query"], r["rank"], r["chunk"], round(r["score"], 7)) for r in retrieval.vector_topk(vectors, queries, 6, metric).collect()]
    balls = retrieval.VectorBalls(vectors, metric, max_pivots=64, slice_rows=40)
    got = [(r["query"], r["rank"], r["chunk"], round(r["score"], 7)) for r in balls.topk(queries, 6).collect()]
    assert sorted(got) == sorted(want) and len(want) > 80
    begun, rest = balls.plan(queries, 6)
    sizes = {r["ball"]: r["n"] for r in balls.balls.collect()}
    met = sum(sizes[r["ball"]] for r in rest.collect()) + 4 * max(sizes.values()) * queries.count()
    assert met < 0.5 * vectors.count() * queries.count()  # most rows are never scored


def plain_overlaps(policies):
    lo, hi = (lambda p: p[4] or date(1900, 1, 1)), (lambda p: p[5] or date(2200, 12, 31))
    out = []
    for a in policies:
        for b in policies:
            if a[0] < b[0] and a[1] != b[1] and a[2] == b[2] and a[3] == b[3] == "active" and max(lo(a), lo(b)) <= min(hi(a), hi(b)):
                out.append((a[0], b[0], a[2], None if a[4] is b[4] is None else max(lo(a), lo(b)), None if a[5] is b[5] is None else min(hi(a), hi(b))))
    return sorted(out, key=str)


def test_overlaps_against_all_pairs(spark):
    """A category with a third of all intervals, open ends, single days, equal days, empty intervals."""
    rng = random.Random(4)
    day = lambda: date(2019, 12, 25) + timedelta(days=rng.choice([0, 0, 1, 7, rng.randint(0, 4000)]))
    policies = []
    for i in range(240):
        a, b = day(), day()
        a, b = (a, b) if rng.random() < 0.1 else (min(a, b), max(a, b))
        policies.append((i, f"k{rng.randint(0, 90)}", "hot" if i % 3 == 0 else f"c{i % 7}", "archived" if i % 20 == 1 else "active", None if rng.random() < 0.15 else a, None if rng.random() < 0.2 else b))
    table = spark.createDataFrame(policies, "policy_id long, policy_key string, category string, status string, effective_date date, expiry_date date")
    assert rows(registry.overlaps(table)) == plain_overlaps(policies)
    assert registry.overlaps(table.limit(0)).count() == 0


POLICIES = "policy_id long, policy_key string, category string, status string, effective_date date, expiry_date date"


def test_overlaps_in_cells(spark):
    """Blocks of a few rows leave the pairs as they are; ends beyond those of open intervals are kept."""
    rng = random.Random(9)
    day = lambda: date(2019, 12, 25) + timedelta(days=rng.choice([0, 0, 1, 7, rng.randint(0, 900)]))
    policies = [(i, f"k{rng.randint(0, 30)}", "hot" if i % 3 else "c", "active", None if rng.random() < 0.3 else day(), None if rng.random() < 0.3 else day() + timedelta(days=400)) for i in range(200)]
    table = spark.createDataFrame(policies, POLICIES)
    assert rows(registry.overlaps(table, block=7)) == rows(registry.overlaps(table)) == plain_overlaps(policies)
    far = spark.createDataFrame([(1, "a", "X", "active", date(2020, 1, 1), date(2300, 1, 1)), (2, "b", "X", "active", date(2020, 2, 1), None)], POLICIES)
    assert rows(registry.overlaps(far)) == [(1, 2, "X", date(2020, 2, 1), date(2300, 1, 1))]


def test_overlaps_of_far_dates(spark):
    """Days before 1900 and ends like 9999-12-31, of open beginnings too."""
    rng = random.Random(3)
    first, last = [None, date(1850, 3, 1), date(1871, 7, 12), date(1899, 12, 31), date(1995, 5, 5)], [None, date(1899, 12, 31), date(1995, 5, 5), date(2300, 1, 1), date(2700, 2, 2), date(9999, 12, 31)]
    policies = [(i, f"k{i % 11}", "c", rng.choice(first), rng.choice(last)) for i in range(120)]
    lo, hi = (lambda p: p[3] or date(1900, 1, 1)), (lambda p: p[4] or date(2200, 12, 31))
    want = {(a[0], b[0]) for a in policies for b in policies if a[0] < b[0] and a[1] != b[1] and max(lo(a), lo(b)) <= min(hi(a), hi(b)) and lo(a) <= hi(a) and lo(b) <= hi(b)}
    table = spark.createDataFrame([(*p[:3], "active", *p[3:]) for p in policies], POLICIES)
    got = [(r["policy_a"], r["policy_b"]) for r in registry.overlaps(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_overlaps_of_one_stretch_are_spread(spark):
    """Intervals that all begin on a day and stay open meet in one stretch; no task makes half of their pairs."""
    n = 9000
    table = spark.range(n).selectExpr("id policy_id", "concat('k', id) policy_key", "if(id < 0, 'Y', 'X') category", "'active' status", "date'2020-01-01' effective_date", "cast(null as date) expiry_date")
    made = [r["count"] for r in registry.overlaps(table).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(made) == n * (n - 1) // 2 and max(made) < sum(made) / 2


def test_overlaps_follow_dates(spark):
    """Pairs that follow each other mostly share their dates, which takes few bytes in files."""
    rng = random.Random(8)
    policies = []
    for i in range(600):
        start = date(2020, 1, 1) + timedelta(days=rng.randint(0, 9))
        policies.append((i, f"k{rng.randint(0, 24)}", "X", "active", start, None if i % 4 == 0 else start + timedelta(days=14 + 3 * rng.randint(0, 3))))
    pairs = [(r["overlap_start"], r["overlap_end"]) for r in registry.overlaps(spark.createDataFrame(policies, POLICIES)).collect()]
    assert len(pairs) > 100_000 and sum(x != y for x, y in zip(pairs, pairs[1:])) < 0.25 * len(pairs)


def test_askers_in_blocks(spark):
    items = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("item_company"), F.lit(None).cast("array<string>").alias("item_scopes"), F.lit(None).cast("date").alias("effective_date"), F.lit(None).cast("date").alias("expiry_date"), (F.col("id") % 3).cast("int").alias("required_permission"))
    askers = spark.range(50).select(F.concat(F.lit("a"), "id").alias("asker"), F.lit("c").alias("company"), F.array(F.lit("x")).alias("scopes"), (F.col("id") % 3).cast("int").alias("permission"), F.current_date().alias("as_of"))
    one = registry.access_decisions(items, askers).select("asker", "doc_id", "reason")
    assert rows(registry.access_decisions(items, askers, max_askers=7).select("asker", "doc_id", "reason")) == rows(one) and one.count() == 1000


def test_column_assignment_against_plain_greedy(spark):
    rng = random.Random(8)
    labels = ["Lương cơ bản", "Basic salary", "Basic", "Iban", "IBAN", "OT night holiday 300%", "Ngày công", "Meal", "x", "", "Days worked in month"]
    need = ["basic_salary", "iban", "days_worked_in_month", "meal_allowance", "zz", "x"]
    heads = [(f"s{s}", c, rng.choice(labels)) for s in range(40) for c in rng.sample(range(30), 6)] + [("s0", 3, "Basic"), ("s0", 3, "Basic")]
    required = [(f"s{s}", f) for s in range(41) for f in rng.sample(need, 4)]
    h = spark.createDataFrame(heads, "sheet string, col int, label string")
    got = {(r["sheet"], r["field_code"]): r["label"] for r in ingest.map_columns(h, spark.createDataFrame(required, "sheet string, field_code string"), None).collect()}
    told = {(r["label"]): (r["code"], r["name"]) for r in h.select("label").distinct().select("label", S.suggest_code(F.col("label")).alias("code"), S.normalize_label(F.col("label")).alias("name")).collect()}
    alias = {a: code for code, _, aliases in S.FIELD_CATALOG for a in (*aliases, code)}
    want = {}
    for s in {s for s, _ in required}:
        free = sorted((c, x) for t, c, x in heads if t == s)
        for f in sorted(f for t, f in required if t == s):
            expected = alias.get(f, f)
            fits = [(alias.get(told[x][0], told[x][0]) != expected, c, i) for i, (c, x) in enumerate(free) if alias.get(told[x][0], told[x][0]) == expected or told[x][1] == f]
            want[s, f] = free.pop(min(fits)[2])[1] if fits else None
    assert got == want and any(got.values())


def test_cells_and_broken_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "pay.csv").write_text('Code,"Name, full",\n1,"says ""hi""",3\n\n,,x\n', encoding="utf-8")
    (tmp_path / "in" / "leer.csv").write_text("", encoding="utf-8")
    got = rows(io.read_cells(spark, f"file://{tmp_path}/in").where("value is not null"))
    assert got == sorted([("pay", 1, 1, "Code"), ("pay", 1, 2, "Name, full"), ("pay", 2, 1, "1"), ("pay", 2, 2, 'says "hi"'), ("pay", 2, 3, "3"), ("pay", 4, 3, "x")], key=str)
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"a": 1, "b": "x"}\nbroken\n{"a": "no number", "b": "y"}\n{"b": null}\n')
    read = io.read_checked(spark, f"file://{tmp_path}/j", "a int, b string")
    assert sorted((r["a"], r["b"], r["corrupt"]) for r in read.collect() if r["corrupt"] is None and r["a"]) == [(1, "x", None)]
    assert {r["corrupt"] for r in read.collect()} == {None, "broken", '{"a": "no number", "b": "y"}'}
