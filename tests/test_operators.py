"""Documents, grids, change control, logs, retrieval on small tables; every query runs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import changes, documents, formulas, grid, logs, matching, payroll, registry, retrieval
from ledgerline.plans import catalog
from ledgerline.sources import io


def test_blocks_and_paths(spark):
    text = "Phần I. Chung\nĐiều 1. Lương\nLương trả\nhằng tháng\n\n1. Phụ cấp\n1.1. Ăn ca\n- mục a\n2. Thưởng\n500 đồng\nPhần II"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "source_id long, text string")
    blocks = documents.text_to_blocks(docs)
    rows = {r["order"]: r for r in documents.section_path(blocks).where("source_id = 1").collect()}
    assert [(r["block_type"], r["heading_level"]) for _, r in sorted(rows.items())] == [("heading", 1), ("heading", 4), ("paragraph", None), ("heading", 5), ("heading", 6), ("list_item", None), ("heading", 5), ("paragraph", None), ("heading", 1)]
    assert rows[2]["text"] == "Lương trả hằng tháng" and rows[5]["text"] == "mục a"
    assert rows[5]["section_path"] == ["Phần I. Chung", "Điều 1. Lương", "1. Phụ cấp", "1.1. Ăn ca"] and rows[6]["section_path"] == ["Phần I. Chung", "Điều 1. Lương"] and rows[8]["section_path"] == []
    assert documents.text_to_blocks(docs).where("source_id > 1").count() == 0


def test_chunks(spark):
    long = "word " * 500
    blocks = spark.createDataFrame([(1, 0, "heading", "H", "H"), (1, 1, "paragraph", "H", long.strip()), (1, 2, "paragraph", "H", "short"), (1, 3, "heading", "G", "G"), (1, 4, "paragraph", "G", "tail")], "source_id long, order int, block_type string, heading_path string, text string")
    parts = documents.split_oversized(blocks)
    assert all(len(r["text"]) <= 1000 for r in parts.collect()) and "".join(r["text"] for r in parts.where("order = 1").orderBy("part").collect()) == long.strip()
    chunks = documents.pack_chunks(parts).orderBy("chunk_no").collect()
    assert all(len(c["text"]) <= 1000 for c in chunks) and chunks[-1]["text"] == "G\ntail" and chunks[-1]["heading_path"] == "G"
    assert [c["first_order"] for c in chunks][0] == 0 and chunks[-2]["text"].endswith("short")
    cover = documents.chunk_coverage(documents.pack_chunks(parts), blocks).first()
    assert cover["covered"] == cover["total"] == 5


def plain_chunks(parts, merge, most=60, least=15):
    """(first order, last order, distinct orders, path, text) of one document's parts, by lists of texts."""
    chunks = []
    for p in parts:
        if chunks and p[2] != "heading" and len("\n".join(q[4] for q in chunks[-1])) + 1 + len(p[4]) <= most:
            chunks[-1].append(p)
        else:
            chunks.append([p])
    size = lambda c: len("\n".join(p[4] for p in c))
    fits = lambda a, b: a[0][3] == b[0][3] and size(a) + 1 + size(b) <= most
    if merge:
        back = []
        for c in chunks:
            if back and size(c) < least and fits(back[-1], c):
                back[-1] = back[-1] + c
            else:
                back.append(c)
        i = 0
        while i < len(back) - 1:
            if size(back[i]) < least and fits(back[i], back[i + 1]):
                back[i : i + 2] = [back[i] + back[i + 1]]
            else:
                i += 1
        chunks = back
    return [(n, c[0][0], c[-1][0], len({p[0] for p in c}), c[0][3], "\n".join(p[4] for p in c)) for n, c in enumerate(chunks)]


@pytest.mark.parametrize("merge", [True, False])
def test_chunks_of_many_documents_in_batches(spark, merge):
    """300 documents of odd parts equal plain packing; Python gets rows of batches, no group for each document."""
    rng = np.random.default_rng(11)
    documents_ = {}
    for source in range(300):
        parts, order = [], 0
        for _ in range(rng.integers(1, 25)):
            order += int(rng.integers(1, 3))
            kind = str(rng.choice(["heading", "paragraph", "list_item"], p=[0.2, 0.5, 0.3]))
            parts += [(order, n, kind, [None, "A", "B", "A > é"][rng.integers(4)], "đx é"[: rng.integers(1, 5)] * int(rng.integers(1, 15))) for n in range(rng.integers(1, 3))]
        documents_[source] = parts
    rows = [(source, *documents_[source][i]) for source in documents_ for i in rng.permutation(len(documents_[source])).tolist()]
    parts = spark.createDataFrame(rows, "source_id long, order int, part int, block_type string, heading_path string, text string")
    chunks = documents.pack_chunks(parts, 60, 15, merge)
    got = sorted((tuple(r) for r in chunks.collect()), key=lambda r: r[:2])
    assert got == [(source, *c) for source, p in documents_.items() for c in plain_chunks(p, merge)]
    assert "FlatMapGroupsInPandas" not in chunks._jdf.queryExecution().executedPlan().toString()


def test_versions(spark):
    t = "source_id long, section_no long, heading string, path string, text string"
    old = spark.createDataFrame([(1, 0, "A", "A", "one two three"), (1, 1, "B", "B", "pay is 450000 per month for all"), (1, 2, "C", "C", "gone entirely")], t)
    new = spark.createDataFrame([(1, 0, "A", "A", "one two three"), (1, 1, "B2", "B2", "pay is 500000 per month for all"), (1, 2, "D", "D", "###")], t)
    got = [(r["old_no"], r["new_no"], r["change"]) for r in documents.align_sections(old, new).collect()]
    assert got == [(0, 0, "UNCHANGED"), (1, 1, "MODIFIED"), (2, None, "REMOVED"), (None, 2, "ADDED")]
    assert matching.word_edits("pay 450 now", "pay 500 now") == [{"op": "equal", "old": "pay ", "new": "pay "}, {"op": "replace", "old": "450", "new": "500"}, {"op": "equal", "old": " now", "new": " now"}]
    assert matching.similarity("", "") == 1.0 and matching.similarity("ab", "ac") == 0.5


def test_grid(spark):
    cells = spark.createDataFrame([("s", 1, 2, "Cust"), ("s", 2, 2, "Chính thức"), ("s", 2, 3, "NOTE"), ("s", 3, 1, "Meal"), ("s", 3, 2, "450000"), ("s", 40, 1, "x")], "sheet string, row int, col int, value string")
    m = grid.unpivot_matrix(cells).collect()
    assert [(r["customer"], r["contract_type"], r["component"], r["cell"], r["value"], r["note_col"]) for r in m] == [("Cust", "Chính thức", "Meal", "B3", "450000", 3)]
    assert {r["row"]: r["table_no"] for r in grid.split_tables(cells).collect()} == {1: 0, 2: 0, 3: 0, 40: 1}
    assert [r["c"] for r in spark.createDataFrame([(1,), (26,), (27,), (52,), (53,), (702,)], "n int").select(grid.column_letters(F.col("n")).alias("c")).collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ"]


def test_controlled_update(spark):
    target = spark.createDataFrame([("s", "C3", "450000"), ("s", "D3", "1")], "sheet string, cell string, value string")
    ops = lambda before: spark.createDataFrame([(1, 9, "s", "C3", before, "500000"), (2, 9, "s", "D3", "1.0", "2")], "op_id long, changeset_id long, sheet string, cell string, before string, after string")
    assert {r["cell"]: r["value"] for r in changes.apply_ops(target, ops("450000")).collect()} == {"C3": "500000", "D3": "2"}
    assert {r["cell"]: r["value"] for r in changes.apply_ops(target, ops("475000")).collect()} == {"C3": "450000", "D3": "1"}
    assert {r["op_id"]: r["status"] for r in changes.preview_ops(ops("475000"), target).collect()} == {1: "CONFLICT", 2: "READY"}
    assert all(r["matches"] for r in changes.reconcile(changes.apply_ops(target, ops("450000")), ops("450000")).collect())


def test_overlap_ends(spark):
    p = spark.sql("select * from values (1,'a','X','active',date'2020-01-01',cast(null as date)),(2,'b','X','active',cast(null as date),date'2020-01-01'),(3,'c','X','active',date'2020-01-02',date'2020-06-01'),(4,'c','X','archived',null,null),(5,'d','Y','active',null,null) as t(policy_id,policy_key,category,status,effective_date,expiry_date)")
    got = {(r["policy_a"], r["policy_b"]): (str(r["overlap_start"]), str(r["overlap_end"])) for r in registry.overlaps(p).collect()}
    assert got == {(1, 2): ("2020-01-01", "2020-01-01"), (1, 3): ("2020-01-02", "2020-06-01")}


def test_lint(spark):
    v = spark.createDataFrame([(1, "a", "employee", "basic_salary")], "formula_id long, name string, source string, field_code string")
    r = spark.createDataFrame([(1, 0, "A", "B + a", None, None, None), (1, 1, "B", "A * 2", None, "round", None), (1, 2, "C", "a ** 2", None, "round_down_0", "x"), (1, 3, "D", "zz", None, None, None)], "formula_id long, place int, output_field string, expression string, condition string, rounding string, section string")
    got = {x["issue"] for x in formulas.lint_formulas(v, r, ("A", "B", "C")).collect()}
    assert got == {"circular: A", "circular: B", "forbidden: Pow", "invalid rounding: round_down_0", "invalid section: x", "unknown variable: zz", "not in catalog: D"}


@pytest.mark.parametrize("n", [7, 30])
def test_lint_long_chains(spark, n):
    """Long chains are legal; a cycle at the end of one is found, with what hangs on it."""
    rule = lambda f, i, reads: (f, i, f"R{i}", " + ".join(reads) or "1", None, None, None)
    rows = [rule(1, i, [f"R{i - 1}"] if i else []) for i in range(n)] + [rule(2, i, [f"R{i - 1}"] if i else [f"R{n - 1}"]) for i in range(n)] + [rule(3, 0, ["R1"]), rule(3, 1, ["R0"]), rule(3, 2, ["R1"]), rule(3, 3, [])]
    rules = spark.createDataFrame(rows, "formula_id long, place int, output_field string, expression string, condition string, rounding string, section string")
    variables = spark.createDataFrame([], "formula_id long, name string, source string, field_code string")
    got = {(r["formula_id"], r["issue"]) for r in formulas.lint_formulas(variables, rules, tuple(f"R{i}" for i in range(n))).collect()}
    assert got == {(2, f"circular: R{i}") for i in range(n)} | {(3, f"circular: R{i}") for i in range(3)}


def test_lint_sections_and_inputs(spark):
    rules = spark.createDataFrame([(1, 0, "A", "1", "BASIC"), (1, 1, "B", "1", "PIT"), (1, 2, "B", "None", None), (2, 0, "A", "1", "BASIC")], "formula_id long, place int, output_field string, expression string, category string").selectExpr("*", "cast(null as string) condition", "cast(null as string) rounding", "cast(null as string) section")
    variables = spark.createDataFrame([(1, "s", "attendance", "shift_type"), (9, "x", "literal", None)], "formula_id long, name string, source string, field_code string")
    sections = spark.createDataFrame([(1, "A", "deductions"), (1, "B", "line_items"), (1, "Z", "line_items"), (2, "A", "line_items")], "formula_id long, code string, section string")
    got = {(r["formula_id"], r["place"], r["issue"]) for r in formulas.lint_formulas(variables, rules, ("A", "B"), sections).collect()}
    assert got == {(1, -1, "overtime attribute as input: shift_type"), (1, -1, "duplicate output: B"), (1, 2, "forbidden: Constant"), (9, -1, "no rules"), (1, -1, "inconsistent with BASIC: A=deductions"), (1, -1, "inconsistent with PIT: B=line_items"), (1, -1, "invalid field category: Z=line_items"), (2, -1, "warning: income without deductions")}


def test_vector_topk_slices_and_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (60, 5)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0])]
    vectors = spark.createDataFrame(rows, "chunk long, vec array<double>")
    queries = vectors.where("chunk % 3 = 0").withColumnRenamed("chunk", "query")
    want = {(q, r + 1, int(c)) for q in range(0, 60, 3) for r, c in enumerate(np.lexsort((np.arange(60), -(x @ x[q])))[:5])}
    for size in (7, 1000):
        got = {(r["query"], r["rank"], r["chunk"]) for r in retrieval.vector_topk(vectors, queries, slice_rows=size, block=size).collect()}
        assert got == want


def test_vector_topk_of_copies_and_of_nan(spark):
    """As many queries as vectors in tiles: many equal vectors, and vectors whose scores are NaN."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-3, 4, (400, 5)), np.full((400, 5), 3)]).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [float("nan")] * 5)]
    vectors = spark.createDataFrame(rows, "chunk long, vec array<float>")
    queries = vectors.withColumnRenamed("chunk", "query")
    want = {(q, r + 1, int(c)) for q in range(800) for r, c in enumerate(np.lexsort((np.arange(800), -(x @ x[q])))[:5])}
    for size in (100, 1000):
        assert {(r["query"], r["rank"], r["chunk"]) for r in retrieval.vector_topk(vectors, queries, slice_rows=size, tile=300).collect()} == want


def test_best_of_many_copies_are_few():
    """A thousand copies of one vector give each query a few rows, those of the smallest ids."""
    import pandas as pd

    vec = [np.array([0.1, 0.2, 0.7])] * 1000 + [np.array([0.1, 0.2, 0.6])] * 200
    rows = pd.DataFrame({"chunk": np.arange(1200)[::-1], "vec": vec})
    got = retrieval._best(rows.rename(columns={"chunk": "query"}), rows, 5, "dot")
    assert len(got) <= 30 * 1200
    top = got.assign(score=got["score"].round(9)).sort_values(["query", "score", "chunk"], ascending=[True, False, True]).groupby("query").head(5)
    assert len(top) == 6000 and set(top["chunk"]) == set(range(200, 205))


def test_publish_gate_of_clean_groups(spark):
    flags = spark.createDataFrame([("1", "p", "A"), ("2", "p", "B")], "employee_id string, period string, code string")
    everyone = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "p")], "employee_id string, period string")
    got = {tuple(r) for r in payroll.publish_gate(flags, flags.where("code = 'A'"), everyone, "employee_id").collect()}
    assert got == {("1", 0, True), ("2", 1, False), ("3", 0, True)}
    assert tuple(payroll.publish_gate(flags, flags, everyone).first()) == (0, True)


def test_loop_guard(spark):
    t = "run_id string, turn long, action_hash string, observation_hash string, progress boolean"
    log = spark.createDataFrame([("a", 1, "x", "1", True), ("a", 2, "x", "2", True), ("b", 1, "p", "o", True), ("b", 2, "q", "n", True), ("b", 3, "p", "o", True), ("b", 4, "q", "o", True), ("c", 1, "p", "1", False), ("c", 2, "q", "2", False), ("c", 3, "p", "3", False), ("d", 1, "p", "1", False), ("d", 2, "q", "2", True)], t)
    assert {(r["run_id"], r["turn"], r["reason"]) for r in logs.loop_guard(log).collect()} == {("a", 2, "same_action"), ("b", 4, "same_observation"), ("c", 3, "no_progress")}


def test_token_summary(spark):
    u = spark.createDataFrame([("m", "plan", 10, 5, 15, 0, 1.0, 100), ("m", "react", 20, 7, 27, 1, 2.0, None)], "model string, phase string, input_tokens long, output_tokens long, total_tokens long, tool_calls long, cost double, latency_ms long")
    r = logs.token_summary(u, "model").first()
    assert (r["calls"], r["total_tokens"], r["avg_latency_ms"]) == (2, 42, 100.0) and logs.token_summary(u, "model", "phase", cube=True).count() == 6


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "d")], "chunk long, text string")
    got = retrieval.bm25_topk(chunks, spark.createDataFrame([(1, "C unknown"), (2, "zzz")], "query long, text string")).collect()
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert [(r["query"], r["chunk"]) for r in got] == [(1, 2)] and got[0]["score"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))


def test_budget_and_citations(spark):
    scored = spark.createDataFrame([("q", 1, 9.0, 900), ("q", 2, 8.0, 200), ("q", 3, 7.0, 50)], "query string, chunk long, score double, size long")
    assert [r["chunk"] for r in retrieval.budgeted_topk(scored, budget=960).collect()] == [1, 3]
    cites = spark.createDataFrame([("e1", "pay 500"), ("e1", "pay 501"), ("e1", None), ("e2", "x"), ("e1", "completely other words")], "evidence_id string, quote string")
    ev = spark.createDataFrame([("e1", "We  Pay 500 now")], "evidence_id string, text string")
    assert sorted(str(r["issue"]) for r in retrieval.citation_check(cites, ev).collect()) == ["NUMBER_MISMATCH", "None", "None", "QUOTE_NOT_FOUND", "UNKNOWN_EVIDENCE_ID"]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2024-01", 2.5), ("2", "2024-02", None)], "employee_id string, period string, amount double")
    io.write_report(rows, f"file://{tmp_path}/csv")
    assert io.read_inputs(spark, f"file://{tmp_path}/csv", "csv", rows.schema.simpleString()[7:-1].replace(":", " ")).collect() == rows.collect()
    for form in ("parquet", "orc", "json"):
        rows.write.format(form).save(f"file://{tmp_path}/{form}")
        got = io.read_inputs(spark, f"file://{tmp_path}/{form}", form, "employee_id string, period string, amount double")
        assert sorted(got.collect()) == sorted(rows.collect())
    io.write_payslips(rows, f"file://{tmp_path}/slips")
    assert (tmp_path / "slips" / "period=2024-01").exists() and spark.read.parquet(f"file://{tmp_path}/slips").count() == 2
    for _ in range(2):
        io.append_audit(io.audit_rows(rows, "e", "me", F.lit("t"), "amount"), f"file://{tmp_path}/audit")
    assert spark.read.text(f"file://{tmp_path}/audit").count() == 4
    with pytest.raises(ValueError):
        io.read_inputs(spark, "x", "json")


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(value):
    return "~" if value is None or value != value else f"{float(value):.6g}" if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


SAMPLE = ["a3_dedupe_headers", "a16_contract_header", "a21_read_inputs", "c4_map_columns", "d10_fabricated", "d14_apply", "d15_restore", "d17_dependents", "j4_stream_audit", "a22_id_column", "c3_suggest_code", "c17_infer_ot", "c25_prepare", "c26_access_meta", "c27_extract_json", "c28_type_changes", "f4_gate", "f10_coverage", "i3_vector_topk", "i5_search", "i6_phrase_score", "i7_budget", "i9_metadata", "i10_point_id", "i11_diff_evidence", "j3_stream_dedup", "c2_canonical", "c9_arith", "c15_tax", "d2_rate_lookup", "e1_run_rules", "f3_anomaly", "b1_payroll_report", "a11_labels", "a20_section_path", "c19_clean_rules", "h1_split", "h2_pack", "h3_merge", "h8_section_changes", "d8_overlaps", "g5_transitions", "g7_loop_guard", "i2_bm25", "j1_stream_meter"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf_dir, oracle, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = oracle.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(shown, r)) for r in want.fetchall()) == sorted(tuple(shown(r[c]) for c in names) for r in df.collect())


def test_fused_lists_of_every_vector(spark, sf_dir, oracle):
    """No vector is left out as a query: a text's list is fused with that of the vector of its number."""
    got = catalog.QUERIES["i4_rrf"](spark, sf_dir).collect()
    assert {r["query"] for r in got} == {q for (q,) in oracle.execute("SELECT vec_id FROM embeddings UNION SELECT item_id FROM benchmark").fetchall()}
    assert sorted(tuple(map(shown, r)) for r in oracle.execute(catalog.ORACLES["i4_rrf"]).fetchall()) == sorted(tuple(map(shown, r)) for r in got)


def test_every_query_is_paired_or_listed():
    without = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert without == {"e5_lint", "h7_align", "h9_word_diff", "h10_similarity", "d16_citation"}


DEEP = ["a20_section_path", "f9_diff_summary", "h1_split", "h2_pack", "h3_merge", "h4_context", "h6_sections", "h8_section_changes"]


@pytest.mark.parametrize("name", DEEP)
def test_deep_headings_against_sql(spark, tmp_path, name):
    """Numbers of three and more segments, an address among them, open and close levels in the SQL too."""
    texts = ["56.187.231.175 Keit in lich\nauf\n1.2.3 x\n4. y\nz\n1.1 a\n\nb\n2.1.1.1.1.1.1 deep\nc\n1.1.2 d\ne\nf", "1.2.3.4 one\ntwo\n\n1.2.3.4 one\n" + "long word " * 150 + "\n2.1 x\ny\n3.1.1 z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    rows = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    assert rows and rows == sorted(tuple(map(shown, r)) for r in want.fetchall())
