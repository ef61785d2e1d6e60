"""Queries A1 to A23: sheets, headers, tables, matrices, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import grid as G
from ledgerline.operators import ingest as I  # noqa: E741
from ledgerline.plans.base import query, table, values
from ledgerline.plans.scalar_queries import _CODE_PARTS, _CODE_SQL, HEADS, LABEL, headers
from ledgerline.sources.io import read_checked, shared_folder

HEAD = [(1, 1, "Code"), (1, 2, "Name"), (1, 3, "Balance"), (1, 5, "Name"), (2, 4, "Note"), (2, 6, "Extra")]
_BODY = "SELECT p_brand AS sheet, CAST(p_partkey + 3 AS INT) AS row, 1 AS col, CAST(p_partkey AS VARCHAR) AS value FROM part UNION ALL SELECT p_brand, CAST(p_partkey + 3 AS INT), 2, p_name FROM part UNION ALL SELECT p_brand, CAST(p_partkey + 3 AS INT), 3, CASE WHEN p_size % 4 = 0 THEN '  ' ELSE CAST(p_size AS VARCHAR) END FROM part UNION ALL SELECT p_brand, CAST(p_partkey + 3 AS INT), 4, p_type FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_brand, CAST(p_partkey + 3 AS INT), 5, p_name FROM part"
CELLS = f"cells AS ({_BODY} UNION ALL SELECT DISTINCT p_brand, r, c, v FROM part, {values(HEAD, 'r', 'c', 'v')})"
FILLED = CELLS + ", full_ AS (SELECT sheet, row, col, trim(value) AS v FROM cells WHERE trim(value) <> ''), ext AS (SELECT sheet, max(row) AS last_row, max(col) AS last_col FROM full_ GROUP BY sheet)"
SCORES = FILLED + ", scores AS (SELECT sheet, row, CASE WHEN count(*) < 2 THEN 0 ELSE round(count(*) / any_value(last_col) * 0.3::DOUBLE + count(*) FILTER (WHERE NOT regexp_full_match(replace(v, '.', ''), '[0-9]+')) / count(*) * 0.5::DOUBLE + count(DISTINCT v) / count(*) * 0.2::DOUBLE, 9) END AS score FROM full_ JOIN ext USING (sheet) GROUP BY sheet, row)"
_LETTER = "chr(CAST(64 + col AS INTEGER))"
LABELS = SCORES + f", lab0 AS (SELECT e.sheet, e.col, coalesce((SELECT string_agg(v, ' ' ORDER BY row) FROM full_ f WHERE f.sheet = e.sheet AND f.col = e.col AND f.row <= 2), 'Col' || {_LETTER.replace('col', 'e.col')}) AS label FROM (SELECT sheet, unnest(range(1, last_col + 1)) AS col FROM ext) e), labels AS (SELECT sheet, col, CASE WHEN n > 1 THEN label || ' (' || n || ')' ELSE label END AS label FROM (SELECT *, row_number() OVER (PARTITION BY sheet, label ORDER BY col) AS n FROM lab0))"


def cells(spark, d):
    p = table(spark, d, "part")
    cell = lambda col, v: F.struct(F.lit(col).alias("col"), v.alias("value"))
    body = F.array_compact(F.array(cell(1, F.col("p_partkey").cast("string")), cell(2, F.col("p_name")), cell(3, F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.col("p_size").cast("string"))), F.when(F.col("p_size") % 3 == 0, cell(4, F.col("p_type"))), cell(5, F.col("p_name"))))
    rows = p.select(F.col("p_brand").alias("sheet"), (F.col("p_partkey") + 3).cast("int").alias("row"), F.inline(body))
    head = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in HEAD])
    return rows.unionByName(p.select(F.col("p_brand").alias("sheet")).distinct().select("sheet", F.inline(head)))


@query("a1_promote_header", 'SELECT CAST(c_custkey AS BIGINT) AS row_no, c_name AS "Customer#000000003", c_mktsegment AS segment FROM customer WHERE c_custkey > 3 + 2')
def a1(spark, d):
    grid = table(spark, d, "customer").select(F.col("c_custkey").alias("row_no"), F.col("c_name").alias("c1"), F.col("c_mktsegment").alias("c2"))
    out = I.promote_header(grid, 3, 7)
    return out.toDF("row_no", "Customer#000000003", "segment")


@query("a2_combine_headers", FILLED.replace("cells AS", "WITH cells AS", 1) + " SELECT sheet, col, coalesce(string_agg(v, ' | ' ORDER BY row), 'Column_' || col) AS label FROM full_ WHERE row <= 2 GROUP BY sheet, col")
def a2(spark, d):
    return I.combine_headers(cells(spark, d).where("row <= 2"))


@query("a3_dedupe_headers", f"WITH {HEADS}, l AS (SELECT CAST(p_partkey // 22 AS VARCHAR) AS sheet, p_partkey % 22 AS col, substr(header, 1, 5) AS label FROM heads) SELECT sheet, col, CASE WHEN n > 1 THEN label || '__' || n ELSE label END AS label FROM (SELECT *, row_number() OVER (PARTITION BY sheet, label ORDER BY col) AS n FROM l)")
def a3(spark, d):
    return I.dedupe_labels(sheet_headers(spark, d).withColumn("label", F.substring("label", 1, 5)))


def sheet_headers(spark, d):
    """Header rows of 22 columns."""
    return headers(spark, d).select(F.expr("cast(p_partkey div 22 as string)").alias("sheet"), (F.col("p_partkey") % 22).alias("col"), F.col("header").alias("label"))


@query("a4_drop_blank", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS b FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def a4(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("b"))
    return I.drop_blank_rows(o, ["a", "b"])


@query("a5_row_selector", "SELECT c_custkey, c_mktsegment, 'equals' AS rule FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, c_mktsegment, 'in' FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') UNION ALL SELECT c_custkey, c_mktsegment, 'not_empty' FROM customer WHERE c_custkey % 9 > 0")
def a5(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit(" "), F.initcap("c_mktsegment"), F.lit(" ")).alias("kind"), F.when(F.col("c_custkey") % 9 == 0, " ").otherwise("x").alias("mark"))
    parts = (("equals", I.select_rows(c, "kind", equals="building ")), ("in", I.select_rows(c, "kind", among=["Machinery", " household"])), ("not_empty", I.select_rows(c, "mark", not_empty=True)))
    out = None
    for name, rows in parts:
        rows = rows.select("c_custkey", "c_mktsegment", F.lit(name).alias("rule"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a6_used_extent", f"WITH {FILLED} SELECT sheet, last_row, last_col FROM ext")
def a6(spark, d):
    return G.used_extent(cells(spark, d))


@query("a7_fill_merged", f"WITH {CELLS} SELECT sheet, row, col, CASE WHEN row > 2 AND row % 10 = 0 AND col = 3 AND trim(value) = '' THEN CAST(row - 3 AS VARCHAR) ELSE value END AS value FROM cells UNION ALL SELECT DISTINCT p_brand, 1, 4, 'Balance' FROM part")
def a7(spark, d):
    c = cells(spark, d)
    sheets = c.select("sheet").distinct().select("sheet", F.lit(1).alias("min_row"), F.lit(1).alias("max_row"), F.lit(3).alias("min_col"), F.lit(4).alias("max_col"))
    rows = c.where("row > 2 and row % 10 = 0 and col = 1").select("sheet", F.col("row").alias("min_row"), F.col("row").alias("max_row"), F.lit(1).alias("min_col"), F.lit(3).alias("max_col"))
    return G.fill_merged(c, sheets.unionByName(rows))


@query("a8_header_score", f"WITH {SCORES} SELECT sheet, row, score FROM scores")
def a8(spark, d):
    return G.score_header_rows(cells(spark, d))


@query("a9_detect_header", f"WITH {SCORES} SELECT sheet, 1 AS header_row, 2 AS span, max(score) AS score FROM scores WHERE row = 1 GROUP BY sheet")
def a9(spark, d):
    return G.detect_header(cells(spark, d))


@query("a10_split_tables", f"WITH {FILLED}, r AS (SELECT DISTINCT sheet, row FROM full_), g AS (SELECT *, coalesce(row - lag(row) OVER (PARTITION BY sheet ORDER BY row) > 30, false) AS new FROM r) SELECT sheet, row, CAST(sum(CAST(new AS INTEGER)) OVER (PARTITION BY sheet ORDER BY row) AS BIGINT) AS table_no FROM g")
def a10(spark, d):
    return G.split_tables(cells(spark, d))


@query("a11_labels", f"WITH {LABELS} SELECT sheet, col, label FROM labels")
def a11(spark, d):
    c = cells(spark, d)
    return G.build_labels(c, G.detect_header(c))


@query("a12_rows_to_text", f"WITH {LABELS} SELECT sheet, row, string_agg(label || ': ' || v, ' | ' ORDER BY col) AS text FROM full_ JOIN labels USING (sheet, col) WHERE row > 2 GROUP BY sheet, row")
def a12(spark, d):
    c = cells(spark, d)
    head = G.detect_header(c)
    return G.rows_to_text(c, head, G.build_labels(c, head))


@query("a13_freeform", "SELECT CAST(s_nationkey AS VARCHAR) AS sheet, CAST(s_suppkey AS INTEGER) AS row, s_name || ' | ' || s_nationkey AS text FROM supplier WHERE s_nationkey % 2 = 1")
def a13(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("sheet"), F.col("s_suppkey").cast("int").alias("row"), F.posexplode(F.array("s_name", F.lit(" "), F.col("s_nationkey").cast("string"))).alias("col", "value"))
    even = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("sheet"))
    return G.freeform_rows(s, even)


MHEAD = [(1, 2, "Cust A"), (1, 4, "Cust B"), (2, 2, "Chính thức"), (2, 3, "NOTE"), (2, 4, "Thời vụ"), (2, 5, "Chính thức")]
MATRIX = "m AS (SELECT CAST(s_nationkey AS VARCHAR) AS sheet, c.customer, c.contract_type, s_name AS component, c.letter || (s_suppkey + 3) AS cell, CASE c.col WHEN 2 THEN CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) WHEN 4 THEN '=B' || (s_suppkey + 3) || '*2' ELSE CAST(s_suppkey % 7 AS VARCHAR) END AS value, c.col = 4 AS is_formula, CASE WHEN c.col = 2 THEN 3 END AS note_col FROM supplier, " + values([(2, "B", "Cust A", "Chính thức"), (4, "D", "Cust B", "Thời vụ"), (5, "E", "Cust B", "Chính thức")], "col", "letter", "customer", "contract_type") + " c)"


def matrix(spark, d):
    s = table(spark, d, "supplier")
    row = (F.col("s_suppkey") + 3).cast("int")
    cell = lambda col, v: F.struct(F.lit(col).alias("col"), v.alias("value"))
    body = F.array(cell(1, F.col("s_name")), cell(2, F.floor("s_acctbal").cast("string")), cell(3, F.lit("by month")), cell(4, F.concat(F.lit("=B"), row.cast("string"), F.lit("*2"))), cell(5, (F.col("s_suppkey") % 7).cast("string")))
    rows = s.select(F.col("s_nationkey").cast("string").alias("sheet"), row.alias("row"), F.inline(body))
    head = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in MHEAD])
    return rows.unionByName(s.select(F.col("s_nationkey").cast("string").alias("sheet")).distinct().select("sheet", F.inline(head)))


@query("a15_matrix", f"WITH {MATRIX} SELECT * FROM m")
def a15(spark, d):
    return G.unpivot_matrix(matrix(spark, d))


@query("a16_contract_header", """WITH c AS (SELECT CAST(s_nationkey AS VARCHAR) AS sheet, CAST(s_suppkey % 15 + 1 AS INT) AS r, CASE s_suppkey * 7 % 11 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS points FROM supplier),
s AS (SELECT sheet, r, CAST(sum(points) AS BIGINT) AS score FROM c WHERE r <= 12 GROUP BY ALL HAVING sum(points) > 0) SELECT sheet, r AS header_row, score FROM s QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY score DESC, r) = 1""")
def a16(spark, d):
    """A cell for each supplier: notes and contract labels stand in rows 1 to 15, of which the first 12 are searched."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey") * 7 % 11
    value = F.when(k == 0, "NOTE").when(k == 1, " note ").when(k == 2, "Thời vụ").when(k == 3, "HĐ chính thức").when(k == 4, "CHÍNH  THỨC").otherwise(F.col("s_name"))
    return G.contract_header(s.select(F.col("s_nationkey").cast("string").alias("sheet"), (F.col("s_suppkey") % 15 + 1).cast("int").alias("row"), F.col("s_suppkey").cast("int").alias("col"), value.alias("value")))


@query("a17_matrix_lookup", "SELECT CAST(s_nationkey AS VARCHAR) AS sheet, 'cust  a' AS customer, 'CHÍNH THỨC' AS contract_type, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE lower(s_name) END AS component, CASE WHEN s_suppkey % 3 = 0 THEN 'NOT_FOUND' ELSE 'FOUND' END AS status, CASE WHEN s_suppkey % 3 > 0 THEN 'B' || (s_suppkey + 3) END AS cell FROM supplier")
def a17(spark, d):
    keys = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("sheet"), F.lit("cust  a").alias("customer"), F.lit("CHÍNH THỨC").alias("contract_type"), F.when(F.col("s_suppkey") % 3 == 0, "unknown").otherwise(F.lower("s_name")).alias("component"))
    return G.lookup_matrix(G.unpivot_matrix(matrix(spark, d)), keys)


ID_LABELS = ("Full name", "Employee code", "Mã NV", "x", "Employee ID (old)")


@query("a22_id_column", "SELECT CAST(p_partkey AS VARCHAR) AS sheet, CASE p_size % 3 WHEN 0 THEN 'Employee code' WHEN 1 THEN 'Mã NV' ELSE 'Employee ID (old)' END AS id_column FROM part")
def a22(spark, d):
    """A sheet for each part, with its type among the labels."""
    labels = table(spark, d, "part").select("p_partkey", "p_size", F.posexplode(F.array(F.lit(ID_LABELS[0]), F.col("p_type"), *map(F.lit, ID_LABELS[1:]))).alias("col", "label"))
    kept = labels.where(~((F.col("p_size") % 3 > 0) & (F.col("col") == 2)) & ~((F.col("p_size") % 3 == 2) & (F.col("col") == 3)))
    return I.id_column(kept.select(F.col("p_partkey").cast("string").alias("sheet"), "col", "label"))


@query("a23_usable_text", r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 24 AND length(text) - length(replace(text, '�', '')) <= 0.02 * length(text) AS usable FROM documents")
def a23(spark, d):
    return table(spark, d, "documents").select("doc_id", I.usable_text(F.col("text")).alias("usable"))


NEEDED = ("basic_salary", "standard_working_days", "total_working_days", "salary_ot_night_holiday_300", "meal_allowance", "iban")


@query("c4_map_columns", f"""WITH RECURSIVE {_CODE_PARTS}, coded AS ({_CODE_SQL}), sh AS (SELECT p_partkey // 22 AS sheet, list({{'col': p_partkey % 22, 'label': header, 'name': l, 'code': code}} ORDER BY p_partkey % 22) AS ls FROM coded JOIN l USING (p_partkey) JOIN heads USING (p_partkey) GROUP BY ALL),
w AS (SELECT sheet, ls, 0 AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS VARCHAR) AS label FROM sh UNION ALL SELECT sheet, ls, n + 1, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.col) END, b.label
 FROM (SELECT *, list_sort(list_transform(list_filter(ls, lambda x: NOT list_contains(used, x.col) AND (x.code = req[n + 1] OR x.name = req[n + 1])), lambda x: {{'late': x.code <> req[n + 1], 'col': x.col, 'label': x.label}}))[1] AS b FROM (SELECT *, {sorted(NEEDED)!r} AS req FROM w WHERE n < {len(NEEDED)})))
SELECT CAST(sheet AS VARCHAR) AS sheet, {sorted(NEEDED)!r}[n] AS field_code, label FROM w WHERE n > 0""")
def c4(spark, d):
    """Header rows against the codes of formulas."""
    h = sheet_headers(spark, d)
    need = h.select("sheet").distinct().select("sheet", F.explode(F.array(*map(F.lit, NEEDED))).alias("field_code"))
    return I.map_columns(h, need, None)


@query("a21_read_inputs", """SELECT 'json' AS format, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey END AS id, CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 7 > 0 THEN round(s_acctbal, 2) END AS balance, CASE WHEN s_suppkey % 7 = 0 THEN '{"id":' || s_suppkey END AS corrupt FROM supplier
UNION ALL SELECT 'csv', CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey END, CASE WHEN s_suppkey % 5 > 0 THEN s_name END, CASE WHEN s_suppkey % 5 > 0 THEN round(s_acctbal, 2) END, CASE WHEN s_suppkey % 5 = 0 THEN 'n' || s_suppkey || ',x' END FROM supplier""")
def a21(spark, d):
    """Suppliers written as JSON and as CSV lines, some of them broken, and read again."""
    s, schema, out = table(spark, d, "supplier"), "id bigint, name string, balance double", None
    k, balance = F.col("s_suppkey"), F.round("s_acctbal", 2)
    told = F.to_json(F.struct(k.alias("id"), F.col("s_name").alias("name"), balance.alias("balance")))
    lines = {
        "json": F.when(k % 7 > 0, told).otherwise(F.concat(F.lit('{"id":'), k.cast("string"))),
        "csv": F.when(k % 5 > 0, F.concat_ws(",", k.cast("string"), "s_name", balance.cast("string"))).otherwise(F.concat(F.lit("n"), k.cast("string"), F.lit(",x"))),
    }
    for kind, line in lines.items():
        path = shared_folder(spark, kind)
        s.select(line.alias("value")).write.text(path)
        rows = read_checked(spark, path, schema, kind).select(F.lit(kind).alias("format"), "id", "name", "balance", "corrupt")
        out = rows if out is None else out.unionByName(rows)
    return out
