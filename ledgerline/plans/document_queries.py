"""Queries A18 to A20, H1 to H10, G9, F9, F10, F17: texts, chunks, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import documents as D
from ledgerline.plans.base import query, table

_LINES = r"""d AS (SELECT doc_id AS source_id, string_split(text, chr(10)) AS ls FROM documents), l0 AS (SELECT source_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM d),
l1 AS (SELECT source_id, line_no, trim(CASE WHEN line_no % 4 = 0 THEN CASE WHEN line_no % 8 = 0 THEN (line_no // 8) || '.' || (line_no % 3) || '. ' ELSE line_no || '. ' END || line WHEN line_no % 7 = 0 THEN '- ' || line ELSE line END@ALTERED) AS line FROM l0@KEPT)"""
_H = r"regexp_matches(line, '(?i)^\d{1,3}((\.\d{1,3}){1,6}\.?|\.)\s+\S') AND NOT regexp_matches(line, '(?i)^\d{1,3}((\.\d{1,3}){1,6}\.?|\.)\s+(đ|đồng|vnd|usd)(\s|$)')"
_TEMPLATE = f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN {_H} THEN 'heading' WHEN regexp_matches(line, '^(\\d+[.)]|[a-z][.)]|[-•*])\\s+\\S') THEN 'list_item' ELSE 'paragraph' END AS kind FROM l1),
s AS (SELECT *, kind <> 'paragraph' OR coalesce(lag(kind) OVER w, '') <> 'paragraph' AS st FROM k WINDOW w AS (PARTITION BY source_id ORDER BY line_no)),
i AS (SELECT *, sum(CAST(st AS INTEGER)) OVER (PARTITION BY source_id ORDER BY line_no) AS isl FROM s),
m AS (SELECT source_id, isl, min(line_no) AS line_start, max(line_no) AS line_end, any_value(kind) AS block_type, string_agg(line, ' ' ORDER BY line_no) AS t FROM i WHERE kind <> 'blank' GROUP BY source_id, isl),
b AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY line_start) - 1 AS INTEGER) AS "order", block_type, CASE WHEN block_type = 'heading' THEN 4 + len(string_split(regexp_extract(t, '^([\\d.]*\\d)', 1), '.')) END AS heading_level, line_start, line_end, CASE WHEN block_type = 'list_item' THEN regexp_replace(t, '^(\\d+[.)]|[a-z][.)]|[-•*])\\s+', '') ELSE t END AS text FROM m)"""


def _blocks(version: int = 1) -> str:
    """The CTE chain from lines to blocks; version 2 drops and alters lines."""
    altered, kept = ("", "") if version == 1 else (" || CASE WHEN line_no % 7 = 0 THEN ' changed' ELSE '' END", " WHERE line_no % 11 <> 0")
    return _TEMPLATE.replace("@ALTERED", altered).replace("@KEPT", kept)


_BLOCKS = _blocks()
#: Levels that a numbered heading can have: 4 and its 1 to 7 segments.
_DEPTHS = range(5, 12)
_OPEN = "o5 AS (SELECT *, " + ", ".join(f'last_value(CASE WHEN heading_level = {k} THEN "order" END IGNORE NULLS) OVER w AS p{k}, last_value(CASE WHEN heading_level = {k} THEN text END IGNORE NULLS) OVER w AS t{k}' for k in _DEPTHS) + ' FROM b WINDOW w AS (PARTITION BY source_id ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND {} ))'


def _opened(level: int, more: str = "") -> str:
    """Text of the heading of a level that no heading of a level above has closed."""
    after = "".join(f" AND p{level} > coalesce(p{k}, -1)" for k in _DEPTHS if k < level)
    return f"CASE WHEN p{level} IS NOT NULL{after}{more} THEN t{level} END"


def _path(sep: str, above: bool = False) -> str:
    """All open headings joined; with ``above`` only those that a heading's own level leaves open."""
    names = ", ".join(_opened(k, f" AND coalesce(heading_level, 99) > {k}" if above else "") for k in _DEPTHS)
    return f"array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), '{sep}')"


def sources(spark, d, version: int = 1):
    """Documents with numbered headings and list items; version 2 drops and alters lines."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.split("text", "\n", -1).alias("ls"))

    def line(x, i):
        n = i + 1
        number = F.when(n % 8 == 0, F.concat((n / 8).cast("int").cast("string"), F.lit("."), (n % 3).cast("string"), F.lit(". "))).otherwise(F.concat(n.cast("string"), F.lit(". ")))
        marked = F.when(n % 4 == 0, F.concat(number, x)).when(n % 7 == 0, F.concat(F.lit("- "), x)).otherwise(x)
        if version == 1:
            return marked
        return F.when(n % 11 == 0, None).when(n % 7 == 0, F.concat(marked, F.lit(" changed"))).otherwise(marked)

    return docs.select("source_id", F.array_join(F.transform("ls", line), "\n").alias("text"))


def blocks(spark, d, version: int = 1):
    return D.text_to_blocks(sources(spark, d, version))


@query("a18_blocks", _BLOCKS + ' SELECT source_id, "order", block_type, line_start, line_end, text FROM b')
def a18(spark, d):
    return blocks(spark, d).drop("heading_level")


@query("a19_heading_level", _BLOCKS + """ SELECT source_id, "order", CAST(heading_level AS INTEGER) AS level FROM b WHERE block_type = 'heading' UNION ALL SELECT p_partkey, 0, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END FROM part""")
def a19(spark, d):
    k = F.col("p_partkey") % 5
    named = F.when(k == 0, "PHẦN II. Chung").when(k == 1, "Chương 3").when(k == 2, "mục IV điều kiện").when(k == 3, "điều 12 Lương").otherwise("Quy định")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.lit(0).alias("order"), D.heading_level(named).alias("level"))
    return blocks(spark, d).where("block_type = 'heading'").select("source_id", "order", F.col("heading_level").alias("level")).unionByName(parts)


@query("a20_section_path", _BLOCKS + ", " + _OPEN.format("1 PRECEDING") + f' SELECT source_id, "order", {_path(" / ", above=True)} AS path FROM o5')
def a20(spark, d):
    return D.section_path(blocks(spark, d)).select("source_id", "order", F.array_join("section_path", " / ").alias("path"))


@query("h4_context", _BLOCKS + ", " + _OPEN.format("CURRENT ROW") + f' SELECT source_id, "order", {_opened(5)} AS h2, {_opened(6)} AS h3, {_path(" > ")} AS heading_path FROM o5')
def h4(spark, d):
    return D.heading_context(blocks(spark, d)).select("source_id", "order", "h2", "h3", "heading_path")


_SECTIONS = ", " + _OPEN.format("CURRENT ROW") + f""", n AS (SELECT *, CAST(sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY "order") AS BIGINT) AS section_no, {_path(" > ")} AS hp FROM o5),
sec AS (SELECT source_id, section_no, coalesce(max(CASE WHEN block_type = 'heading' THEN text END), '') AS heading, coalesce(max(CASE WHEN block_type = 'heading' THEN hp END), '') AS path, coalesce(string_agg(CASE WHEN block_type <> 'heading' THEN text END, chr(10) ORDER BY "order"), '') AS text FROM n GROUP BY source_id, section_no)"""


@query("h6_sections", _BLOCKS + _SECTIONS + " SELECT * FROM sec")
def h6(spark, d):
    return D.build_sections(blocks(spark, d))


def versions(spark, d):
    return D.build_sections(blocks(spark, d)), D.build_sections(blocks(spark, d, 2))


def _two(sql: str = "") -> str:
    """The section CTEs of both versions as va and vb."""
    keyed = "SELECT *, regexp_replace(lower(trim(path)), '\\s+', ' ', 'g') AS key FROM sec"
    return f"WITH va AS ({_blocks() + _SECTIONS} {keyed}), vb AS ({_blocks(2) + _SECTIONS} {keyed}) {sql}"


_CHANGES = "ua AS (SELECT source_id, key, max(text) AS old FROM va GROUP BY ALL HAVING count(*) = 1), ub AS (SELECT source_id, key, max(text) AS new FROM vb GROUP BY ALL HAVING count(*) = 1), ch AS (SELECT source_id, key AS path, CASE WHEN old IS NULL THEN 'ADDED' WHEN new IS NULL THEN 'REMOVED' WHEN old = new THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change FROM ua FULL OUTER JOIN ub USING (source_id, key))"


@query("h8_section_changes", _two().rstrip() + ", " + _CHANGES + " SELECT * FROM ch")
def h8(spark, d):
    return D.section_changes(*versions(spark, d))


@query("f9_diff_summary", _two().rstrip() + ", " + _CHANGES + " SELECT source_id, count(*) FILTER (WHERE change = 'ADDED') AS added, count(*) FILTER (WHERE change = 'REMOVED') AS removed, count(*) FILTER (WHERE change = 'MODIFIED') AS modified, count(*) FILTER (WHERE change = 'UNCHANGED') AS unchanged FROM ch GROUP BY source_id")
def f9(spark, d):
    return D.diff_summary(D.section_changes(*versions(spark, d)), "source_id")


@query("h7_align")
def h7(spark, d):
    return D.align_sections(*versions(spark, d))


def _pairs(spark, d):
    old, new = versions(spark, d)
    a = old.groupBy("source_id", D.path_key(F.col("path")).alias("path")).agg(F.max("text").alias("old"))
    return a.join(new.groupBy("source_id", D.path_key(F.col("path")).alias("path")).agg(F.max("text").alias("new")).hint("shuffle_merge"), ["source_id", "path"])


@query("h9_word_diff")
def h9(spark, d):
    return _pairs(spark, d).select("source_id", "path", F.posexplode(D.word_diff(F.col("old"), F.col("new"))).alias("place", "x")).select("source_id", "path", "place", "x.op", "x.old", "x.new")


@query("h10_similarity")
def h10(spark, d):
    return _pairs(spark, d).select("source_id", "path", F.round(D.text_similarity(F.col("old"), F.col("new")), 6).alias("similarity"))


def parts(spark, d):
    b = D.heading_context(blocks(spark, d)).select("source_id", "order", "block_type", "heading_path", "text")
    return D.split_oversized(b)


_PARTS = "WITH RECURSIVE " + _BLOCKS.removeprefix("WITH ") + ", " + _OPEN.format("CURRENT ROW") + rf""", hc AS (SELECT source_id, "order", block_type, {_path(" > ")} AS heading_path, text FROM o5),
cut AS (SELECT source_id, "order", 0 AS n, '' AS piece, text AS rest FROM hc WHERE length(text) > 1000
UNION ALL SELECT source_id, "order", n + 1, substr(rest, 1, size), substr(rest, size + 1) FROM (SELECT *, CASE WHEN length(rest) > 1000 AND length(regexp_extract(substr(rest, 1, 1000), '(?s)^.* ')) > 1 THEN length(regexp_extract(substr(rest, 1, 1000), '(?s)^.* ')) ELSE 1000 END AS size FROM cut WHERE rest <> '')),
pt AS (SELECT source_id, "order", block_type, heading_path, 0 AS part, text FROM hc WHERE length(text) <= 1000
UNION ALL SELECT source_id, "order", block_type, heading_path, CAST(row_number() OVER (PARTITION BY source_id, "order" ORDER BY n) - 1 AS INTEGER), piece FROM cut JOIN hc USING (source_id, "order") WHERE regexp_matches(piece, '\S'))"""
_PACKED = _PARTS + """, pk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY "order", part) AS i, length(text) AS len FROM pt),
g1 AS (SELECT source_id, i, 0 AS c, len AS size FROM pk WHERE i = 1 UNION ALL SELECT source_id, i, CASE WHEN fresh THEN c + 1 ELSE c END, CASE WHEN fresh THEN len ELSE size + 1 + len END FROM (SELECT pk.source_id, pk.i, c, size, len, block_type = 'heading' OR size + 1 + len > 1000 AS fresh FROM g1 JOIN pk ON pk.source_id = g1.source_id AND pk.i = g1.i + 1)),
q1 AS (SELECT source_id, c, max(size) AS len, arg_min(heading_path, i) AS h FROM g1 JOIN pk USING (source_id, i) GROUP BY source_id, c)"""
_MERGED = """, g2 AS (SELECT source_id, c, 0 AS b, len AS size, h FROM q1 WHERE c = 0 UNION ALL SELECT source_id, c, CASE WHEN fits THEN b ELSE b + 1 END, CASE WHEN fits THEN size + 1 + len ELSE len END, h FROM (SELECT q1.source_id, q1.c, b, size, len, q1.h, len < 100 AND q1.h = g2.h AND size + 1 + len <= 1000 AS fits FROM g2 JOIN q1 ON q1.source_id = g2.source_id AND q1.c = g2.c + 1)),
q2 AS (SELECT source_id, b, max(size) AS len, any_value(h) AS h FROM g2 GROUP BY source_id, b),
g3 AS (SELECT source_id, b, 0 AS f, len AS size, h FROM q2 WHERE b = 0 UNION ALL SELECT source_id, b, CASE WHEN fits THEN f ELSE f + 1 END, CASE WHEN fits THEN size + 1 + len ELSE len END, h FROM (SELECT q2.source_id, q2.b, f, size, len, q2.h, size < 100 AND q2.h = g3.h AND size + 1 + len <= 1000 AS fits FROM g3 JOIN q2 ON q2.source_id = g3.source_id AND q2.b = g3.b + 1)),
cs AS (SELECT g2.source_id, c, f FROM g2 JOIN g3 ON g2.source_id = g3.source_id AND g2.b = g3.b)"""
_CHUNK_ROWS = """ SELECT source_id, CAST(no AS INTEGER) AS chunk_no, min("order") AS first_order, max("order") AS last_order, CAST(count(DISTINCT "order") AS INTEGER) AS n_blocks, arg_min(heading_path, i) AS heading_path, string_agg(text, chr(10) ORDER BY i) AS text FROM {} GROUP BY source_id, no"""


@query("h1_split", _PARTS + " SELECT * FROM pt")
def h1(spark, d):
    return parts(spark, d)


@query("h2_pack", _PACKED + _CHUNK_ROWS.format("(SELECT pk.*, c AS no FROM pk JOIN g1 USING (source_id, i))"))
def h2(spark, d):
    return D.pack_chunks(parts(spark, d), merge=False)


@query("h3_merge", _PACKED + _MERGED + _CHUNK_ROWS.format("(SELECT pk.*, f AS no FROM pk JOIN g1 USING (source_id, i) JOIN cs USING (source_id, c))"))
def h3(spark, d):
    return D.pack_chunks(parts(spark, d))


@query("f10_coverage", _BLOCKS + ' SELECT source_id, count(*) FILTER ((source_id + "order" // 5) % 3 > 0) AS covered, count(*) AS total FROM b GROUP BY source_id')
def f10(spark, d):
    """Chunks of five blocks, some of which are missing."""
    b = blocks(spark, d)
    five = F.expr("`order` div 5")
    chunks = b.groupBy("source_id", five.alias("five")).agg(F.min("order").alias("first_order"), F.max("order").alias("last_order")).where("(source_id + five) % 3 > 0")
    return D.chunk_coverage(chunks, b)


@query("h5_chunk_id", "SELECT doc_id, source || '-' || substr(sha256(doc_id || ',' || n_chars), 1, 16) || '-' || substr(md5(text), 1, 8) || '-' || (doc_id % 10) AS chunk_id FROM documents")
def h5(spark, d):
    ids = F.concat_ws(",", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    return table(spark, d, "documents").select("doc_id", D.chunk_id(F.col("source"), ids, F.col("text"), F.col("doc_id") % 10).alias("chunk_id"))


@query("g9_overlap", _BLOCKS + """, v AS (SELECT source_id, "order" AS chunk_no, text, lag(text) OVER (PARTITION BY source_id ORDER BY "order") AS p FROM b) SELECT source_id, chunk_no, CASE WHEN length(text) >= 50 THEN right(p, 100) END AS overlap_text, CASE WHEN length(text) >= 50 AND p IS NOT NULL THEN right(p, 100) || chr(10) || text ELSE text END AS embedding_text FROM v""")
def g9(spark, d):
    chunks = blocks(spark, d).select("source_id", F.col("order").alias("chunk_no"), "text")
    return D.chunk_overlap(chunks).select("source_id", "chunk_no", "overlap_text", "embedding_text")


@query("f17_blocks", """SELECT doc_id % 50 AS source_id, 'duplicate_order' AS "check", count(*) AS n FROM (SELECT doc_id % 50 AS doc_id, n_chars % 40 AS o FROM documents GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL UNION ALL SELECT doc_id % 50, 'negative_order', count(*) FROM documents WHERE n_chars % 40 - 1 < 0 GROUP BY ALL""")
def f17(spark, d):
    b = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("source_id"), F.col("doc_id").cast("string").alias("block_id"), (F.col("n_chars") % 40 - 1).alias("order"), "text")
    return D.check_blocks(b)
