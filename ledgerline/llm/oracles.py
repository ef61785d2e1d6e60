"""DuckDB SQL for the llm queries that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM pos),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT win.doc_id, list(s) AS starts FROM win JOIN least USING (h) WHERE win.doc_id > m GROUP BY win.doc_id),
cover AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda y: range(y, y + 50)))) AS gone FROM bad),
kept AS (SELECT d.doc_id, len(w) AS n, list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)) AS k FROM d LEFT JOIN cover USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

_OP3 = r"""
WITH lowd AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowd),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ph AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS p FROM ph),
sizes AS (SELECT DISTINCT n FROM phrases),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS p FROM pos),
hit AS (SELECT doc_id, s, occ.n, item_id FROM occ JOIN phrases ON occ.p = phrases.p AND occ.n = phrases.n),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY k.doc_id
"""

_OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
o AS (SELECT payload_digest, max(page_id) AS original FROM f WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, f.payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM f LEFT JOIN o ON f.payload_digest = o.payload_digest AND payload_bytes >= 1000
"""

_OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, a, cut, fx.f AS l, fy.f AS r, CAST(2000000 AS HUGEINT) * a // (CAST(fx.f AS HUGEINT) + fy.f) AS score FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS m FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c)) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE m IS NULL OR 100 * CAST(m AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_OP12 = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, CAST(xor(list_reduce(list_transform(range(0, 8 * length(CAST(c AS VARCHAR))), lambda i: CAST(CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END AS BIGINT)),
    lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS BIGINT) AS h FROM ids),
t AS (SELECT conv_id AS c, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, length(coalesce(text, '')) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.c, t.pos, t.id, t.n FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.pos <= h.h UNION ALL SELECT h.c, t.pos + 1000000 AS pos, t.id, t.n FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
s AS (SELECT c, list(id ORDER BY pos) AS ids, list(n ORDER BY pos) AS ns FROM r GROUP BY c),
q AS (SELECT ids.c, coalesce(s.ids, []) AS ids, coalesce(s.ns, []) AS ns FROM ids LEFT JOIN s USING (c)),
p AS (SELECT c, d, array_to_string(ids[1:d], '') AS key, CASE WHEN d > 0 THEN array_to_string(ids[1:d - 1], '') END AS up, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, d = len(ids) AS ends FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM q)),
node AS (SELECT key, any_value(up) AS up, d, min(c) AS c, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY key, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON node.key = kids.up AND node.d = kids.d),
sums AS (SELECT p.key, p.d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * f.n) AS saved_tokens FROM full_node f JOIN p ON p.c = f.c AND p.d <= f.d GROUP BY p.key, p.d)
SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, b.c AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_node a JOIN sums ON a.key = sums.key AND a.d = sums.d LEFT JOIN node b ON a.up = b.key AND a.d = b.d + 1
"""

ORACLES: dict[str, str] = {
    "op2_substring_dedup": _OP2,
    "op3_decontamination": _OP3,
    "op9_line_dedup": _OP9,
    "op10_warc": _OP10,
    "op11_collocations": _OP11,
    "op12_prefix_trie": _OP12,
}
