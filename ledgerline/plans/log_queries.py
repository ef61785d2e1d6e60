"""Queries of retrieval, usage logs and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import logs as L
from ledgerline.operators import registry as G
from ledgerline.operators import retrieval as R
from ledgerline.operators.lexical_index import LexicalIndex
from ledgerline.plans.base import query, table
from ledgerline.plans.change_queries import DECIDED, access_items, askers
from ledgerline.sources.io import shared_folder
from ledgerline.streaming import logs as ST

USAGE = "usage AS (SELECT user_id AS case_id, event_type AS model, CASE WHEN event_id % 3 = 0 THEN 'plan' ELSE 'react' END AS phase, CAST(floor(abs(value)) AS BIGINT) AS input_tokens, event_id % 50 AS output_tokens, CAST(floor(abs(value)) AS BIGINT) + event_id % 50 + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS total_tokens, CAST(event_id % 4 AS INT) - CASE WHEN event_id % 101 = 0 THEN 9 ELSE 0 END AS tool_calls, CASE WHEN event_id % 10 > 0 THEN event_id % 900 END AS latency_ms, CAST((event_id % 1000) / 1000.0 AS DECIMAL(18, 6)) AS cost, ts AS recorded_at, event_id FROM events)"


def _usage(e):
    k = F.col("event_id")
    spent = F.floor(F.abs("value")).cast("bigint")
    return e.select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("model"), F.when(k % 3 == 0, "plan").otherwise("react").alias("phase"), spent.alias("input_tokens"), (k % 50).alias("output_tokens"), (spent + k % 50 + F.when(k % 97 == 0, 1).otherwise(0)).alias("total_tokens"),
        ((k % 4).cast("int") - F.when(k % 101 == 0, 9).otherwise(0)).alias("tool_calls"), F.when(k % 10 > 0, k % 900).alias("latency_ms"), ((k % 1000) / 1000).cast("decimal(18,6)").alias("cost"), F.col("ts").cast("timestamp").alias("recorded_at"), "event_id",
    )


def usage(spark, d):
    return _usage(table(spark, d, "events"))


def streamed(spark, d, name="events"):
    """The same table as a stream of files."""
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


@query("f7_token_summary", f"WITH {USAGE} SELECT model, phase, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, round(CAST(sum(cost) AS DOUBLE), 6) AS cost, round(avg(latency_ms), 6) AS avg_latency_ms FROM usage GROUP BY CUBE (model, phase)")
def f7(spark, d):
    return L.token_summary(usage(spark, d), "model", "phase", cube=True).withColumns({"cost": F.round(F.col("cost").cast("double"), 6), "avg_latency_ms": F.round("avg_latency_ms", 6)})


@query("f8_token_checks", f"WITH {USAGE} SELECT event_id, CASE WHEN tool_calls < 0 THEN 'negative' WHEN total_tokens <> input_tokens + output_tokens THEN 'total' END AS issue FROM usage")
def f8(spark, d):
    return L.token_checks(usage(spark, d)).select("event_id", "issue")


LOG = "log AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id, event_id AS turn, event_type AS action_hash, md5(CAST(floor(value) % 6 AS VARCHAR)) AS observation_hash, value > 10 AS progress FROM events)"


def agent_log(e):
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("action_hash"), F.md5((F.floor("value") % 6).cast("double").cast("string")).alias("observation_hash"), (F.col("value") > 10).alias("progress"))


_GUARDED = f"""WITH {LOG}, s AS (SELECT *, row_number() OVER w AS step, lag(action_hash) OVER w AS prev, count(*) OVER (PARTITION BY run_id, observation_hash ORDER BY turn) AS seen, sum(progress::INT) OVER w AS isl FROM log WINDOW w AS (PARTITION BY run_id ORDER BY turn)),
i AS (SELECT *, sum((NOT progress)::INT) OVER (PARTITION BY run_id, isl ORDER BY turn) AS idle FROM s),
r AS (SELECT run_id, turn, CASE WHEN step > 10 THEN 'max_steps' WHEN action_hash = prev THEN 'same_action' WHEN seen >= 3 THEN 'same_observation' WHEN idle >= 3 THEN 'no_progress' END AS reason FROM i)
SELECT run_id, min(turn) AS turn, min_by(reason, turn) AS reason FROM r WHERE reason IS NOT NULL GROUP BY run_id"""


@query("g7_loop_guard", _GUARDED)
def g7(spark, d):
    return L.loop_guard(agent_log(table(spark, d, "events")))


@query("g8_run_complete", f"WITH {LOG}, s AS (SELECT run_id, list_sort(list('s' || (turn % 3))) AS done FROM log GROUP BY run_id) SELECT run_id, done = ['s0', 's1', 's2'] AS complete FROM s")
def g8(spark, d):
    log = agent_log(table(spark, d, "events"))
    plans = log.select("run_id").distinct().select("run_id", F.array(*map(F.lit, ("s0", "s1", "s2"))).alias("plan_steps"))
    return L.run_completeness(log.select("run_id", F.concat(F.lit("s"), (F.col("turn") % 3).cast("string")).alias("step_id")), plans)


@query("g11_decisions", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'unknown_step' WHEN event_id % 2 = 0 AND event_id % 7 = 0 THEN 'tool_missing' WHEN event_id % 2 = 1 AND event_id % 7 > 0 THEN 'tool_unexpected' WHEN event_id % 2 = 0 AND event_type NOT IN ('click', 'view') THEN 'tool_not_allowed' END AS issue FROM events")
def g11(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    tool = F.when(k % 7 > 0, F.col("event_type"))
    log = e.select("event_id", F.col("user_id").alias("run_id"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("step_id"), F.when(k % 2 == 0, "tool_call").otherwise("complete").alias("decision"), tool.alias("tool"), F.when(k % 7 > 0, F.col("props")).alias("tool_input"))
    plans = e.select(F.col("user_id").alias("run_id")).distinct().select("run_id", F.explode(F.array(*map(F.lit, ("s0", "s1", "s2", "s3")))).alias("step_id"), F.array(F.lit("click"), F.lit("view")).alias("allowed_tools"))
    return L.check_decisions(log, plans).select("event_id", "issue")


_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_STATS = f"w AS (SELECT doc_id AS chunk, {_TOK.format('text')} AS ws FROM documents), st AS (SELECT chunk, len(ws) AS length, unnest(ws) AS term FROM w), tf AS (SELECT chunk, term, length, count(*) AS tf FROM st GROUP BY ALL)"


def chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), "text")


@query("i1_term_stats", f"WITH {_STATS} SELECT chunk, term, CAST(length AS INTEGER) AS length, tf FROM tf")
def i1(spark, d):
    return R.term_stats(chunks(spark, d))


_INDEXES: dict[tuple, LexicalIndex] = {}


def lexical_index(spark, d):
    """The index of all documents: made once for a session and a state of the table's files, then only read."""
    files = table(spark, d, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()[0]
    key = (spark.sparkContext.applicationId, d, state)
    if key not in _INDEXES or not _INDEXES[key].exists():  # the shared folder may have been cleared
        _INDEXES[key] = LexicalIndex(spark, shared_folder(spark, "lexical")).append(chunks(spark, d))
    return _INDEXES[key]


def lexical_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


_BM25 = f"""{_STATS}, n AS (SELECT count(*) AS n_docs, avg(len(ws)) AS ml FROM w), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), idf AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM df, n), m AS (SELECT avg(idf) AS mi FROM idf),
q AS (SELECT item_id AS query, unnest({_TOK.format("text")}) AS term FROM benchmark),
sc AS (SELECT query, chunk, sum(CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / ml))) AS score FROM q JOIN tf USING (term) JOIN idf USING (term), n, m GROUP BY ALL),
lex AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk) AS INTEGER) AS rank, chunk, score FROM sc WHERE score > 0)"""


@query("i2_bm25", f"WITH {_BM25} SELECT query, rank, chunk, round(score, 6) AS score FROM lex WHERE rank <= 5")
def i2(spark, d):
    return lexical_index(spark, d).topk(lexical_queries(spark, d)).withColumn("score", F.round("score", 6))


_VEC = "vq AS (SELECT vec_id AS query, embedding AS qv FROM embeddings), vs AS (SELECT query, vec_id AS chunk, list_sum(list_transform(list_zip(embedding, qv), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM embeddings, vq), den AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk) AS INTEGER) AS rank, chunk, score FROM vs)"
_ASKED = _VEC.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 100 = 0)", 1)


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"))


def dense(spark, d, asked="true", k=5):
    v = vectors(spark, d)
    return R.vector_topk(v, v.where(asked).withColumnRenamed("chunk", "query"), k)


@query("i3_vector_topk", f"WITH {_ASKED} SELECT query, rank, chunk, round(score, 6) AS score FROM den WHERE rank <= 5")
def i3(spark, d):
    return dense(spark, d, "chunk % 100 = 0").withColumn("score", F.round("score", 6))


@query("i4_rrf", f"WITH {_BM25}, {_VEC}, u AS (SELECT query, chunk, 1 / (60 + rank) AS p FROM lex WHERE rank <= 5 UNION ALL SELECT query, chunk, 1 / (60 + rank) FROM den WHERE rank <= 5), f AS (SELECT query, chunk, sum(p) AS score FROM u GROUP BY ALL) SELECT query, rank, chunk, round(score, 9) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk) AS INTEGER) AS rank FROM f) WHERE rank <= 5")
def i4(spark, d):
    """Every text and every vector asks; those of one number are one query."""
    lexical = lexical_index(spark, d).topk(lexical_queries(spark, d))
    return R.rrf(dense(spark, d), lexical).withColumn("score", F.round("score", 9))


def _search(spark, d, queries, k=5):
    """Each query is asked by each asker; what an asker may not see isn't ranked."""
    seen = G.access_decisions(access_items(spark, d), askers(spark)).where("reason is null").select("asker", F.col("doc_id").alias("chunk"))
    return lexical_index(spark, d).search(queries, seen, k).withColumn("score", F.round("score", 6))


_SEARCH = "al AS (SELECT asker || '/' || query AS query, chunk, score FROM lex JOIN dec ON chunk = doc_id AND reason IS NULL) SELECT query, rank, chunk, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk) AS INTEGER) AS rank FROM al) WHERE rank <= 5"


@query("i5_search", f"WITH {_BM25}, {DECIDED}, {_SEARCH}")
def i5(spark, d):
    return _search(spark, d, lexical_queries(spark, d))


_DIFFS = "CASE WHEN item_id % 2 = 0 THEN substr(text, 101) ELSE substr(text, 1, 200) END"


@query("i11_diff_evidence", f"WITH {_BM25.replace(_TOK.format('text') + ') AS term FROM benchmark', _TOK.format(_DIFFS) + ') AS term FROM benchmark')}, {DECIDED}, {_SEARCH}")
def i11(spark, d):
    """A changed section asks with its new text, a removed one with its old."""
    q = lexical_queries(spark, d)
    diffs = q.select("query", F.when(F.col("query") % 2 == 0, F.substring("text", 101, 1 << 30)).alias("new_text"), F.substring("text", 1, 200).alias("old_text"))
    return _search(spark, d, diffs.select("query", F.coalesce("new_text", "old_text").alias("text")))


_HEADINGS = ("Lương cơ bản và phụ cấp", "Overtime payroll tax", "Recruitment", "Ngày công chuẩn 10 vnd")
_HAY = f"trim(regexp_replace(translate(translate(lower(list_extract({list(_HEADINGS)!r}, CAST(doc_id % 4 + 1 AS BIGINT)) || chr(10) || text), '{S.MARKED}', '{S.PLAIN}'), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"
_PHRASED = " + ".join(f"CASE WHEN contains(hay, '{p}') THEN {3.0 if p in R.STRONG else 1.5} ELSE 0 END" for p in R.PHRASES)


@query("i6_phrase_score", f"WITH h AS (SELECT doc_id, {_HAY} AS hay FROM documents), s AS (SELECT doc_id, hay, {_PHRASED} AS n FROM h) SELECT doc_id, CAST(CASE WHEN n > 0 THEN n + CASE WHEN regexp_matches(hay, '[0-9] ?(vnd|dong)\\b') THEN 1 ELSE 0 END ELSE 0 END AS DOUBLE) AS score FROM s")
def i6(spark, d):
    """Documents below one of four headings."""
    heading = F.element_at(F.array(*map(F.lit, _HEADINGS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", R.phrase_score(F.concat(heading, F.lit("\n"), F.col("text"))).alias("score"))


@query("i7_budget", """WITH RECURSIVE t AS (SELECT source AS query, doc_id AS chunk, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id % 17 DESC, doc_id) AS rank FROM documents),
w AS (SELECT query, 0::BIGINT AS rank, 0::BIGINT AS chunk, 0::BIGINT AS size, 0::BIGINT AS used, 0 AS n, false AS kept FROM (SELECT DISTINCT query FROM t)
UNION ALL SELECT t.query, t.rank, t.chunk, t.size, CASE WHEN n = 0 OR used + t.size <= 18000 THEN used + t.size ELSE used END, n + CASE WHEN n = 0 OR used + t.size <= 18000 THEN 1 ELSE 0 END, n = 0 OR used + t.size <= 18000 FROM w JOIN t ON t.query IS NOT DISTINCT FROM w.query AND t.rank = w.rank + 1 WHERE t.rank <= 8)
SELECT query, CAST(rank AS INTEGER) AS rank, chunk, size FROM w WHERE kept""")
def i7(spark, d):
    scored = table(spark, d, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("chunk"), (F.col("doc_id") % 17).cast("double").alias("score"), F.col("n_chars").alias("size"))
    return R.budgeted_topk(scored)


@query("i8_evidence", "SELECT source AS query, n_chars % 30 AS block, min(doc_id) AS rank, substr(min_by(text, doc_id), 1, 500) AS text FROM documents GROUP BY ALL")
def i8(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("query"), (F.col("n_chars") % 30).alias("block"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("chunk"), "text")
    return R.evidence_rows(rows)


@query("d16_citation")
def d16(spark, d):
    """Quotes of varied place and length: exact, with a number added, of a wrong id, with words put in or left out, reversed, or none."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    cut = F.substring("text", (k * 37 % F.greatest(F.col("n_chars") - 60, F.lit(1)) + 1).cast("int"), (20 + k * 11 % 180).cast("int"))
    half = (F.char_length(cut) / 2).cast("int")
    left, right = F.substring(cut, F.lit(1), half), F.substring(cut, half + 1, F.lit(1 << 20))
    kinds = [cut, F.concat(cut, F.lit(" 987654321")), cut, F.concat(left, F.lit(" also "), right), F.concat(left, F.substring(right, 7, 1 << 20)), F.reverse(cut), F.concat(F.substring(left, 3, 1 << 20), F.lit("so"), right, F.lit(" or not"))]
    quote = F.coalesce(*[F.when(k % 8 == i, x) for i, x in enumerate(kinds)])
    cites = docs.select("doc_id", F.when(k % 8 == 2, -1 - k).otherwise(k).alias("evidence_id"), quote.alias("quote"))
    return R.citation_check(cites, docs.select(k.alias("evidence_id"), "text")).select("doc_id", "issue", F.round("similarity", 6).alias("similarity"))


@query("j1_stream_meter", f"WITH {USAGE} SELECT date_trunc('day', recorded_at) AS window_start, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage GROUP BY ALL")
def j1(spark, d):
    """The files are one batch for the watermark, so none of their rows is late."""
    return ST.run_meter(_usage(streamed(spark, d))).rows().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("j2_stream_guard", _GUARDED)
def j2(spark, d):
    return ST.run_guard(agent_log(streamed(spark, d))).rows()


@query("j3_stream_dedup", "SELECT DISTINCT user_id || '/' || event_type AS key FROM events")
def j3(spark, d):
    """One result for each user and kind of event, however often and late it is sent."""
    keyed = streamed(spark, d).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return ST.run_once(keyed, "key", "ts").rows().select("key")


@query("j4_stream_audit", """SELECT '{"event_type":"agent.step","payload":"{\\"event_id\\":' || event_id || '}","actor":"system","timestamp":"' || user_id || '"}' AS value FROM events""")
def j4(spark, d):
    return ST.run_audit(streamed(spark, d), "agent.step", "system", "user_id", "event_id").rows()
