"""Lexical and vector retrieval over chunk tables, many queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import scalars as S
from ledgerline.operators import matching
from ledgerline.sources.io import written

#: Phrases of pay rules, and those that weigh more.
PHRASES = ("luong co ban", "tien luong", "bang luong", "ngay cong", "cong chuan", "phu cap", "tang ca", "lam them", "bao hiem", "bhxh", "bhyt", "bhtn", "thue thu nhap", "thue tncn", "tam ung", "khau tru", "thuong", "don gia", "salary", "allowance", "overtime", "insurance", "deduction", "tax", "payroll")
STRONG = ("luong co ban", "tien luong", "bang luong", "phu cap", "tang ca", "lam them", "bao hiem", "bhxh", "thue thu nhap", "thue tncn", "khau tru", "salary", "allowance", "overtime", "insurance", "deduction", "payroll")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def term_stats(chunks: DataFrame) -> DataFrame:
    """(chunk, term, tf, length) of ``chunks (chunk, text)``."""
    rows = chunks.select("chunk", tokens(F.col("text")).alias("words")).select("chunk", F.size("words").alias("length"), F.explode("words").alias("term"))
    return rows.groupBy("chunk", "term", "length").agg(F.count("*").alias("tf"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, max_terms: int = 200_000) -> DataFrame:
    """(query, chunk, score) by Okapi BM25; negative idf counts as epsilon x mean idf.

    Postings are built for the asked terms only, which filter the words before
    they are counted; of all other terms only the document frequencies are
    needed (the mean idf is one of the whole corpus).
    """
    asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    # sides of no more rows than the asked terms, which are counted, are broadcast; others are shuffled
    few = asked.limit(max_terms + 1).count() <= max_terms
    side = F.broadcast if few else (lambda rows: rows.hint("shuffle_hash"))
    terms = asked.select("term").distinct()
    words = chunks.select("chunk", tokens(F.col("text")).alias("words"))
    sizes = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("mean_length"))
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    with_idf = df.join(F.broadcast(sizes)).withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = with_idf.agg(F.avg("idf").alias("mean_idf"))
    weights = with_idf.join(side(terms), "term").join(F.broadcast(mean)).select("term", "mean_length", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    found = words.select("chunk", F.size("words").alias("length"), F.explode("words").alias("term")).join(side(terms), "term", "left_semi")
    postings = found.groupBy("chunk", "term", "length").agg(F.count("*").alias("tf")).join(side(weights), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = postings.select("term", "chunk", part.alias("part")).join(side(asked), "term")
    return scored.groupBy("query", "chunk").agg(F.sum(F.col("part") * F.col("times")).alias("score")).where("score > 0")


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query, rank, chunk, score): the best ``k`` of :func:`bm25_scores`."""
    return ranked(bm25_scores(chunks, queries, **options), k)


def search(chunks: DataFrame, queries: DataFrame, seen: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query, rank, chunk, score), ``query`` being ``asker/query``: lexical search of what each asker may see.

    ``seen (asker, chunk)`` is packed to one row for each chunk, so a chunk's
    scores meet its askers once; ranking comes last, and once.
    """
    packed = seen.groupBy("chunk").agg(F.collect_set("asker").alias("askers"))
    allowed = bm25_scores(chunks, queries, **options).join(packed.hint("shuffle_merge"), "chunk")
    rows = allowed.select("query", "chunk", "score", F.explode("askers").alias("asker"))
    return ranked(rows.select(F.concat_ws("/", "asker", F.col("query").cast("string")).alias("query"), "chunk", "score"), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "chunk")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "chunk", "score")


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row, as a column."""
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]


def _best(asked: pd.DataFrame, rows: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """The best ``k`` of ``rows (chunk, vec)`` for each of ``asked (query, vec)``, with those that tie and a few more; NaN is no score."""
    out = [pd.DataFrame({"query": asked["query"].iloc[:0], "chunk": rows["chunk"].iloc[:0], "score": np.zeros(0)})]
    for length in set(asked["vec"].map(len)) & set(rows["vec"].map(len)):
        a, b = asked[asked["vec"].map(len) == length], rows[rows["vec"].map(len) == length]
        x, y = (np.stack(side["vec"].to_numpy()).astype(np.float64) for side in (a, b))
        n, group = min(k, len(y)), max(1, min(64, len(y) // (8 * k)))
        whole, step = len(y) // group * group, max(1, min(256, 4_000_000 // len(y)))
        for lo in range(0, len(x), step):
            s = x[lo : lo + step] @ y.T
            if metric == "cosine":
                s = s / (np.linalg.norm(x[lo : lo + step], axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
            if np.isnan(s.sum()):
                s[np.isnan(s)] = -np.inf
            # ties of the rounded score are left to the ranking; the k-th best of the maxima of groups is no more than the k-th best of all
            tops = np.concatenate([s[:, :whole].reshape(len(s), group, -1).max(axis=1), s[:, whole:]], axis=1)
            i, j = np.nonzero(s >= np.maximum(_kth(tops, n) - 2e-9, np.finfo(float).min))
            if len(i) > 4 * n * len(s):
                i, j = np.nonzero(s >= np.maximum(_kth(s, n) - 2e-9, np.finfo(float).min))
            found = pd.DataFrame({"query": a["query"].to_numpy()[lo + i], "chunk": b["chunk"].to_numpy()[j], "score": s[i, j]})
            if len(i) > 4 * n * len(s):  # of copies of a vector the ranking takes those with the smallest ids
                found = found.assign(at=i).sort_values("chunk").groupby(["at", "score"]).head(n).drop(columns="at")
            out.append(found)
    return pd.concat(out)


def _vectors(df: DataFrame, name: str, kind: str = "array<double>") -> DataFrame:
    return df.where("vec is not null").select(name, F.col("vec").cast(kind).alias("vec"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "dot", slice_rows: int = 20_000, block: int = 4_000, tile: int = 50_000) -> DataFrame:
    """(query, rank, chunk, score) of ``vectors (chunk, vec)`` for ``queries (query, vec)``.

    Few vectors are one slice and queries are dealt in blocks; each pair is one
    task's matrix products, which leave the best ``k`` of a slice.  More than
    ``slice_rows`` vectors are first dealt to balls (:class:`VectorBalls`), but
    if as many queries ask, a bound for each query and ball would be far more
    than the tables: then both sides are cut by hash into parts of at most about
    ``tile``, and each pair of parts is a tile of scores.  Null vectors, and
    those of another length than the query's, are not compared.
    """
    n, asked = vectors.count(), queries.count()
    if n > slice_rows >= asked:
        return VectorBalls(vectors, metric, slice_rows=slice_rows, rows=n).topk(queries, k)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    tiled = n > slice_rows
    cuts = lambda rows: max(-(-rows // tile), math.isqrt(4 * cores) + 1)  # noqa: E731  tiles enough for all cores
    slices, blocks = (cuts(n), cuts(asked)) if tiled else (1, max(1, -(-asked // block)))
    part = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    plain = {x.schema["vec"].dataType.simpleString() for x in (vectors, queries)} == {"array<float>"}
    kind = "array<float>" if plain else "array<double>"  # half the bytes to deal; multiplied as doubles in any case
    v = _vectors(vectors, "chunk", kind).withColumn("slice", part("chunk", slices)).withColumn("block", every(blocks))
    q = _vectors(queries, "query", kind).withColumn("block", part("query", blocks)).withColumn("slice", every(slices))
    if tiled:  # not coalesced by size: a tile's work is far more than its bytes tell
        v, q = (side.repartition(max(32, 4 * cores), "block", "slice") for side in (v, q))
    schema = T.StructType([queries.schema["query"], vectors.schema["chunk"], T.StructField("score", T.DoubleType())])
    return ranked(q.groupBy("block", "slice").cogroup(v.groupBy("block", "slice")).applyInPandas(lambda a, b: _best(a, b, k, metric), schema), k)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class VectorBalls:
    """Vectors in balls around pivots, with exact search that leaves out far balls.

    Pivots are vectors of the table with the smallest hashes, at most
    ``max_pivots`` (about the square root of all).  Each vector goes to its
    nearest pivot of equal length; a ball keeps its radius and its number of
    rows.  An inner product with a member is at most that with the pivot plus
    the query's norm times the radius.  Each query is scored in the balls with
    the highest bounds first; its k-th score then rules out the balls whose
    bound is lower.  Balls of more than ``slice_rows`` rows are split by hash.
    Cosine is the inner product of vectors divided by their norms.
    """

    def __init__(self, vectors: DataFrame, metric: str = "dot", max_pivots: int = 1024, slice_rows: int = 20_000, rows: int | None = None):
        self.metric, self.slice_rows, self.kind = metric, slice_rows, vectors.schema["chunk"]
        rows = vectors.count() if rows is None else rows
        v = _vectors(vectors, "chunk")
        most = min(max_pivots, max(1, int(rows**0.5)))
        chosen = v.where(F.size("vec") > 0).orderBy(F.xxhash64("chunk", "vec")).limit(most).select("vec").collect()  # bounded by max_pivots
        pivots: dict[int, list] = {}
        for r in chosen:
            x = np.array(r["vec"])
            pivots.setdefault(len(x), []).append(x)
        self.lengths, self.first, at = {}, {}, 0
        for length, some in sorted(pivots.items()):
            self.lengths[length], self.first[length] = _unit(np.stack(some), metric), at
            at += len(some)
        lengths, first, metric = self.lengths, self.first, self.metric

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                size = f["vec"].map(len)
                # vectors of a length without a pivot share the ball of minus their length
                ball, far = -size.to_numpy(np.int64), np.full(len(f), np.inf)
                for length, p in lengths.items():
                    some = (size == length).to_numpy()
                    if some.any():
                        x = _unit(np.stack(f["vec"].to_numpy()[some]), metric)
                        d = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
                        near = d.argmin(1)
                        ball[some], far[some] = near + first[length], np.sqrt(np.maximum(d[np.arange(len(near)), near], 0))
                yield f.assign(ball=ball, far=far)

        schema = T.StructType([*v.schema.fields, T.StructField("ball", T.LongType()), T.StructField("far", T.DoubleType())])
        dealt = written(v.mapInPandas(deal, schema), "balls")
        #: (ball, radius, n): at most one row for each pivot and for each length without one.
        self.balls = written(dealt.groupBy("ball").agg(F.max("far").alias("radius"), F.count("*").alias("n")), "radii")
        salts = F.greatest(F.lit(1), F.ceil(F.col("n") / slice_rows)).cast("int")
        self.rows = dealt.join(self.balls.hint("shuffle_hash"), "ball").select("chunk", "vec", "ball", F.pmod(F.xxhash64("chunk"), salts).cast("int").alias("salt"))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query, vec, ball, salts, bound) of every query and ball of its length."""
        lengths, first, metric = self.lengths, self.first, self.metric
        told = {r["ball"]: (r["radius"], r["n"]) for r in self.balls.limit(1 << 16).collect()}
        slice_rows, q = self.slice_rows, _vectors(queries, "query")

        def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for query, vec in zip(f["query"], f["vec"], strict=True):
                    p, balls, limit = lengths.get(len(vec)), [], []
                    if p is not None:
                        x = _unit(np.asarray(vec)[None, :], metric)[0]
                        dots, norm = p @ x, float(np.linalg.norm(x))
                        balls = [i for i in range(first[len(vec)], first[len(vec)] + len(p)) if i in told]
                        limit = [float(dots[i - first[len(vec)]]) + norm * told[i][0] for i in balls]
                    if -len(vec) in told:
                        balls, limit = [*balls, -len(vec)], [*limit, np.inf]
                    yield pd.DataFrame({"query": [query] * len(balls), "vec": [vec] * len(balls), "ball": balls, "salts": [max(1, -(-told[i][1] // slice_rows)) for i in balls], "bound": limit}).astype({"ball": "int64", "salts": "int32", "bound": "float64"})

        schema = T.StructType([*q.schema.fields, T.StructField("ball", T.LongType()), T.StructField("salts", T.IntegerType()), T.StructField("bound", T.DoubleType())])
        return q.mapInPandas(bound, schema)

    def scored(self, asked: DataFrame, k: int) -> DataFrame:
        """(query, chunk, score): of each ball in ``asked (query, vec, ball, salts)`` the best ``k``."""
        metric = self.metric
        q = asked.select("query", "vec", "ball", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        schema = T.StructType([asked.schema["query"], self.kind, T.StructField("score", T.DoubleType())])
        return q.groupBy("ball", "salt").cogroup(self.rows.groupBy("ball", "salt")).applyInPandas(lambda a, b: _best(a, b, k, metric), schema)

    def plan(self, queries: DataFrame, k: int, first: int = 4) -> tuple[DataFrame, DataFrame]:
        """(what the first balls give, the balls that can still hold one of the best ``k``)."""
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "ball")
        every = written(self.bounds(queries).withColumn("nth", F.row_number().over(order)), "bounds")
        begun = written(self.scored(every.where(F.col("nth") <= first), k), "first")
        kth = begun.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("nth") == k).select("query", F.col("score").alias("floor"))
        rest = every.where(F.col("nth") > first).join(kth.hint("shuffle_hash"), "query", "left").where("floor is null or bound >= floor - 1e-6")
        return begun, written(rest.select("query", "vec", "ball", "salts"), "rest")

    def topk(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query, rank, chunk, score), as by comparing all."""
        begun, rest = self.plan(queries, k)
        return ranked(begun.unionByName(self.scored(rest, k)), k)


def rrf(*lists: DataFrame, k: int = 60, top_k: int = 5) -> DataFrame:
    """Fuses ranked lists, each cut to ``top_k`` first, by the sum of 1 / (k + rank)."""
    cut = [x.where(F.col("rank") <= top_k).select("query", "chunk", (1 / (k + F.col("rank"))).alias("part")) for x in lists]
    every = cut[0]
    for x in cut[1:]:
        every = every.unionByName(x)
    return ranked(every.groupBy("query", "chunk").agg(F.sum("part").alias("score")), top_k)


def phrase_score(text: Column) -> Column:
    """3 for each strong phrase, 1.5 for each other, 1 more with an amount of money beside any."""
    hay = S.match_key(text)
    score = sum((F.when(F.contains(hay, F.lit(p)), 3.0 if p in STRONG else 1.5).otherwise(0.0) for p in PHRASES), F.lit(0.0))
    return F.when(score > 0, score + F.when(hay.rlike(r"\b[0-9]+ ?(vnd|dong)\b"), 1.0).otherwise(0.0)).otherwise(0.0)


def point_id(source: Column, order: Column, text: Column) -> Column:
    """A stable id of a chunk: its source, its place and its text."""
    return F.substring(F.sha2(F.concat_ws("|", source, order.cast("string"), F.sha2(text, 256)), 256), 1, 32)


def merged_metadata(document: Column, chunk: Column) -> Column:
    """A document's fields below a chunk's own: the chunk's win."""
    return F.map_concat(F.map_filter(document, lambda k, v: ~F.map_contains_key(chunk, k)), chunk)


def budgeted_topk(scored: DataFrame, k: int = 8, budget: int = 18000) -> DataFrame:
    """Best ``k`` of each group by score, then order; items over the budget are
    skipped, smaller ones after them may fit, the first always goes in."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "chunk")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk", "size"))).alias("items"))
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<rank:int,chunk:bigint,size:bigint>>").alias("kept"))

    def take(a: Column, x: Column) -> Column:
        fits = (F.size(a["kept"]) == 0) | (a["used"] + x["size"] <= budget)
        item = F.struct(x["rank"].cast("int").alias("rank"), x["chunk"].cast("bigint").alias("chunk"), x["size"].cast("bigint").alias("size"))
        return F.struct(F.when(fits, a["used"] + x["size"]).otherwise(a["used"]).cast("bigint").alias("used"), F.when(fits, F.array_append(a["kept"], item)).otherwise(a["kept"]).alias("kept"))

    return lists.select("query", F.inline(F.aggregate("items", empty, take, lambda a: a["kept"])))


def evidence_rows(chosen: DataFrame, cut: int = 500) -> DataFrame:
    """(query, block, rank, text): each block of the chosen chunks once, by rank."""
    w = Window.partitionBy("query", "block").orderBy("rank", "chunk")
    return chosen.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("query", "block", "rank", F.substring("text", 1, cut).alias("text"))


def citation_check(citations: DataFrame, evidence: DataFrame, min_similarity: float = 0.8) -> DataFrame:
    """Adds ``issue`` (null: valid) and ``similarity`` of quotes to their evidence.

    A quote that isn't in its source is compared with the stretch of it that
    begins with their longest common block, found in time linear in the source
    (:func:`matching.quoted`).
    """
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))

    @F.pandas_udf("double")
    def likeness(quotes: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or s is None else matching.quoted(q, s) for q, s in zip(quotes, sources, strict=True)])

    joined = citations.join(evidence.select("evidence_id", F.col("text").alias("source")).hint("shuffle_merge"), "evidence_id", "left")
    rows = joined.withColumn("similarity", likeness(flat(F.col("quote")), flat(F.col("source"))))
    issue = F.when(F.col("source").isNull(), "UNKNOWN_EVIDENCE_ID").when(F.col("quote").isNull(), None).when(S.number_mismatch(F.col("quote"), F.col("source")), "NUMBER_MISMATCH").when(F.col("similarity") < min_similarity, "QUOTE_NOT_FOUND")
    return rows.withColumn("issue", issue).drop("source")
