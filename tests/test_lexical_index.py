"""The stored index: same results as without it, appends, pruned reads, skipped segments."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import retrieval as R
from ledgerline.operators.lexical_index import LexicalIndex
from ledgerline.sources.io import shared_folder


@pytest.fixture(scope="module")
def chunks(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk"), "text")


@pytest.fixture(scope="module")
def queries(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query"), "text")


@pytest.fixture(scope="module")
def index(spark, chunks):
    """Three appends, of 16 chunks a segment."""
    index = LexicalIndex(spark, shared_folder(spark), buckets=8, segment_chunks=16)
    for i in range(3):
        index.append(chunks.where(f"chunk % 3 = {i}"))
    return index


def rows(df):
    return sorted((r["query"], r["rank"], r["chunk"], round(r["score"], 9)) for r in df.collect())


def test_appended_index_equals_plain_scores(index, chunks, queries):
    want = rows(R.bm25_topk(chunks, queries, 5))
    assert rows(R.ranked(index.scores(queries), 5)) == want
    assert rows(R.ranked(index.scores(queries, 5, always=True), 5)) == want and rows(index.topk(queries)) == want


def test_search_by_access(index, chunks, queries):
    """One asker sees all, one few chunks, one none; bounds hold for each."""
    seen = chunks.select(F.lit("all").alias("asker"), "chunk").unionByName(chunks.where("chunk % 50 = 1").select(F.lit("few").alias("asker"), "chunk"))
    want = rows(R.search(chunks, queries, seen, 4))
    got = index.scores(queries, 4, seen, always=True).select(F.concat_ws("/", "asker", F.col("query").cast("string")).alias("query"), "chunk", "score")
    assert rows(R.ranked(got, 4)) == want and rows(index.search(queries, seen, 4)) == want


def test_only_asked_buckets_are_read(spark, index, chunks):
    word = chunks.where("text is not null").select(F.explode(R.tokens(F.col("text"))).alias("w")).first()["w"]
    asked = spark.createDataFrame([(1, word)], "query long, text string")
    plan = index.postings(asked.select(F.col("text").alias("term")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert index.topk(asked).count() > 0


def test_bounds_skip_segments(spark):
    """A term that is dense in a few chunks: segments with weak postings aren't scored."""
    text = F.concat(F.when(F.col("id") < 10, F.repeat(F.lit("salary "), 30)).otherwise(F.when(F.col("id") % 3 == 0, F.lit("salary ")).otherwise(F.lit(""))), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 997).cast("string")) for k in range(1, 30)]))
    chunks = spark.range(4000).select(F.col("id").alias("chunk"), text.alias("text"))
    index = LexicalIndex(spark, shared_folder(spark), buckets=4, segment_chunks=20)
    index.append(chunks)
    asked = spark.createDataFrame([(1, "salary")], "query long, text string")
    some = index.scores(asked, 3, always=True)
    assert rows(R.ranked(some, 3)) == rows(R.bm25_topk(chunks, asked, 3))
    assert some.count() < index.scores(asked).count() / 4


def test_edge_cases(spark):
    t = "chunk long, text string"
    index = LexicalIndex(spark, shared_folder(spark), buckets=2)
    index.append(spark.createDataFrame([], t))
    asked = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "query long, text string")
    assert index.topk(asked).count() == 0
    index.append(spark.createDataFrame([(1, "a a b"), (2, None), (3, ""), (4, "b c"), (5, "c")], t))
    plain = spark.createDataFrame([(1, "a a b"), (2, None), (3, ""), (4, "b c"), (5, "c")], t)
    assert rows(index.topk(asked)) == rows(R.bm25_topk(plain, asked))


def test_only_postings_are_shuffled(index, chunks, queries):
    """Each segment gives the best of each query, so rows of queries and chunks don't grow with all pairs; blocks of queries change nothing."""
    from ledgerline.operators import lexical_index

    want = rows(R.bm25_topk(chunks, queries, 3))
    found = index.scores(queries, 3)
    assert rows(R.ranked(found, 3)) == want
    pairs = index.scores(queries).count()
    assert found.count() < pairs / 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(held" not in plan and "FlatMapGroupsInPandas" in plan
    block, lexical_index._BLOCK = lexical_index._BLOCK, 3
    try:
        seen = chunks.select(F.lit("all").alias("asker"), "chunk").unionByName(chunks.where("chunk % 50 = 1").select(F.lit("few").alias("asker"), "chunk"))
        assert rows(index.topk(queries, 3)) == want and rows(index.search(queries, seen, 4)) == rows(R.search(chunks, queries, seen, 4))
    finally:
        lexical_index._BLOCK = block
