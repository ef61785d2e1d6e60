"""Stages of the pipeline on null and repeated ids."""

from collections import Counter

import pytest

pytest.importorskip("ledgerline.llm.registry")
import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(3)


def left(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def numbered(n, start):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_decontaminate_by_row(spark, tmp_path):
    passage, clean = numbered(12, 0), numbered(30, 500)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"a {passage} b"), (None, clean), (7, f"c {passage}"), (7, clean), (7, clean), (8, None), (None, None)]
    assert left(corpus_pipeline.decontaminate(spark, frame(spark, rows), str(tmp_path))) == Counter([(None, clean), (7, clean), (7, clean), (8, None), (None, None)])


def test_near_copies_by_row(spark):
    a, b, c = (numbered(80, 1000 * i) for i in range(1, 4))
    rows = [(None, a), (None, a), (None, b), (3, b), (3, f"{b} tail"), (3, b), (3, c), (9, c), (4, ""), (4, ""), (None, None)]
    got = left(corpus_pipeline.join_near_copies(spark, frame(spark, rows), ""))
    assert sum(got.values()) == 6 and got[(4, "")] == 2 and got[(None, None)] == 1
    assert got[(None, a)] == 1 and got[(3, c)] == 1 and got[(3, b)] + got[(3, f"{b} tail")] == 1


LINE = "a line of more than forty characters that many documents share"


def odd_rows():
    """Nulls in each column, empty, long and repeated texts, repeated ids."""
    return [(None, None), (None, "word " * 5000), (1, ""), (1, "The same letters"), (1, "The same letters"), (2, " \n\t"), (3, "12345 67890"), *[(i, f"{LINE}\nown {i}") for i in range(10, 17)], (None, f"{LINE}\nnone")]


def test_identify_by_row(spark):
    got = left(corpus_pipeline.identify(spark, frame(spark, odd_rows()), ""))
    assert got == Counter((i, t) for i, t in odd_rows() if t and any(x.isalpha() for x in t))


def test_dedup_lines_by_row(spark):
    got = left(corpus_pipeline.dedup_lines(spark, frame(spark, odd_rows()), ""))
    assert got == Counter((i, f"own {i}" if i is not None and 10 <= i < 16 else t) for i, t in odd_rows())


def test_mix_by_row(spark):
    rows = frame(spark, odd_rows())
    got = corpus_pipeline.mix_sources(spark, rows, "").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd_rows())
    assert sum(r["taken"] for r in got) == sum(r["size"] for r in got)  # one source takes all of its words


def test_stages_on_empty_and_wide_tables(spark, tmp_path):
    spark.createDataFrame([(1, LINE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = frame(spark, odd_rows()).selectExpr("*", "1 as row_key", "2 as key", "3 as keep", "4 as label", "5 as score")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, wide, str(tmp_path))
        assert out.count() >= 1 and (name == "mixing" or out.columns == list(corpus_pipeline.COLUMNS))
