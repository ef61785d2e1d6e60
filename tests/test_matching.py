"""Blocks, edits, alignment and quotes against plain difflib, also over whole tables."""

import difflib
import random
import re
import time

from pyspark.sql import functions as F

from ledgerline.operators import documents, matching, retrieval
from ledgerline.plans import catalog, document_queries, log_queries


def ratio(a, b):
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def opcodes(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def edited(rng, items, kinds, times):
    out = list(items)
    for _ in range(times):
        at = rng.randint(0, len(out))
        if rng.random() < 0.5 and at < len(out):
            del out[at]
        else:
            out.insert(at, rng.choice(kinds))
    return out


def test_blocks_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(300):
        kinds = "abcdefghij"[: rng.choice([1, 2, 4, 10])] + "ä"
        a = [rng.choice(kinds) for _ in range(rng.randint(0, 150))]
        b = edited(rng, a, kinds, rng.randint(0, 40)) if rng.random() < 0.7 else [rng.choice(kinds) for _ in range(rng.randint(0, 90))]
        a, b = "".join(a), "".join(b)
        assert matching.similarity(a, b) == ratio(a, b)
        assert matching.edits(matching.letters(a), matching.letters(b)) == opcodes(a, b)


def test_long_texts():
    """20,000 words with 1,500 changes: the words put together give both texts again."""
    rng = random.Random(6)
    kinds = [f"w{i}" for i in range(3000)]
    a = [rng.choice(kinds) for _ in range(20_000)]
    b = edited(rng, a, kinds, 1500)
    began = time.perf_counter()
    got = matching.word_edits(" ".join(a), " ".join(b))
    assert time.perf_counter() - began < 10
    assert "".join(x["old"] for x in got) == " ".join(a) and "".join(x["new"] for x in got) == " ".join(b)
    assert matching.word_edits(None, "") == [] and matching.word_edits("", "x") == [{"op": "insert", "old": "", "new": "x"}]


def test_whole_tables_against_difflib(spark, sf_dir):
    """h9, h10: every pair of sections."""
    pairs = {(r["source_id"], r["path"]): (r["old"], r["new"]) for r in document_queries._pairs(spark, sf_dir).collect()}
    alike = {(r["source_id"], r["path"]): r["similarity"] for r in catalog.QUERIES["h10_similarity"](spark, sf_dir).collect()}
    assert alike.keys() == pairs.keys() and all(alike[k] == round(ratio(a or "", b or ""), 6) for k, (a, b) in pairs.items())
    words: dict = {}
    for r in catalog.QUERIES["h9_word_diff"](spark, sf_dir).collect():
        words.setdefault((r["source_id"], r["path"]), {})[r["place"]] = (r["op"], r["old"], r["new"])
    for k, (a, b) in pairs.items():
        if a == b:
            continue
        old, new = ([t for t in re.split(r"(\s+)", s or "") if t] for s in (a, b))
        want = [(op, "".join(old[i:j]), "".join(new[x:y])) for op, i, j, x, y in opcodes(old, new)]
        assert [x for _, x in sorted(words.get(k, {}).items())] == want


def plain_alignment(old, new, rename_at=0.5):
    """One document's sections, all pairs of a gap compared."""
    norm = lambda s: " ".join(s["path"].lower().split())
    rows = []

    def pair(x, y):
        same = x["text"] == y["text"] and x["heading"].lower().split() == y["heading"].lower().split()
        rows.append((x["section_no"], y["section_no"], "UNCHANGED" if same else "MODIFIED", 1.0 if same else ratio(x["text"], y["text"])))

    for op, i, j, k, n in opcodes([norm(s) for s in old], [norm(s) for s in new]):
        if op == "equal":
            for x, y in zip(old[i:j], new[k:n], strict=True):
                pair(x, y)
            continue
        ys = list(new[k:n])
        for x in old[i:j]:
            scores = [ratio(x["text"], y["text"]) for y in ys]
            best = max(range(len(scores)), key=scores.__getitem__, default=None)
            if best is not None and scores[best] >= rename_at:
                pair(x, ys.pop(best))
            else:
                rows.append((x["section_no"], None, "REMOVED", None))
        rows += [(None, y["section_no"], "ADDED", None) for y in ys]
    return rows


def test_alignment_of_the_whole_table(spark, sf_dir):
    old, new = document_queries.versions(spark, sf_dir)
    got: dict = {}
    for r in documents.align_sections(old, new).collect():
        got.setdefault(r["source_id"], set()).add((r["old_no"], r["new_no"], r["change"], r["similarity"]))
    a, b = ({} for _ in range(2))
    for side, rows in ((a, old.collect()), (b, new.collect())):
        for r in sorted(rows, key=lambda r: r["section_no"]):
            side.setdefault(r["source_id"], []).append(r.asDict())
    assert got == {k: set(plain_alignment(a.get(k, []), b.get(k, []))) for k in a.keys() | b.keys()}


def test_alignment_of_a_large_document(spark):
    """10,000 sections on each side, 2,000 of them renamed in one gap, and new ones between."""
    n = 10_000
    word = lambda i: F.md5(F.concat(F.lit("x"), i.cast("string")))
    base = spark.range(n).select(F.lit(1).cast("long").alias("source_id"), F.col("id").alias("section_no"), F.concat(F.lit("H"), "id").alias("heading"), F.concat(F.lit("p"), "id").alias("path"), F.concat(word(F.col("id")), F.lit(" says "), word(F.col("id") + 7)).alias("text"))
    moved = base.withColumn("path", F.when(F.col("section_no").between(4000, 5999), F.concat(F.lit("q"), "path")).otherwise(F.col("path"))).withColumn("text", F.when(F.col("section_no") % 2 == 0, F.concat("text", F.lit(" now"))).otherwise(F.col("text")))
    got = documents.align_sections(base, moved).collect()
    assert len(got) == n and all(r["old_no"] == r["new_no"] and r["change"] == ("MODIFIED" if r["old_no"] % 2 == 0 or False else "UNCHANGED") for r in got)


def test_alignment_edge_cases(spark):
    t = "source_id long, section_no long, heading string, path string, text string"
    some = spark.createDataFrame([(1, 0, "A", "A", ""), (1, 1, "A", "A", "")], t)
    none = spark.createDataFrame([], t)
    assert documents.align_sections(none, none).count() == 0
    assert sorted(r["change"] for r in documents.align_sections(some, none).collect()) == ["REMOVED", "REMOVED"]
    assert [(r["old_no"], r["new_no"], r["change"]) for r in documents.align_sections(some, some).orderBy("old_no").collect()] == [(0, 0, "UNCHANGED"), (1, 1, "UNCHANGED")]


def test_quotes_of_the_whole_table(spark, sf_dir):
    def plain(q, s):
        if not q or q in s:
            return 1.0
        m = difflib.SequenceMatcher(None, q, s, autojunk=False).find_longest_match()
        return ratio(q, s[m.b : m.b + max(m.size, len(q))])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    seen = []
    real = retrieval.citation_check

    def spy(cites, evidence):
        seen.append(cites.join(evidence, "evidence_id", "left").select("doc_id", flat(F.col("quote")).alias("q"), flat(F.col("text")).alias("s")))
        return real(cites, evidence)

    retrieval.citation_check = spy
    try:
        got = {r["doc_id"]: r for r in log_queries.d16(spark, sf_dir).collect()}
    finally:
        retrieval.citation_check = real
    rows = seen[0].collect()
    assert len(rows) == len(got) == docs.count()
    for r in rows:
        want = None if r["q"] is None or r["s"] is None else round(plain(r["q"], r["s"]), 6)
        assert got[r["doc_id"]]["similarity"] == want
    assert {r["issue"] for r in got.values()} >= {None, "UNKNOWN_EVIDENCE_ID", "NUMBER_MISMATCH", "QUOTE_NOT_FOUND"}
    began = time.perf_counter()
    assert matching.quoted("lorem ipsum dolor sit amet " * 4 + "x", "abc def ghi " * 100_000 + "lorem ipsum dolor sit amet " * 4 + "y") > 0.98
    assert time.perf_counter() - began < 20


def test_few_changes_take_few_comparisons(monkeypatch):
    """a block takes one comparison of all stretches, mostly, not one for each bit of its length."""
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(2000)]
    new = [*words[:500], "changed", *words[500:900], *words[910:1500], "changed", *words[1500:]]
    seen = []
    real = matching._Rolling.of
    monkeypatch.setattr(matching._Rolling, "of", lambda *a: seen.append(a) or real(*a))
    assert matching.similarity(" ".join(words), " ".join(new)) == 2 * len(" ".join(w for i, w in enumerate(words) if not 900 <= i < 910)) / len(" ".join(words) + " ".join(new))
    a, b = matching.numbered(words, new)
    assert [(op, i, j, k, n) for op, i, j, k, n in matching.edits(a, b) if op != "equal"] == [("insert", 500, 500, 500, 501), ("delete", 900, 910, 901, 901), ("insert", 1500, 1500, 1491, 1492)]
    assert len(seen) <= 40


def test_blocks_of_repeating_texts():
    """Runs of stretches that occur, but at other places than side by side."""
    rng = random.Random(9)
    for _ in range(200):
        bits = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))) for _ in range(4)]
        a, b = ("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert matching.edits(matching.letters(a), matching.letters(b)) == opcodes(a, b)


def test_equal_texts_do_not_reach_python(spark, monkeypatch):
    """only unlike texts are sent."""
    t = spark.createDataFrame([(1, "a b", "a b"), (2, "a b", "a c"), (3, None, None), (4, "", ""), (5, None, "x")], "id int, a string, b string")
    for df in (t.select(documents.text_similarity(F.col("a"), F.col("b")).alias("x")), t.select(documents.word_diff(F.col("a"), F.col("b")).alias("x"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"CASE WHEN NOT \(a#\d+ <=> b#\d+\) THEN a#\d+", plan)
    assert [r[0] for r in t.orderBy("id").select(documents.text_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, ratio("a b", "a c"), 1.0, 1.0, 0.0]
    got = [[(x["op"], x["old"], x["new"]) for x in r[0]] for r in t.orderBy("id").select(documents.word_diff(F.col("a"), F.col("b"))).collect()]
    assert got == [[("equal", "a b", "a b")], [("equal", "a ", "a "), ("replace", "b", "c")], [], [], [("insert", "", "x")]]


def test_unlike_texts_are_left_early(monkeypatch):
    """what can't reach the best likeness so far isn't compared to the end."""
    rng = random.Random(10)
    texts = [" ".join("".join(rng.choice("aeinrst") for _ in range(5)) for _ in range(150)) for _ in range(6)]
    text = texts[3] + " changed"
    scores = [ratio(text, t) for t in texts]
    for least in (0.0, 0.3, *scores):
        assert [matching.similarity(text, t, least) for t in texts] == [x if x >= least else 0.0 for x in scores]
    seen = []
    real = matching.Pair.longest
    monkeypatch.setattr(matching.Pair, "longest", lambda *a: seen.append(a) or real(*a))
    assert matching.Likeness(texts).take(text, 0.5) == (3, scores[3])
    assert len(seen) < 60


def test_alignment_is_not_one_python_group_for_each_document(spark, sf_dir):
    """documents and gaps are rows of one batch."""
    plan = documents.align_sections(*document_queries.versions(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "ArrowEvalPython" in plan


def test_block_types_by_first_sign(spark):
    lines = ["Phần I chung", "phần x", "chương 3", "MỤC 2", "Điều 5 x", "điều 6", "1. Lương", "1.2 Lương", "12 đồng", "1. đồng", "- x", "• x", "* x", "a) x", "1) x", "Phong", "x Điều 5", "1234. x", "", " 1. x"]
    want = ["heading"] * 8 + ["paragraph"] + ["list_item"] * 6 + ["paragraph"] * 2 + ["list_item"] + ["paragraph"] * 2
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string").orderBy("id").select(documents.block_type(F.col("line")))
    assert [r[0] for r in df.collect()] == want
