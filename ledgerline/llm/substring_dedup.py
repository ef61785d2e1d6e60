"""Substring dedup by prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of one text.  Words covered by a
window that also starts in a row with a smaller ``doc_id`` are removed;
windows are judged on the input.

How it runs:

1. Suffixes are sampled at *anchors*: in each window the leftmost smallest
   hash of ``prefix`` consecutive words.  Equal windows have equal anchors at
   equal offsets, so no repeat of a window's length is missed, and about one
   suffix in sixteen is kept.
2. The anchor's ``prefix`` words are the first prefix by which suffixes are
   split into groups.  Groups whose suffixes all stand in one document hold no
   shared node and go.  Suffixes with equal contexts (a leaf with many
   occurrences, as exact copies make) collapse to one in the smallest document
   by a map-side aggregate, so a hot group costs a row for each task.  What is
   found for that one holds for the context's other places in that document.
3. Prefixes have variable length: while a group holds more than ``group_limit``
   contexts, its windows are halved by where they start before the anchor.
   The windows of a half share more words (those from its last start to its
   first end), and these are the longer prefix by which the group's contexts
   are split again.  A half of a single start has the whole window as prefix
   and is one node, which an aggregate answers.
4. A group that fits is built as a suffix tree in memory (sorted suffixes,
   their common prefix lengths, and the same for the reversed left contexts).
   A window's node is the pair (left node at its offset, right node at the
   rest of its length); the node's smallest document decides.

Defined cases: null or wordless text gives 0 words and the hash of the empty
string; texts under ``window`` words lose nothing; rows with a null
``doc_id`` keep everything and match nothing; rows that share a doc_id don't
match each other and each gives a row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import _text as X
from ledgerline.llm._work import groups_for, join_skewed, release, row_key, stored

_ANCHORS = "prefix_hash long, lead int, width int, span long, row_key long, doc_id long, first int"


def _anchor_batches(window: int, prefix: int):
    reach = window - prefix + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in X.blocks(batch.column("text")):
                starts, ends, at = X.word_spans(data, offsets, X.SPACE_WORDS)
                if len(starts) < window:
                    continue
                words = X.word_hashes(data, starts, ends)
                sums = X.run_sums(words)
                n = len(words) - prefix + 1
                grams = X.run_hash(sums, np.arange(n), np.arange(n) + prefix)
                # position of the leftmost smallest gram in each window, by doubling
                best, have = np.arange(n), 1
                while have < reach:
                    step = min(have, reach - have)
                    left, right = best[: len(best) - step], best[step:]
                    best = np.where(grams[left] <= grams[right], left, right)
                    have += step
                text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
                valid = np.flatnonzero(text_of[: len(words) - window + 1] == text_of[window - 1 :])
                if not len(valid):
                    continue
                anchor = best[valid]
                new = np.ones(len(valid), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
                begin = np.flatnonzero(new)
                first = valid[begin]
                last = valid[np.append(begin[1:], len(valid)) - 1]
                pos, text = anchor[begin], text_of[first]
                yield pa.record_batch(
                    {
                        "prefix_hash": pa.array(grams[pos].view(np.int64)),
                        "lead": pa.array((pos - first).astype(np.int32)),
                        "width": pa.array((last - first + 1).astype(np.int32)),
                        "span": pa.array(X.run_hash(sums, first, last + window).view(np.int64)),
                        "row_key": pa.array(keys[lo + text]),
                        "doc_id": pa.array(ids[lo + text].astype(np.int64)),
                        "first": pa.array((first - at[text]).astype(np.int32)),
                    }
                )

    return scan


_CONTEXT = "key long, lo int, hi int, lead int, width int, codes binary, row_key long, doc_id long, first int, origin int"


def _context_batch(rows: dict[str, list]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in _CONTEXT.split(", ")]
    return pa.record_batch({name: pa.array(rows[name], types[kind]) for name, kind in fields})


def _contexts(window: int, prefix: int):
    """Word codes around the asked anchors, with all starts that a window has before one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked").to_pylist()
            keys, ids = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in X.blocks(batch.column("text")):
                starts, ends, at = X.word_spans(data, offsets, X.SPACE_WORDS)
                words = X.word_hashes(data, starts, ends)
                rows: dict[str, list] = {f.split()[0]: [] for f in _CONTEXT.split(", ")}
                for i in range(lo, hi):
                    for x in asked[i]:
                        a = int(at[i - lo]) + x["first"]
                        codes = words[a : a + x["width"] - 1 + window]
                        for c, v in zip(rows, (x["prefix_hash"], 0, window - prefix, x["lead"], x["width"], codes.tobytes(), keys[i], ids[i], x["first"], x["first"]), strict=True):
                            rows[c].append(v)
                if rows["key"]:
                    yield _context_batch(rows)

    return scan


def _lengthen(window: int):
    """Halves the starts [lo, hi] of a group's windows; each half gets its longer prefix as key.

    A context's windows start lead - width + 1 to lead words before its anchor.
    A half with one start has the whole window as its key.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {f.split()[0]: [] for f in _CONTEXT.split(", ")}
            for r in batch.to_pylist():
                words, anchor = np.frombuffer(r["codes"], np.uint64), r["lead"]
                sums = X.run_sums(words)
                middle = (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], middle), (middle + 1, r["hi"])):
                    most, least = min(hi, anchor), max(lo, anchor - r["width"] + 1)
                    if least > most or lo > hi:
                        continue
                    key = X.mix(X.run_hash(sums, np.array([anchor - lo]), np.array([anchor + window - hi])) + np.uint64(lo * window + hi + 1))
                    skip = anchor - most
                    codes = words[skip : anchor - least + window]
                    for c, v in zip(rows, (int(key.view(np.int64)[0]), lo, hi, most, most - least + 1, codes.tobytes(), r["row_key"], r["doc_id"], r["first"] + skip, r["origin"]), strict=True):
                        rows[c].append(v)
            if rows["key"]:
                yield _context_batch(rows)

    return scan


def suffix_order(codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (rows of ``codes``) in order within their groups, and each
    one's common prefix length with the one before (-1 at a group's start):
    the leaves of the groups' suffix trees and the depths of the nodes between."""
    keyed = np.column_stack([group.astype(np.uint64), codes]).astype(">u8")
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1] * 8}").ravel(), kind="stable")
    sorted_codes, g = codes[order], group[order]
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        same = sorted_codes[1:] == sorted_codes[:-1]
        length = np.where(same.all(1), codes.shape[1], np.argmin(same, axis=1))
        common[1:] = np.where(g[1:] == g[:-1], length, -1)
    return order, common


def _node_ids(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the number of the node that it hangs below at ``depth``."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _trees(window: int, prefix: int):
    reach = window - prefix

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        group = np.unique(pdf["key"].to_numpy(), return_inverse=True)[1]
        lead, width, doc = (pdf[c].to_numpy(np.int64) for c in ("lead", "width", "doc_id"))
        left, right = np.zeros((n, reach), np.uint64), np.zeros((n, window), np.uint64)
        for i, raw in enumerate(pdf["codes"]):
            words = np.frombuffer(raw, np.uint64)
            left[i, : lead[i]] = words[: lead[i]][::-1]
            right[i, : len(words) - lead[i]] = words[lead[i] :]
        left_tree, right_tree = suffix_order(left, group), suffix_order(right, group)
        hit = np.zeros((n, reach + 1), bool)
        for lead_words in range(reach + 1):
            # the window that starts lead_words before the anchor
            use = np.flatnonzero((lead >= lead_words) & (lead - lead_words < width))
            if not len(use):
                continue
            a = _node_ids(*left_tree, lead_words)[use]
            b = _node_ids(*right_tree, window - lead_words)[use]
            node = np.unique(a * (n + 1) + b, return_inverse=True)[1]
            least = np.full(node.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, node, doc[use])
            hit[use, lead[use] - lead_words] = least[node] < doc[use]
        row, start, length = _runs(hit)
        first = pdf["first"].to_numpy()[row]
        return pd.DataFrame({"row_key": pdf["row_key"].to_numpy()[row], "origin": pdf["origin"].to_numpy()[row], "start": first + start, "n": length})

    return build


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, length) of the runs of true cells."""
    wide = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
    wide[:, 1:-1] = hit
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    return row, start, np.nonzero(step == -1)[1] - start


def repeated_windows(docs: DataFrame, window: int = 50, prefix: int = 18, group_limit: int = 4096, per_task: int = 8_000) -> DataFrame:
    """(row_key, start, n): runs of windows that also start in a smaller doc_id.

    ``row_key`` is :func:`ledgerline.llm._work.row_key` of ``doc_id, text``;
    ``group_limit`` contexts are built as one tree in memory.
    """
    rows = docs.select("doc_id", "text", row_key().alias("row_key")).where("doc_id is not null and text is not null")
    anchors = stored(rows.mapInArrow(_anchor_batches(window, prefix), _ANCHORS), "anchors")
    leaf = ["prefix_hash", "lead", "width", "span"]
    contexts = anchors.groupBy(*leaf).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(F.struct("doc_id", "row_key", "first")).alias("at"), F.count("*").alias("places"))
    contexts = stored(contexts, "contexts")
    prefixes = contexts.groupBy("prefix_hash").agg(F.min("least").alias("p_least"), F.max("most").alias("p_most"), F.count("*").alias("n_contexts")).where("p_least < p_most")
    again = contexts.where("places > 1").select(*leaf, "least", "places", F.col("at.row_key").alias("at_key"), F.col("at.first").alias("at_first"))
    # a context that a third of all documents share is joined apart
    again = join_skewed(anchors, again, leaf, size="places").where("doc_id > least or row_key <> at_key or first <> at_first")
    again = stored(again.select("row_key", "first", "width", (F.col("doc_id") > F.col("least")).alias("copy"), "at_key", "at_first"), "again")
    whole = again.where("copy").select("row_key", F.col("first").alias("start"), F.col("width").alias("n"))
    several = stored(prefixes.where("n_contexts > 1").select("prefix_hash", "n_contexts"), "prefixes")
    asked = join_skewed(contexts, several, ["prefix_hash"], size="n_contexts").select("at.row_key", F.struct("prefix_hash", "lead", "width", F.col("at.first").alias("first")).alias("x"))
    asked = asked.groupBy("row_key").agg(F.collect_list("x").alias("asked"))
    # repeated equal rows give equal answers, so one of them is asked
    texts = rows.join(asked.hint("shuffle_merge"), "row_key").select("row_key", "doc_id", "text", "asked")
    groups = stored(texts.mapInArrow(_contexts(window, prefix), _CONTEXT), "suffixes")
    release(anchors, contexts)
    hits, nodes, large = [], [], None
    while True:
        sizes = groups.groupBy("key").agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > group_limit).select("key", "n", F.lit(True).alias("large")), "large")
        none = large.isEmpty()
        marked = groups.withColumn("large", F.lit(None).cast("boolean")) if none else stored(join_skewed(groups, large, ["key"], "left", size="n").drop("n"), "marked")
        fits = marked.where("large is null").drop("large")
        tasks = groups_for(fits.count(), per_task)
        trees = fits.withColumn("part", F.expr(f"pmod(key, {tasks})")).groupBy("part").applyInPandas(_tree_task(window, prefix), "row_key long, origin int, start int, n int")
        hits.append(stored(trees, "hits"))
        if none:
            break
        longer = stored(marked.where("large").drop("large").mapInArrow(_lengthen(window), _CONTEXT), "suffixes")
        release(marked)
        # a single start is a node: its smallest document decides
        nodes.append(longer.where("lo = hi").select("key", "row_key", "origin", "doc_id", F.col("first").alias("start")))
        groups = longer.where("lo < hi")
    for node in nodes:
        shared = node.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("key", "least", F.col("n").alias("size"))
        hits.append(stored(join_skewed(node, stored(shared, "shared"), ["key"], size="size").where("doc_id > least").select("row_key", "origin", "start", F.lit(1).alias("n")), "hits"))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    # the asked place's hits, moved to the context's other places in the smallest document; equal rows count once
    others = again.where("not copy").select("at_key", "at_first", F.col("row_key").alias("to_key"), F.col("first").alias("to_first")).distinct()
    asked_hits = found.distinct().select(F.col("row_key").alias("at_key"), F.col("origin").alias("at_first"), (F.col("start") - F.col("origin")).alias("skip"), "n")
    moved = others.join(asked_hits.hint("shuffle_merge"), ["at_key", "at_first"]).select(F.col("to_key").alias("row_key"), (F.col("to_first") + F.col("skip")).alias("start"), "n")
    return whole.unionByName(found.drop("origin")).unionByName(moved)


def _tree_task(window: int, prefix: int):
    build = _trees(window, prefix)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        return build(pdf.drop(columns="part"))

    return task


def _removal(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            n_words, removed, kept, text_out = [], [], [], []
            for lo, hi, data, offsets in X.blocks(batch.column("text")):
                starts, ends, at = X.word_spans(data, offsets, X.SPACE_WORDS)
                raw = data.tobytes()
                for i in range(lo, hi):
                    a, b = int(at[i - lo]), int(at[i - lo + 1])
                    drop = np.zeros(b - a + 1, np.int32)
                    for r in runs[i] or ():
                        drop[r["start"]] += 1
                        drop[r["start"] + r["n"] - 1 + window] -= 1
                    stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0) + a
                    line = b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
                    n_words.append(b - a)
                    removed.append(b - a - len(stay))
                    kept.append(hashlib.sha256(line).hexdigest())
                    text_out.append(line.decode("utf-8", "replace"))
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string()), "kept": pa.array(text_out, pa.string())}
            )

    return scan


def remove_repeats(docs: DataFrame, window: int = 50, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of ``docs``.

    ``kept`` is the text that stays: kept words joined by one space.
    """
    runs = repeated_windows(docs, window, **options).groupBy("row_key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    rows = docs.select("doc_id", "text", row_key().alias("row_key")).join(runs.hint("shuffle_merge"), "row_key", "left")
    return rows.select("doc_id", "text", "runs").mapInArrow(_removal(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
