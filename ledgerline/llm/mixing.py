"""Mixing sources to target weights by pivotal dependent rounding.

A source's target share gives each of its documents the same expected number
of copies; the fraction that remains after whole copies is a copy probability.
Pivotal rounding settles the largest fractional document against the next
smaller ones: its mass (in words) moves to or from them, in a direction drawn
so that every expectation is kept, until it is integral.  What one side gains
the other loses, so the words of a source don't move at all, and the documents
that stay fractional are the smallest ones.

It runs as a reduction tree: documents are dealt to leaf groups of their
source by a hash, each leaf leaves its ``LAST`` smallest fractional documents (and
what all smaller ones together could not settle), and the residuals of
``fan_in`` leaves meet, level by level, until each source has one node.  There
the rest is set to what brings the source's words nearest to its target, so a
source's last documents are chosen, not drawn.  All draws are hashes of the document and the seed:
reruns agree, and no task sees more than a leaf or ``fan_in`` residuals.

Defined cases: null text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; repeated rows are told apart by a number
within equal (source, doc_id, text); an empty table gives an empty result; if
all sources stand at their limit the rest of the share stays unused; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import _text as X
from ledgerline.llm._work import join_skewed, release, stored


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): words of ``[^\\x20\\x09-\\x0D]+`` in each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(X.word_spans(data, offsets, X.SPACE_WORDS)[2]) for _, _, data, offsets in X.blocks(batch.column("text"))]
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "size": pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)), "key": batch.column("key")}
            )

    return docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(scan, "doc_id long, source string, size long, key long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, their number from 0 in code point order, null last.

    Ranges of sources are numbered apart; a range starts at the number of
    sources in the ranges before it (one count for each range on the driver).
    """
    ranged = sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source")
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()), "ranged")
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, start = 0, []
    for name in sorted(sizes):
        start += [F.lit(name), F.lit(before)]
        before += sizes[name]
    within = F.row_number().over(Window.partitionBy("range").orderBy("last", "source")) - 1
    first = F.create_map(*start)[F.col("range")] if start else F.lit(0)
    return ranged.withColumn("place", within + first).drop("last", "range")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, rows, source_size, target) by water-filling, one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    all sizes; a target stops at ``cap`` times its source and the excess is
    shared anew by weight, until none is above.  A round is one aggregate over
    the sources, and only adds full ones.
    """
    total = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stored(numbered(total).withColumn("weight", weight), "weighed")
    limit, level, full = cap * F.col("source_size"), None, F.lit(False)
    while True:
        # the level of the round: what the full ones leave, for each unit of the others' weight
        r = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, limit)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if not r["weight"] or (level is not None and r["n"] == n_full):
            break
        level, n_full = (r["all"] - (r["full"] or 0.0)) / r["weight"], r["n"]
        full = limit <= F.lit(level) * F.col("weight")
    share = F.least(limit, F.lit(level) * F.col("weight")) if r["weight"] and level is not None else limit
    return weighed.select("source", "rows", "source_size", share.cast("double").alias("target"))


def _draw(key: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return X.mix(key.view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)).astype(np.float64) / 2.0**64


#: So many of a group's smallest fractional documents stay so; at the root their best subset is taken.
LAST = 14


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray, keep: int = LAST) -> np.ndarray:
    """Rounds ``p`` of documents in falling order of ``size``, all but the last ``keep``.

    In turn each fractional document (a, m) trades with the fractional ones
    after it: partner (b, n) takes part with t words, where up to (1 - a) t
    may leave it and a t may join it.  With probability a the document becomes
    1 and its partners give (1 - a) t each, else it becomes 0 and they get a t
    each.  Another document stays fractional only if all after it offer too little.
    """
    p, eps = p.copy(), 1e-9
    p[p < eps], p[p > 1 - eps] = 0.0, 1.0
    for i in range(len(p)):
        a, m = p[i], size[i]
        if not 0 < a < 1:
            continue
        if keep and ((p[i:] > 0) & (p[i:] < 1)).sum() <= keep:
            break
        at, chunk, need, got = i + 1, 32, m, []
        while need > 0 and at < len(p):
            j = np.arange(at, min(at + chunk, len(p)))
            at, chunk = at + chunk, 2 * chunk
            j = j[(p[j] > 0) & (p[j] < 1)]
            t = np.minimum(p[j] * size[j] / (1 - a), (1 - p[j]) * size[j] / a)
            before = np.cumsum(t) - t
            t = np.minimum(t, need - before)
            use = t > 0
            got.append((j[use], t[use]))
            need -= t[use].sum()
        if need > eps * m:
            continue
        for j, t in got:
            p[j] += (-(1 - a) if draws[i] < a else a) * t / size[j]
            p[j] = np.where(p[j] < eps, 0.0, np.where(p[j] > 1 - eps, 1.0, p[j]))
        p[i] = 1.0 if draws[i] < a else 0.0
    return p


def settle(p: np.ndarray, size: np.ndarray, last: int = LAST) -> np.ndarray:
    """Sets what is still fractional so that the fewest words are missing: from
    the largest down so that the words still due stay in the middle of what the
    smaller ones can make up, and the ``last`` ones by their best subset."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    due, after = float((p[left] * size[left]).sum()), float(size[left].sum())
    for i in left[:-last]:
        after -= size[i]
        p[i] = 1.0 if abs(due - size[i] - after / 2) < abs(due - after / 2) else 0.0
        due -= p[i] * size[i]
    few = left[-last:]
    subset = (np.arange(1 << len(few))[:, None] >> np.arange(len(few))) & 1
    p[few] = subset[np.argmin(np.abs(subset @ size[few] - due))]
    return p


def _round(level: int, seed: int):
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "nth"], ascending=[False, True, True], kind="stable")
        draws = _draw(pdf["key"].to_numpy(np.int64) + pdf["nth"].to_numpy(np.int64), seed * 64 + level)
        size = pdf["size"].to_numpy(np.float64)
        p = pivot(pdf["p"].to_numpy(np.float64), size, draws)
        return pdf.assign(p=settle(p, size) if pdf["slices"].iloc[0] == 1 else p).drop(columns="node")

    return task


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7, leaf: int = 1_000, fan_in: int = 64) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, key, nth) per row of ``docs``."""
    sizes = stored(sized(docs), "sizes")
    share = stored(targets(sizes, weights, cap), "targets")
    # equal rows are counted and differ by a number; a source's name is never null as a key
    named = sizes.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")).withColumns({"no_source": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    keyed = share.withColumns({"no_source": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    joined = join_skewed(stored(named, "rows"), keyed, ["source", "no_source"], size="rows").withColumn("source", F.when(~F.col("no_source"), F.col("source"))).drop("no_source")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("nth", F.col("nth").cast("long")).withColumn("rate", rate)
    slices = F.ceil(F.col("rows") / leaf).cast("long")
    whole = F.floor(F.col("rate") + 1e-9)
    p = F.when(F.col("size") > 0, F.greatest(F.col("rate") - whole, F.lit(0.0))).otherwise(0.0)
    schema = "doc_id long, source string, size long, key long, slices long, slice long, source_size long, target double, base long, nth long, p double"
    rows = rows.select("doc_id", "source", "size", "key", slices.alias("slices"), F.pmod(F.xxhash64("key", "nth"), slices).alias("slice"), "source_size", "target", whole.cast("long").alias("base"), "nth", p.alias("p"))
    level, open_rows, settled = 0, rows.withColumn("node", F.col("slice")), []
    while True:
        out = stored(open_rows.groupBy("source", "node").applyInPandas(_round(level, seed), schema), f"level{level}")
        up = out.where("p > 0 and p < 1")
        settled.append(out.where("not (p > 0 and p < 1)"))
        if up.isEmpty():
            break
        level = level + 1
        # the next level finds a residual below its new node
        slices = F.ceil(F.col("slices") / fan_in).cast("long")
        open_rows = up.withColumn("slices", slices).withColumn("slice", F.pmod("slice", "slices")).withColumn("node", F.col("slice"))
    release(sizes)
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("base") + F.round("p").cast("long")).otherwise(0)
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "key", "nth")
