"""Collocations: frequent phrases of words, mined by Toivonen's sampling.

Text is lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those
into words ``[^\\x20\\x09]+``; all counts are per language.

* A hashed sample of the documents is mined level by level with a lowered
  threshold.  What is frequent there is proposed, together with its negative
  border: phrases that are not frequent in the sample though both phrases of
  one word less in them are.
* One pass over all documents counts proposals and border exactly (and every
  word, since a word's border needs no parts).
* A border phrase that turns out frequent widens the border.  Further passes
  count what has been added and nothing twice, until a pass finds no failure;
  then every frequent phrase has been counted.

A phrase belongs to proposals or border exactly if its two parts are in the
proposals, so the border is a test made in each task and never listed.  The
test is a pair of bits in a filter of at most ``2 ** MAX_BITS`` bits for each
length; a filter that holds too much only lets more phrases be counted.  Tasks
count distinct phrases of what they read before anything is shuffled.

Phrases are counted by 64-bit hashes of language and words, then named by
their text from the sample and, for the rest, from all documents; first parts,
rests and longer phrases are joined by language and text.

Defined cases: null text is empty; null language is ``und``; repeated rows and
equal ids count each time; texts are read whole, however long; an empty table
gives no phrases; extra columns are ignored; ties of the ranking end with the
phrase, in the order of its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import _text as X
from ledgerline.llm._work import doc_columns, join_skewed, stored

MAX_BITS = 27
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CUTS = np.zeros(256, bool)
_CUTS[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_WORDS = ~_CUTS
_WORDS[[0x20, 0x09]] = False
#: Distinct keys that a task gathers before it hands them on.
_GATHER = 1 << 21
_LEVELS = 4


class Filter:
    """Two bits for each key of a set; other keys pass seldom."""

    def __init__(self, log2: int, words: np.ndarray | None = None):
        self.log2 = log2
        self.words = np.zeros(1 << (log2 - 6), np.uint64) if words is None else words

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for x in (keys, (keys << np.uint64(32)) | (keys >> np.uint64(32))):
            at = x >> np.uint64(64 - self.log2)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.log2, self.words | other.words)

    def covers(self, other: Filter) -> bool:
        return not (other.words & ~self.words).any()


def _log2(n: int) -> int:
    return min(MAX_BITS, max(16, (32 * n).bit_length()))


def filter_of(keys: DataFrame, log2: int) -> Filter:
    """The filter of ``keys (key)``, made by bit_or in Spark: at most 2 ** (log2 - 6) rows come back."""
    turned = F.shiftleft("key", 32).bitwiseOR(F.shiftrightunsigned("key", 32))
    both = keys.select(F.explode(F.array("key", turned)).alias("key"))
    at = F.shiftrightunsigned("key", 64 - log2)
    bits = both.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    got, out = bits.toArrow(), Filter(log2)
    out.words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


class Block:
    """The words of some whole texts: spans, pieces and keys of phrases."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = _LOWER[data]
        self.starts, self.ends, first = X.word_spans(self.data, offsets, _WORDS)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        cuts = np.cumsum(_CUTS[self.data]) if len(data) else np.zeros(0, np.int64)
        piece = cuts[self.starts] + self.row
        #: Words that the same piece still has from here on, up to ``_LEVELS``.
        self.room = np.ones(len(self.starts), np.int8)
        for k in range(1, _LEVELS):
            self.room[: max(0, len(piece) - k)] += piece[:-k] == piece[k:]
        self.sums = X.run_sums(X.word_hashes(self.data, self.starts, self.ends))
        self.lang = langs[self.row]

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        return X.mix(X.run_hash(self.sums, at, at + k) ^ self.lang[at])

    def words(self) -> pa.Array:
        held = self.data[_WORDS[self.data]]
        offsets = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        return pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(held.tobytes()))

    def grams(self, new: list[Filter], old: list[Filter] | None) -> Iterator[tuple[int, np.ndarray]]:
        """(k, keys) of the phrases of 2 to ``_LEVELS`` words whose parts pass ``new`` but not both ``old``."""
        at = np.arange(len(self.starts))
        for k in range(2, _LEVELS + 1):
            # places whose phrase of k - 1 words is proposed
            keys = self.keys(k - 1, at)
            ok = new[k - 2].has(keys)
            at, keys = at[ok], keys[ok]
            if not len(at):
                return
            both = np.zeros(len(at), bool)
            both[:-1] = at[1:] == at[:-1] + 1
            both &= self.room[at] >= k
            if old is None:
                fresh = both
            else:
                known = old[k - 2].has(keys)
                fresh = both.copy()
                fresh[:-1] &= ~(known[:-1] & known[1:])
            if fresh.any():
                yield k, self.keys(k, at[fresh])
            at = at[both]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    langs = batch.column("lang_key").to_numpy().view(np.uint64)
    for lo, hi, data, offsets in X.blocks(batch.column("text")):
        yield lo, Block(data, offsets, langs[lo:hi])


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce("lang", F.lit("und"))
    return doc_columns(docs, "text", "lang").where("text is not null").select("text", lang.alias("lang"), F.xxhash64(lang).alias("lang_key"))


_COUNTS = "level int, key long, n long, lang string, word string"


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class _Gathered:
    """Counts of a task, handed on when they are many and at its end."""

    def __init__(self) -> None:
        self.raw: dict[int, list[np.ndarray]] = {k: [] for k in range(2, _LEVELS + 1)}
        self.done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.words: list[pa.Table] = []
        self.size = self.n_words = 0

    def add(self, k: int, keys: np.ndarray) -> None:
        self.raw[k].append(keys)
        self.size += len(keys)

    def settle(self) -> None:
        for k, raw in self.raw.items():
            if raw:
                keys, n = np.unique(np.concatenate(raw), return_counts=True)
                self.done[k] = _merged([self.done[k], (keys, n)]) if k in self.done else (keys, n)
                raw.clear()
        if len(self.words) > 1:
            whole = pa.concat_tables(self.words).combine_chunks()
            keys, first, back = np.unique(whole.column("key").to_numpy(), return_index=True, return_inverse=True)
            n = np.bincount(back, whole.column("n").to_numpy(), len(keys)).astype(np.int64)
            self.words = [whole.take(pa.array(first)).set_column(1, "n", pa.array(n))]
        self.n_words = sum(t.num_rows for t in self.words)
        self.size = 0

    def full(self) -> bool:
        return self.n_words + sum(len(k) for k, _ in self.done.values()) > _GATHER

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        for k, (keys, n) in self.done.items():
            for i in range(0, len(keys), 1 << 18):
                part, m = keys[i : i + (1 << 18)], n[i : i + (1 << 18)]
                none = pa.nulls(len(part), pa.string())
                yield pa.record_batch([pa.array(np.full(len(part), k, np.int32)), pa.array(part.view(np.int64)), pa.array(m.astype(np.int64)), none, none], names=["level", "key", "n", "lang", "word"])
        for t in self.words:
            for b in t.to_batches(max_chunksize=1 << 16):
                yield pa.record_batch([pa.array(np.ones(b.num_rows, np.int32)), pa.array(b.column("key").to_numpy().view(np.int64)), b.column("n"), b.column("lang").cast(pa.string()), b.column("word").cast(pa.string())], names=["level", "key", "n", "lang", "word"])
        self.done, self.words, self.n_words = {}, [], 0


def count(texts: DataFrame, new: list[Filter], old: list[Filter] | None, words: bool) -> DataFrame:
    """(level, key, n, lang, word): exact counts of the phrases whose parts pass ``new`` but not ``old``.

    With ``words`` also all single words (level 1, with their text) and the
    number of words of each language (level 0).
    """
    sent = texts.sparkSession.sparkContext.broadcast((new, old))  # bounded by MAX_BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = sent.value
        got, totals = _Gathered(), {}
        for batch in batches:
            for lo, block in _blocks(batch):
                if words and len(block.starts):
                    keys, first, n = np.unique(block.keys(1, np.arange(len(block.starts))), return_index=True, return_counts=True)
                    at = pa.array(first)
                    lang = batch.column("lang").take(pa.array(lo + block.row[first]))
                    for name, m in zip(*(c.to_pylist() for c in pa.table({"lang": lang, "n": n}).group_by("lang").aggregate([("n", "sum")]).select(["lang", "n_sum"]).columns), strict=True):
                        totals[name] = totals.get(name, 0) + m
                    got.words.append(pa.table({"key": pa.array(keys), "n": pa.array(n.astype(np.int64)), "lang": lang.cast(pa.large_string()), "word": block.words().take(at)}))
                    got.size += len(keys)
                for k, keys in block.grams(new, old):
                    got.add(k, keys)
                if got.size > _GATHER:
                    got.settle()
                    if got.full():
                        yield from got.hand_on()
        got.settle()
        yield from got.hand_on()
        if totals:
            none = pa.nulls(len(totals), pa.string())
            yield pa.record_batch([pa.array(np.zeros(len(totals), np.int32)), pa.array(np.zeros(len(totals), np.int64)), pa.array(list(totals.values()), pa.int64()), pa.array(list(totals), pa.string()), none], names=["level", "key", "n", "lang", "word"])

    made = texts.mapInArrow(scan, _COUNTS)
    # tasks have counted already, so no second partial count before the shuffle
    return made.repartition("level", "key", "lang").groupBy("level", "key", "lang", "word").agg(F.sum("n").alias("n")).select("level", "key", "n", "lang", "word")


def _named(texts: DataFrame, wanted: list[Filter]) -> DataFrame:
    """(level, key, lang, phrase): the text of phrases that pass ``wanted``, once a task."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = sent.value, [np.zeros(0, np.uint64)] * (_LEVELS + 1)
        for batch in batches:
            for lo, block in _blocks(batch):
                text = None
                for k in range(2, _LEVELS + 1):
                    at = np.flatnonzero(block.room >= k)
                    keys = block.keys(k, at)
                    ok = wanted[k - 2].has(keys)
                    keys, first = np.unique(keys[ok], return_index=True)
                    at = at[ok][first]
                    fresh = ~np.isin(keys, seen[k], assume_unique=True)
                    keys, at = keys[fresh], at[fresh]
                    if not len(keys):
                        continue
                    # a phrase may be told again once the memory of a task is full
                    seen[k] = np.concatenate([seen[k], keys]) if len(seen[k]) < _GATHER // 4 else keys
                    text = block.words() if text is None else text
                    phrase = pc.binary_join_element_wise(*[text.take(pa.array(at + j)) for j in range(k)], pa.scalar(" ", pa.large_string()))
                    lang = batch.column("lang").take(pa.array(lo + block.row[at]))
                    yield pa.record_batch([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), lang.cast(pa.string()), phrase.cast(pa.string())], names=["level", "key", "lang", "phrase"])

    return texts.mapInArrow(scan, "level int, key long, lang string, phrase string").dropDuplicates(["level", "key"])


def frequent_phrases(docs: DataFrame, min_count: int = 30, sample_every: int = 8, watch: Callable[[int, DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of 1 to 4 words with f >= ``min_count``, (lang, n) of all words).

    ``watch`` is called with the number and the counts of each full pass.
    """
    texts = _texts(docs)
    sample = stored(_texts(docs.where(F.pmod(F.xxhash64("text"), F.lit(sample_every)) == 0)), "sample")
    expected = min_count / sample_every
    lowered = min(min_count, max(2, int(expected - expected**0.5)))
    none = [Filter(6) for _ in range(_LEVELS - 1)]
    new, old = list(none), None
    for k in range(1, _LEVELS):
        found = stored(count(sample, new, old, k == 1).where((F.col("level") == k) & (F.col("n") >= lowered)).select("key"), "proposed")
        new, old = list(new), list(new)
        new[k - 1] = filter_of(found, _log2(2 * found.count()))
    passes, old = [], None
    while True:
        counted = stored(count(texts, new, old, not passes).where((F.col("level") == 0) | (F.col("n") >= min_count)), "counted")
        passes.append(counted)
        if watch:
            watch(len(passes), counted)
        failed, wider = False, []
        for k in range(1, _LEVELS):
            found = filter_of(counted.where(F.col("level") == k).select("key"), new[k - 1].log2)
            failed |= not new[k - 1].covers(found)
            wider.append(new[k - 1] | found)
        if not failed:
            break
        old, new = new, wider
    counts = passes[0]
    for more in passes[1:]:
        counts = counts.unionByName(more)
    grams, names = counts.where("level > 1").select("level", "key", "n"), []
    rest = grams
    for part in (sample, texts):
        keys = stored(rest.select("level", "key"), "nameless")
        sizes = {r["level"]: r["n"] for r in keys.groupBy("level").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            break
        wanted = [filter_of(keys.where(F.col("level") == k).select("key"), _log2(sizes[k])) if k in sizes else Filter(6) for k in range(2, _LEVELS + 1)]
        names.append(stored(_named(part, wanted).join(keys.hint("shuffle_merge"), ["level", "key"], "left_semi"), "names"))
        rest = keys.join(names[-1].hint("shuffle_merge"), ["level", "key"], "left_anti")
    phrases = counts.where("level = 1").select("lang", F.col("word").alias("phrase"), F.col("level").alias("k"), F.col("n").alias("f"))
    for part in names:
        phrases = phrases.unionByName(part.join(grams.hint("shuffle_merge"), ["level", "key"]).select("lang", "phrase", F.col("level").alias("k"), F.col("n").alias("f")))
    return stored(phrases, "phrases"), counts.where("level = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, covered: int = 80, sample_every: int = 8) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    a = f(phrase).  A cut after k words has l = f(first part), r = f(rest) and
    scores floor(2,000,000 a / (l + r)); the lowest cut counts (ties: smallest
    k).  A phrase goes if a longer one around it has ``covered`` percent of its
    count.  Products are decimals of up to 38 digits.
    """
    phrases, totals = frequent_phrases(docs, min_count, sample_every)
    rows = phrases.where("k > 1").withColumn("w", F.split("phrase", " "))

    def piece(first: int, size: int):
        return F.array_join(F.slice("w", first, size), " ")

    cuts = [
        F.when(F.col("k") > c, F.struct(F.lit(c).alias("cut"), F.lit(side).alias("side"), (F.array_join(F.slice("w", F.lit(1), F.lit(c)), " ") if side == 0 else F.array_join(F.slice("w", F.lit(c + 1), F.greatest(F.col("k") - c, F.lit(0))), " ")).alias("part")))
        for c in range(1, _LEVELS) for side in (0, 1)
    ]
    parts = stored(rows.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array_compact(F.array(*cuts))).alias("p")).select("lang", "phrase", "a", "p.*"), "parts")
    known = phrases.select("lang", F.col("phrase").alias("part"), "f")
    # a frequent word is part of many phrases, so its key may be hot
    both = join_skewed(parts, known, ["lang", "part"], by=["phrase"])
    sides = [F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias(f"f{c}{s}") for c in range(1, _LEVELS) for s in (0, 1)]
    wide = both.groupBy("lang", "phrase", "a").agg(*sides)
    score = "CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(f{c}0 AS DECIMAL(19, 0)) + CAST(f{c}1 AS DECIMAL(19, 0)))"
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(f"f{c}0").isNotNull(), F.struct(F.expr(score.format(c=c)).alias("score"), F.lit(c).alias("cut"), F.col(f"f{c}0").alias("l"), F.col(f"f{c}1").alias("r"))) for c in range(1, _LEVELS)])))
    scored = wide.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    inner = F.array(*[piece(i, size) for size in (2, 3) for i in range(1, _LEVELS - size + 2)])
    shorter = F.when(F.col("k") == 3, F.array(piece(1, 2), piece(2, 2))).otherwise(inner)
    around = rows.where("k > 2").select("lang", "f", F.explode(shorter).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(around.hint("shuffle_merge"), ["lang", "phrase"], "left").where(f"longer IS NULL OR CAST(longer AS DECIMAL(19, 0)) * 100 < CAST(a AS DECIMAL(19, 0)) * {covered}").drop("longer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = salted.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals.hint("shuffle_merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
