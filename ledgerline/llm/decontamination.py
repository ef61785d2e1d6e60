"""Benchmark decontamination by a distributed positional inverted index.

The index is split by document: each segment holds whole texts and is one row
``(segment, keys, doc_ids, doc_starts, terms, term_starts, positions)`` of the stored
table.  ``terms`` are word hashes in order, ``positions`` each term's places
in the segment's word sequence (texts are set apart by a gap, so no phrase
crosses them).  A segment grows with ``BLOCK`` or its longest text only, and no
posting is shuffled: a phrase lives in one document, hence in one segment.

A query block (a bounded number of benchmark words) is answered per segment:
for each phrase the positions of its rarest term, shifted to the phrase's
start, are intersected with the shifted lists of the next rarest ones until
all agree.  How rare a term is comes from the index's own counts over the whole
corpus.  Terms of no query block needn't be indexed: ``vocabulary`` prunes the
postings of training tokens while the index is written.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined cases: null text has no words; an item of fewer words than a phrase is
one phrase; items without words match nothing; repeated items with one id
count once; items with a null id hit, count as one item and are not named among
the ids; repeated documents each give a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import _text as X
from ledgerline.llm._work import row_key, stored

_INDEX = "segment string, keys binary, doc_ids array<long>, doc_starts binary, doc_words binary, terms binary, term_starts binary, positions binary"
SEGMENT_BYTES = 1 << 23


def _segments(gap: int, vocabulary: np.ndarray | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row_key").to_numpy()
            for lo, hi, _, _ in X.blocks(batch.column("text"), SEGMENT_BYTES):
                found_words, found_at, starts_at, n_words, base = [], [], [], [], 0
                for a, b, data, offsets in X.blocks(batch.column("text").slice(lo, hi - lo)):
                    starts, ends, at = X.word_spans(data, offsets, X.ALNUM_WORDS)
                    words = X.word_hashes(data, starts, ends, lower=True)
                    count = np.diff(at)
                    place = np.arange(len(words)) + gap * np.repeat(np.arange(b - a), count) + base
                    starts_at.append(at[:-1] + gap * np.arange(b - a) + base)
                    n_words.append(count)
                    base += len(words) + gap * (b - a)
                    if vocabulary is not None:
                        slot = np.searchsorted(vocabulary, words)
                        slot[slot == len(vocabulary)] = 0
                        use = vocabulary[slot] == words if len(vocabulary) else np.zeros(len(words), bool)
                        words, place = words[use], place[use]
                    found_words.append(words)
                    found_at.append(place)
                words, place = np.concatenate(found_words), np.concatenate(found_at)
                order = np.argsort(words, kind="stable")
                terms, begin = np.unique(words[order], return_index=True)
                yield pa.record_batch(
                    {
                        "segment": pa.array([f"{int(keys[lo]):x}-{lo}"]),
                        "keys": pa.array([keys[lo:hi].astype(np.int64).tobytes()], pa.binary()),
                        "doc_ids": pa.array([ids[lo:hi]], pa.list_(pa.int64())),
                        "doc_starts": pa.array([np.concatenate(starts_at).astype(np.int64).tobytes()], pa.binary()),
                        "doc_words": pa.array([np.concatenate(n_words).astype(np.int64).tobytes()], pa.binary()),
                        "terms": pa.array([terms.tobytes()], pa.binary()),
                        "term_starts": pa.array([np.append(begin, len(words)).astype(np.int64).tobytes()], pa.binary()),
                        "positions": pa.array([place[order].astype(np.int32 if base < 1 << 31 else np.int64).tobytes()], pa.binary()),
                    }
                )

    return scan


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, gap: int = 64) -> DataFrame:
    """The stored positional index of all texts of ``docs (doc_id, text)``."""
    rows = docs.select("doc_id", "text", row_key().alias("row_key"))
    return stored(rows.mapInArrow(_segments(gap, vocabulary), _INDEX), "postings")


class _Segment:
    """One row of the index, opened for look-ups."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.ids = row["doc_ids"]
        self.starts = np.frombuffer(row["doc_starts"], np.int64)
        self.n_words = np.frombuffer(row["doc_words"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.begin = np.frombuffer(row["term_starts"], np.int64)
        n = int(self.begin[-1]) if len(self.begin) else 0
        self.positions = np.frombuffer(row["positions"], np.int32 if len(row["positions"]) == 4 * n else np.int64)

    def postings(self, term: np.uint64) -> np.ndarray:
        i = int(np.searchsorted(self.terms, term))
        if i == len(self.terms) or self.terms[i] != term:
            return self.positions[:0]
        return self.positions[self.begin[i] : self.begin[i + 1]]

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def _common(small: np.ndarray, large: np.ndarray, shift: int) -> np.ndarray:
    """Those of ``small`` for which ``large`` holds the value plus ``shift``."""
    if not len(small) or not len(large):
        return small[:0]
    want = small + shift
    at = np.searchsorted(large, want)
    at[at == len(large)] = len(large) - 1
    return small[large[at] == want]


def phrase_starts(segment: _Segment, phrase: np.ndarray, rarity: dict[int, int]) -> np.ndarray:
    """Positions at which the phrase's words stand one after the other."""
    order = sorted(range(len(phrase)), key=lambda i: rarity.get(int(phrase[i]), 0))
    found = segment.postings(phrase[order[0]]).astype(np.int64) - order[0]
    for i in order[1:]:
        if not len(found):
            break
        found = _common(found, segment.postings(phrase[i]), i)
    return found


def proximity_starts(segment: _Segment, phrase: np.ndarray, rarity: dict[int, int], slop: int) -> np.ndarray:
    """Positions of the rarest term that have every other term within ``slop`` words."""
    order = sorted(range(len(phrase)), key=lambda i: rarity.get(int(phrase[i]), 0))
    found = segment.postings(phrase[order[0]]).astype(np.int64)
    for i in order[1:]:
        there = segment.postings(phrase[i])
        if not len(found) or not len(there):
            return found[:0]
        at = np.searchsorted(there, found - slop)
        near = at < len(there)
        near[near] = there[at[near]] <= found[near] + slop
        found = found[near]
    return found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in X.blocks(batch.column("text")):
            starts, ends, at = X.word_spans(data, offsets, X.ALNUM_WORDS)
            words = X.word_hashes(data, starts, ends, lower=True)
            yield pa.record_batch({"item_id": batch.column("item_id").slice(lo, hi - lo), "words": pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})


def _query_blocks(items: DataFrame, max_words: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items as word hashes, in blocks of at most ``max_words`` words or one item; a block is what the driver holds."""
    hashed = stored(items.select("item_id", "text").mapInArrow(_hashed, "item_id long, words binary"), "items")
    block, size = [], 0
    for row in hashed.toLocalIterator():
        words = np.frombuffer(row["words"], np.uint64)
        if size and size + len(words) > max_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    yield block


def _phrases(block: list[tuple[int | None, np.ndarray]], length: int) -> tuple[list[np.ndarray], list[list[int | None]]]:
    """Distinct phrases of a block and the items of each."""
    owners: dict[bytes, set[int | None]] = {}
    for item, words in block:
        for i in range(max(1, len(words) - length + 1) if len(words) else 0):
            owners.setdefault(words[i : i + length].tobytes(), set()).add(item)
    return [np.frombuffer(x, np.uint64) for x in owners], [_in_order(x) for x in owners.values()]


def _in_order(ids: set[int | None]) -> list[int | None]:
    return sorted(ids - {None}) + [None] * (None in ids)


def _answers(sent, slop: int | None):
    """``sent`` is the broadcast (phrases, owners, rarity, lead) of one block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, owners, rarity, lead = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                yield from _answer(_Segment(row), row["segment"], phrases, owners, rarity, lead, slop)

    return scan


def _leads(phrases: list[np.ndarray], rarity: dict[int, int]) -> np.ndarray:
    """Each phrase's rarest term."""
    return np.array([min(p.tolist(), key=lambda t: rarity.get(t, 0)) for p in phrases], np.uint64)


def _answer(s: _Segment, name: str, phrases: list[np.ndarray], owners: list[list[int | None]], rarity: dict[int, int], lead: np.ndarray, slop: int | None) -> Iterator[pa.RecordBatch]:
    cover = np.zeros(int(s.starts[-1] + s.n_words[-1]) + 2, np.int32)
    hits: dict[int, set[int | None]] = {}
    for k in np.flatnonzero(np.isin(lead, s.terms)):
        p = phrases[k]
        found = phrase_starts(s, p, rarity) if slop is None else proximity_starts(s, p, rarity, slop)
        if len(found):
            np.add.at(cover, found, 1)
            np.add.at(cover, found + (len(p) if slop is None else 1), -1)
            for t in np.unique(s.text_of(found)).tolist():
                hits.setdefault(t, set()).update(owners[k])
    hit = np.cumsum(cover[:-1]) > 0
    spans = []
    for t, (a, n) in enumerate(zip(s.starts.tolist(), s.n_words.tolist(), strict=True)):
        edge = np.diff(np.concatenate([[0], hit[a : a + n].astype(np.int8), [0]])) if t in hits else np.zeros(0)
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
    n = len(s.ids)
    yield pa.record_batch(
        {
            "place": pa.array([f"{name}-{t}" for t in range(n)]),
            "doc_id": pa.array(s.ids, pa.int64()),
            "row_key": pa.array(s.keys),
            "n_words": pa.array(s.n_words),
            "items": pa.array([_in_order(hits.get(t, set())) for t in range(n)], pa.list_(pa.int64())),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        }
    )


_ANSWER = "place string, doc_id long, row_key long, n_words long, items array<long>, spans array<struct<start:int,end:int>>"


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            s = _Segment(row)
            yield pa.record_batch({"term": pa.array(s.terms.view(np.int64)), "n": pa.array(np.diff(s.begin)[: len(s.terms)])})


def search(docs: DataFrame, items: DataFrame, length: int = 10, slop: int | None = None, max_block_words: int = 1_000_000) -> DataFrame:
    """One row per document: matched item ids and the word spans that they hit.

    Phrases are ``length`` consecutive item words and match exactly, or, with
    ``slop``, where all their words stand within that distance of the rarest
    one.  Items go in blocks of ``max_block_words`` words: that bounds what is
    sent to the executors, whatever the benchmark's size.
    """
    parts = []
    for block in _query_blocks(items, max_block_words):
        vocabulary = np.unique(np.concatenate([w for _, w in block])) if block else np.zeros(0, np.uint64)
        index = build_index(docs, vocabulary, gap=max(64, length + 1, (slop or 0) + 1))
        counts = index.select("keys", "doc_ids", "doc_starts", "doc_words", "terms", "term_starts", F.lit(b"").alias("positions")).mapInArrow(_term_counts, "term long, n long")
        # one count for each word of the block, so its size is bounded by the block
        rarity = {int(np.int64(r["term"]).view(np.uint64)): r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
        phrases, owners = _phrases(block, length)
        sent = docs.sparkSession.sparkContext.broadcast((phrases, owners, rarity, _leads(phrases, rarity)))  # bounded by the block
        parts.append(index.mapInArrow(_answers(sent, slop), _ANSWER))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # each block's index has the same rows; a document's answers meet by its key and, for repeats, their number
    return every.groupBy("row_key", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        (F.count("*") / len(parts)).cast("int").alias("copies"),
    ).select(F.concat_ws("-", "row_key").alias("place"), "doc_id", "row_key", "n_words", "items", F.transform("spans", lambda s: s).alias("spans"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def _n_hit(spans):
    """Words in the union of possibly overlapping spans."""
    merged = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
    )
    return merged["n"]


def contamination(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) per document."""
    found = search(docs, items, length).withColumn("n_hit", _n_hit(F.col("spans")))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )
