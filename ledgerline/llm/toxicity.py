"""Toxicity of texts, read through a noisy channel.

What is written may be a disguise of what is meant: leetspeak (``m0r0n``),
letters set apart (``m o r o n``) or repeated (``morooon``).  A character
language model of order 4 is counted over all documents; a lattice of readings
is laid over each disguised stretch, and the Viterbi path, by that model and
the channel's costs, is the restored text.  Elsewhere the lattice has one path,
so nothing is decoded.

The restored text is scored by a logistic regression over the presence of words
and of word beginnings of 3 to 6 bytes.  Labels come from a sample of at most
``per_class`` documents of each class (those with the smallest hash of their
id); its features and their counts are gathered in Spark, and the driver gets
the ``max_features`` that mark toxic documents best and the rows of the sample
reduced to them.  Every text is restored and scored whole.

Defined cases: null text is empty and scores as a text without any mark; of
repeated ids in the labels the larger label counts, null labels and ids never;
repeated rows of a document are scored alike, and one of them can be learned
from; without labels, or with one class only, the score is the share of toxic
labels (0 without any); an empty table gives no rows; extra columns are
ignored; a word of over ``LONGEST`` characters is left as written, since the
channel has no such words; stretches of single letters are decoded in parts of
``STRETCH`` characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import _text as X
from ledgerline.llm._work import doc_columns, stored

LONGEST, STRETCH = 40, 400
#: Readings of signs that stand for letters (fixed values of the channel).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
#: Log costs of the channel: a sign for a letter, a letter repeated, a gap between letters.
SIGN, REPEATED, GAP = -1.0, -2.0, -0.3
#: Symbols of the language model: word border, a-z, other letter, digit or sign.
BORDER, OTHER, DIGIT, SYMBOLS = 0, 27, 28, 29
_CACHE = 1 << 17

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[0x41:0x5B] = _SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0xC0:] = OTHER
_SYMBOL[[*range(0x30, 0x3A), ord("@"), ord("$")]] = DIGIT
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " ._*-"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WORD = _LETTER.copy()
_WORD[0x80:] = True
#: A stretch of single letters or signs, and a word that may hold signs.
_APART = re.compile(rb"(?:[A-Za-z0-9@$!|+][ ._*\-])+[A-Za-z0-9@$](?![A-Za-z0-9@$\x80-\xff])")
_RUN = re.compile(rb"(?:[A-Za-z0-9@$\x80-\xff]|[!|+](?=[A-Za-z0-9]))+")
_EDGE = re.compile(rb"[A-Za-z0-9@$!|+\x80-\xff]+$")


# --- the language model


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's 4-grams of symbols; what stands before a word border counts as borders."""
    total = np.zeros(SYMBOLS**4, np.int64)
    for batch in batches:
        for _, _, data, offsets in X.blocks(batch.column("text")):
            s = np.insert(_SYMBOL[data], offsets[:-1], 0)
            s = s[~np.insert(_TAIL[data], offsets[:-1], False)]
            s = np.concatenate([np.zeros(3, np.uint8), s, np.zeros(1, np.uint8)]).astype(np.int32)
            one = s[2:-1]
            two = np.where(one > 0, s[1:-2], 0)
            three = np.where(two > 0, s[:-3], 0)
            here = s[3:]
            real = (here > 0) | (one > 0)
            code = ((three * SYMBOLS + two) * SYMBOLS + one) * SYMBOLS + here
            total += np.bincount(code[real], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.record_batch({"gram": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})


def language_model(docs: DataFrame, strength: float = 4.0) -> np.ndarray:
    """log P(symbol | three before it), from all texts; at most ``SYMBOLS ** 4`` counts come back."""
    counts = doc_columns(docs, "text").where("text is not null").mapInArrow(_grams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SYMBOLS**4)
    n[counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
    n = n.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        seen = n.sum(axes) if axes else n
        p = (seen + strength * p) / (seen.sum(-1, keepdims=True) + strength)
    return np.log(p).astype(np.float32)


# --- the channel


def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return OTHER if c.isalpha() else DIGIT if c.isdigit() or c in "@$" else BORDER


class Channel:
    """Restores stretches of text by the Viterbi path through their readings."""

    def __init__(self, model: np.ndarray):
        self.logs = model.reshape(-1, SYMBOLS)
        self.rows: dict[int, list[float]] = {}
        self.told: dict[bytes, bytes] = {}

    def _row(self, context: int) -> list[float]:
        row = self.rows.get(context)
        if row is None:
            row = self.rows[context] = self.logs[context].tolist()
        return row

    def readings(self, text: str, apart: bool) -> list[list[tuple[int, str, float]]]:
        """The lattice: for each place the arcs (next place, what is meant, cost)."""
        out: list[list[tuple[int, str, float]]] = []
        for i, c in enumerate(text):
            arcs = [(i + 1, c, 0.0)]
            if apart and c in " ._*-":
                arcs.append((i + 1, "", GAP))
            arcs += [(i + 1, x, SIGN) for x in LEET.get(c, "")]
            if "a" <= c <= "z" and (not i or text[i - 1] != c):
                end = i + 1
                while end < len(text) and text[end] == c:
                    end += 1
                if end - i > 2:
                    arcs += [(end, c, REPEATED), (end, c + c, REPEATED)]
            out.append(arcs)
        return out

    def decode(self, text: str, apart: bool = False) -> str:
        """The likeliest meaning of ``text``, a word or a stretch of single letters in lower case."""
        lattice, wrap = self.readings(text, apart), SYMBOLS**2
        # at each place: context (three symbols) -> (score, (path so far, what came last))
        states: list[dict[int, tuple[float, tuple | None]]] = [{} for _ in range(len(text) + 1)]
        states[0][0] = (0.0, None)
        for i, arcs in enumerate(lattice):
            for context, (score, path) in states[i].items():
                for to, meant, cost in arcs:
                    at, total = context, score + cost
                    for c in meant:
                        s = _symbol(c)
                        if s or at % SYMBOLS:
                            total += self._row(at)[s]
                        at = at % wrap * SYMBOLS + s if s else 0
                    best = states[to].get(at)
                    if best is None or total > best[0]:
                        states[to][at] = (total, (path, meant) if meant else path)
            states[i] = {}
        last = max(((score + (self._row(at)[BORDER] if at % SYMBOLS else 0.0), path) for at, (score, path) in states[-1].items()), key=lambda x: x[0])[1]
        parts = []
        while last is not None:
            last, meant = last
            parts.append(meant)
        return "".join(reversed(parts))

    def meant(self, raw: bytes, apart: bool) -> bytes:
        got = self.told.get(raw)
        if got is None:
            got = self.decode(raw.decode("utf-8", "replace").lower(), apart).encode()
            if len(self.told) >= _CACHE:
                self.told.clear()
            self.told[raw] = got
        return got

    def restore(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of a block of texts after restoring."""
        if len(data) < 3:
            return data, offsets
        low, letter, sign = _LOWER[data], _LETTER[data], _SIGN[data]
        spot = np.zeros(len(data), bool)
        spot[:-1] |= letter[:-1] & sign[1:] | sign[:-1] & letter[1:]
        spot[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
        # four single letters or signs with a gap after each of the first three
        one, gap = letter | sign, _GAP[data]
        n = len(data) - 6
        if n > 0:
            apart = one[:n] & gap[1 : n + 1] & one[2 : n + 2] & gap[3 : n + 3] & one[4 : n + 4] & gap[5 : n + 5] & one[6 : n + 6]
            spot[:n] |= apart
        spots = np.flatnonzero(spot)
        if not len(spots):
            return data, offsets
        raw, parts, done = data.tobytes(), [], 0
        moved, i = np.zeros(len(offsets), np.int64), 0
        while i < len(spots):
            at = int(spots[i])
            row, i = int(np.searchsorted(offsets, at, "right")), i + 1
            end = int(offsets[row])
            before = _EDGE.search(raw, max(done, int(offsets[row - 1]), at - 4 * LONGEST), at)
            start = before.start() if before else at
            found, single = _APART.match(raw, at, end) if start == at else None, True
            if found is None or found.end() - at < 7:
                found, single = _RUN.match(raw, start, end), False
                if found is None:
                    continue
            a, b = found.span()
            old = raw[a:b]
            if b - a > 4 * LONGEST and not single or not single and len(old.decode("utf-8", "replace")) > LONGEST or not any(65 <= c < 128 and chr(c).isalpha() for c in old):
                new = old
            elif single:
                new = b"".join(self.meant(old[i : i + STRETCH], True) for i in range(0, len(old), STRETCH))
            else:
                new = self.meant(old, False)
            parts += [raw[done:a], new]
            moved[row:] += len(new) - len(old)
            done = b
            i = max(i, int(np.searchsorted(spots, done)))
        parts.append(raw[done:])
        return np.frombuffer(b"".join(parts), np.uint8), offsets + moved


# --- features and score


def _marks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of the words of a block, then of their beginnings of 3 to 6 bytes."""
    starts, ends, first = X.word_spans(data, offsets, _WORD)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for size in (0, 3, 4, 5, 6):
        some = ends - starts > size
        begin = starts[some]
        yield row[some], X.mix(X.word_hashes(data, begin, begin + size if size else ends[some], lower=True) + np.uint64(size))


@dataclass(frozen=True)
class Model:
    """Language model, marks (sorted keys with a weight each) and the base score."""

    logs: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    base: float
    fixed: bool = False

    def found(self, data: np.ndarray, offsets: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, mark) pairs of a block; ``near`` is :meth:`table`."""
        rows, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, keys in _marks(data, offsets):
            some = np.flatnonzero(near[(keys >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, keys[some]), max(0, len(self.keys) - 1))
            hit = self.keys[at] == keys[some] if len(self.keys) else np.zeros(len(some), bool)
            rows.append(row[some][hit])
            marks.append(at[hit])
        pairs = np.unique(np.concatenate(rows) * max(1, len(self.keys)) + np.concatenate(marks))
        return np.divmod(pairs, max(1, len(self.keys)))

    def table(self) -> np.ndarray:
        near = np.zeros(1 << 20, bool)
        near[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        return near


def _learned(size: int, rows: np.ndarray, marks: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and base of a logistic regression on present marks, by full gradients with adaptive steps."""
    w = np.zeros(size + 1)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(rows, w[marks], len(y))
        miss = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.append(np.bincount(marks, miss[rows], size) + ridge * w[:-1], miss.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, max_features: int = 4096, least: int = 5, odds: float = 8.0) -> Model:
    """The model from all texts of ``docs`` and the labels ``(doc_id, toxic)`` of a bounded sample."""
    logs = language_model(docs)
    told = doc_columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = stored(told, "labels")
    counts = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(0, np.uint64)
    if len(counts) < 2:
        return Model(logs, none, np.zeros(0), float(counts.get(1, 0) > 0), True)
    # a first cut by the hash leaves about 1.5 x per_class rows of a class, however many there are
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    cut = F.coalesce(*[F.when(F.col("toxic") == c, F.lit(1.5 * per_class / n + 50 / n)) for c, n in counts.items()])
    ranked = told.where(hashed / 2.0**64 + 0.5 < cut).withColumn("nth", F.row_number().over(Window.partitionBy("toxic").orderBy(hashed, "doc_id")))
    chosen = F.broadcast(ranked.where(F.col("nth") <= per_class).select("doc_id", "toxic", "nth"))  # 2 x per_class rows
    texts = doc_columns(docs, "doc_id", "text").join(chosen, "doc_id").groupBy("toxic", "nth").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = stored(texts, "sample")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(logs)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(sent.value)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for lo, _, data, offsets in X.blocks(batch.column("text")):
                data, offsets = channel.restore(data, offsets)
                for row, keys in _marks(data, offsets):
                    # each mark once a text, then counted over the block
                    order = np.lexsort((row, keys))
                    row, keys = row[order], keys[order]
                    once = np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])][: len(keys)]
                    row, keys = row[once], keys[once]
                    some, at = np.unique(keys, return_inverse=True)
                    is_toxic = toxic[lo + row]
                    yield pa.record_batch({"key": pa.array(some.view(np.int64)), "bad": pa.array(np.bincount(at, is_toxic, len(some)).astype(np.int64)), "fine": pa.array(np.bincount(at, 1 - is_toxic, len(some)).astype(np.int64))})

    had = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(had) < 2:
        return Model(logs, none, np.zeros(0), counts[1] / sum(counts.values()), True)
    marks = sample.mapInArrow(gathered, "key long, bad long, fine long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    rate = (F.col("bad") + 0.5) / (had[1] + 1) / ((F.col("fine") + 0.5) / (had[0] + 1))
    best = marks.where((F.col("bad") >= least) & (rate >= odds)).orderBy((F.col("bad") * F.log(rate)).desc(), "key").limit(max_features)
    keys = np.sort(np.array([r["key"] for r in best.select("key").collect()], np.int64).view(np.uint64))
    blank = spark.sparkContext.broadcast(Model(logs, keys, np.zeros(len(keys)), 0.0))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = blank.value
        channel, near = Channel(model.logs), model.table()
        for batch in batches:
            for lo, hi, data, offsets in X.blocks(batch.column("text")):
                row, mark = model.found(*channel.restore(data, offsets), near)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.record_batch({"toxic": batch.column("toxic").slice(lo, hi - lo), "nth": batch.column("nth").slice(lo, hi - lo), "marks": pa.ListArray.from_arrays(pa.array(cuts), pa.array(mark.astype(np.int32)))})

    rows = sorted(sample.mapInArrow(reduced, "toxic int, nth int, marks array<int>").collect(), key=lambda r: (r["toxic"], r["nth"]))
    y = np.array([r["toxic"] for r in rows], float)
    weight = np.array([counts[c] / had[c] for c in (0, 1)])[y.astype(int)]
    at = np.repeat(np.arange(len(rows)), [len(r["marks"]) for r in rows])
    got = np.array([m for r in rows for m in r["marks"]], np.int64)
    weights, base = _learned(len(keys), at, got, y, weight / weight.sum())
    return Model(logs, keys, weights, base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``docs (doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SYMBOLS and max_features

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        channel, near = Channel(model.logs), model.table()
        for batch in batches:
            out = np.full(batch.num_rows, model.base)
            if not model.fixed:
                for lo, hi, data, offsets in X.blocks(batch.column("text")):
                    row, mark = model.found(*channel.restore(data, offsets), near)
                    out[lo:hi] += np.bincount(row, model.weights[mark], hi - lo)
                out = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(out)})

    rows = doc_columns(docs, "doc_id", "text")
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of ids whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, fitted on the labels that aren't held out."""
    model = fit(docs, labels.where(~held_out()), **options)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
