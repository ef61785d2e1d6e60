"""Language identification by string kernels.

The kernel is the blended spectrum of presence: texts are compared by the
byte n-grams of 1 to ``max_n`` bytes (lower-cased ASCII) that occur in both,
k(x, z) = |x and z| / sqrt(|x| |z|), n-grams being hashed into ``buckets``.
Nystroem landmarks (training texts, evenly many of each language) turn it
into a feature map, on which one-versus-rest kernel ridge regression is fitted
in closed form.  Scoring is two matrix products for a batch of texts.

Fitting uses a bounded sample: at most ``per_language`` labelled texts of each
language, those with the smallest hash of the document id, of the
``max_languages`` most frequent languages (ties by name); the driver gets their
presence bits (``buckets`` / 8 bytes each), never their texts.
Every text is scored whole.

Defined cases: null text or one without a letter is ``und`` with score 0;
with no labelled text at all everything is ``und``; of languages with equal
scores the first by name is taken; repeated rows are scored alike; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import _text as X

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[0x41:0x5B] += 0x20
BLOCK_TEXTS = 128
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Spectrum:
    """The hashed n-grams of a text."""

    max_n: int = 4
    log2_buckets: int = 14

    @property
    def buckets(self) -> int:
        return 1 << self.log2_buckets

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of 0/1 for each text of a block."""
        n, out = len(offsets) - 1, np.zeros((len(offsets) - 1) << self.log2_buckets, np.float32)
        code = _LOWER[data]
        row = np.repeat(np.arange(n, dtype=np.int32) << self.log2_buckets, np.diff(offsets))
        ends = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
        gram = code.astype(np.uint32)
        for size in range(1, self.max_n + 1):
            if size > 1:
                gram = gram[:-1] * np.uint32(257) + code[size - 1 :]
            if not len(gram):
                break
            place = ((gram * np.uint32(0x9E3779B1 + 2 * size)) >> np.uint32(32 - self.log2_buckets)).astype(np.int32) + row[: len(gram)]
            out[place if size == 1 else place[ends[: len(gram)] >= size]] = 1
        return out.reshape(n, -1)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for lo, hi, data, offsets in X.blocks(texts, BLOCK_BYTES):
            for a in range(0, hi - lo, BLOCK_TEXTS):
                b = min(a + BLOCK_TEXTS, hi - lo)
                yield lo + a, lo + b, self.presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@dataclass(frozen=True)
class Model:
    """Landmarks and weights; ``buckets`` x ``landmarks`` numbers at most."""

    spectrum: Spectrum
    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def scores(self, presence: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1))
        return (presence @ self.landmarks / size) @ self.weights + self.offset


def fit(labelled: DataFrame, per_language: int = 400, landmarks: int = 160, ridge: float = 1e-3, max_languages: int = 256, spectrum: Spectrum = Spectrum()) -> Model | None:  # noqa: B008
    """Fits on ``labelled (doc_id, text, lang)``; null languages and texts don't count."""
    fine = labelled.where("lang is not null and text is not null and length(text) > 0").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in fine.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return None
    # a first cut by the hash leaves about 1.5 x per_language rows, however many there are
    place = F.xxhash64(F.col("doc_id").cast("string")) / 2.0**64 + 0.5
    cut = F.coalesce(*[F.when(F.col("lang") == name, F.lit(1.5 * per_language / n + 50 / n)) for name, n in counts.items()])
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", F.xxhash64("text"))
    sample = fine.where(place < cut).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("lang", "nth", "text")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for _, _, p in spectrum.batches(batch.column("text")) for r in np.packbits(p.astype(bool), axis=1)]
            yield pa.record_batch({"lang": batch.column("lang"), "nth": batch.column("nth"), "bits": pa.array(rows, pa.binary())})

    got = sorted(sample.mapInArrow(bits, "lang string, nth int, bits binary").collect(), key=lambda r: (r["lang"], r["nth"]))
    if not got:
        return None
    languages = tuple(sorted({r["lang"] for r in got}))
    x = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    y = np.array([[1.0 if r["lang"] == name else 0.0 for name in languages] for r in got])
    weight = 1 / np.maximum(y.sum(0), 1)
    each = max(1, landmarks // len(languages))
    chosen = [i for i, r in enumerate(got) if r["nth"] <= each]
    marks = (x[chosen] / np.sqrt(np.maximum(x[chosen].sum(1, keepdims=True), 1))).T
    kernel = x @ marks / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    kernel = kernel.astype(np.float64)
    # Nystroem: features K_xm K_mm^(-1/2)
    value, vector = np.linalg.eigh(kernel[chosen])
    root = vector[:, value > 1e-6 * value.max()] / np.sqrt(value[value > 1e-6 * value.max()])
    phi = kernel @ root
    row_weight = (y * weight).sum(1, keepdims=True)
    row_weight /= row_weight.sum()
    mean, y_mean = (phi * row_weight).sum(0), (y * row_weight).sum(0)
    centred = phi - mean
    gram = (centred * row_weight).T @ centred
    solved = np.linalg.solve(gram + ridge * max(np.trace(gram) / len(gram), 1e-9) * np.eye(len(gram)), (centred * row_weight).T @ (y - y_mean))
    return Model(spectrum, languages, np.ascontiguousarray(marks.astype(np.float32)), (root @ solved).astype(np.float32), (y_mean - mean @ solved).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, lang_pred and score for each row of ``docs``."""
    kept = docs.select(*carry)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column("text")
            n = len(texts)
            lang, score = np.full(n, "und", object), np.zeros(n)
            if m is not None:
                names = np.array(m.languages, object)
                for lo, hi, presence in m.spectrum.batches(texts):
                    s = m.scores(presence)
                    best = s.argmax(1)
                    lang[lo:hi] = names[best]
                    score[lo:hi] = np.clip(s[np.arange(hi - lo), best], 0, 1)
            none = ~np.asarray(batch.column("__letter"), bool)
            lang[none], score[none] = "und", 0.0
            yield pa.record_batch({c: batch.column(c) for c in carry} | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    letter = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("__letter")
    return docs.select(*dict.fromkeys([*carry, "text"]), letter).mapInArrow(scan, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The quarter of ids that no model is fitted on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fits on the labelled rows that aren't held out, then predicts every row."""
    model = fit(docs.where(~held_out()), **options)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
