"""Licence scanning with DataFrame operations only.

Every line of every text is a possible header.  Lines and templates are sparse
TF-IDF vectors of lower-cased words; document frequencies are counted over
all texts for the templates' words, and other words weigh as a word of one
text.  A line is compared only if it holds one of a template's heavy words: the
fewest heaviest words without which no cosine can reach the threshold
(Cauchy-Schwarz), so nothing is lost.

A notice may also wrap over lines or stand in a long line: a run of as many
words as a template has, in which one of the template's rarest words stands at
its place in the template, is a possible header of the line where it starts (a
run that would leave the text is moved inside).

Whole texts are compared with whole licences in the same way.  A text must hold
one of a licence's rarest words, without which, again, the cosine is too low.

A document that is at least ``file_threshold`` like a whole licence, or whose
matched lines and runs hold at least ``file_share`` of its words, is its
directory's licence file; a whole licence goes before headers.  Documents without a licence of their own inherit
from the nearest ancestor directory that has one, by joins on path prefixes.
Directories, not documents, walk up, so a directory with a third of all
documents is one row there.

Defined cases: null or empty text has no header and may inherit; ties go to
the higher score, then the earlier line, then the licence's name; repeated
rows each give a row; a null path has no ancestors; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm._work import stored
from ledgerline.llm.license_texts import TEXTS

#: Fixed short notices of common licences.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}

_SPLIT = r"[^a-z0-9]+"
SALTS = 32


def _terms(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT, -1), lambda w: w != "")


def document_frequencies(docs: DataFrame, templates: dict[str, tuple[str, ...]]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those that hold each template word (a bounded list)."""
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in _terms(t)})
    there = F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), _SPLIT, -1), F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.select(F.explode(F.array_append(there, "")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    return counts.pop("", 0), {w: counts.get(w, 0) for w in vocabulary}


def rare_words(vectors: list[dict[str, float]], df: dict[str, int], threshold: float) -> list[list[str]]:
    """The rarest words of each vector, without which cosine < threshold; those in no text needn't be looked for."""
    out = []
    for v in vectors:
        rest, bound, words = sum(x * x for x in v.values()), threshold**2 * sum(x * x for x in v.values()) - 1e-9, []
        for w in sorted(v, key=lambda w: (df[w], -v[w], w)):
            if rest < bound:
                break
            if df[w]:
                words.append(w)
            rest -= v[w] ** 2
        out.append(words)
    return out


def heavy_words(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """The heaviest words of each vector, without which cosine < threshold."""
    out: set[str] = set()
    for v in vectors:
        rest, bound = sum(x * x for x in v.values()), threshold**2 * sum(x * x for x in v.values())
        for w, x in sorted(v.items(), key=lambda i: (-i[1], i[0])):
            if rest < bound:
                break
            out.add(w)
            rest -= x * x
    return sorted(out)


class _Model:
    """Weights of templates, and of their words in texts."""

    def __init__(self, templates: dict[str, tuple[str, ...]], n_docs: int, df: dict[str, int]):
        self.names = [(name, i, _terms(text)) for name, texts in templates.items() for i, text in enumerate(texts)]
        self.df = df
        self.idf = {w: math.log((1 + n_docs) / (1 + df[w])) + 1 for _, _, terms in self.names for w in terms}
        self.other = math.log((1 + n_docs) / 2) + 1
        self.vectors = [{w: n * self.idf[w] for w, n in Counter(terms).items()} for _, _, terms in self.names]


def _holding(words: list[str]) -> str:
    return r"(^|[^a-z0-9])(" + "|".join(words) + r")([^a-z0-9]|$)"


def _scored(units: DataFrame, by: list[str], model: _Model, threshold: float) -> DataFrame:
    """(by, license, score) of those ``units (by, words)`` that are at least that similar to a template."""
    spark = units.sparkSession
    rows = []
    for (name, i, _), v in zip(model.names, model.vectors, strict=True):
        norm = math.sqrt(sum(x * x for x in v.values()))
        rows += [(name, i, w, x / norm) for w, x in v.items()]
    weights = F.broadcast(spark.createDataFrame(rows, "license string, variant int, w string, weight double"))  # as many rows as the templates have words
    idfs = F.broadcast(spark.createDataFrame(list(model.idf.items()), "w string, idf double"))
    counted = units.select(*by, F.explode("words").alias("w")).groupBy(*by, "w").agg(F.count("*").alias("tf"))
    # repeated rows multiply tf alike in a line, which leaves the cosine as it is
    squared = counted.join(idfs, "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(model.other)))
    norms = squared.groupBy(*by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("w", "x"))).alias("terms"))
    dots = norms.select(*by, "norm", F.explode("terms").alias("t")).select(*by, "norm", "t.w", "t.x").join(weights, "w")
    scored = dots.groupBy(*by, "norm", "license", "variant").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    return scored.select(*by, "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold).groupBy(*by, "license").agg(F.max("score").alias("score"))


def headers(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.6, model: _Model | None = None) -> DataFrame:
    """(row_key, pos, n_words, license, score): lines at least that similar to a template."""
    model = model or _Model(templates, *document_frequencies(docs, templates))
    heavy = _holding(heavy_words(model.vectors, threshold))
    held = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.lower(x).alias("line"))), lambda s: s["line"].rlike(heavy))
    # key and lines are made below the explode: above it, the whole text would be hashed for each line
    keyed = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("row_key"), held.alias("held"))
    lines = keyed.select("row_key", F.explode("held").alias("s"))
    # repeated equal rows share a key and need one answer
    some = lines.select("row_key", "s.pos", words_of(F.col("s.line")).alias("words"))
    return _scored(some.withColumn("n_words", F.size("words")), ["row_key", "pos", "n_words"], model, threshold)


def header_runs(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.6, model: _Model | None = None) -> DataFrame:
    """(row_key, start, at, license, score): runs of words at least that similar to a template.

    ``at`` is the line of each of the run's words, ``start`` the first one's number in the text.
    """
    model = model or _Model(templates, *document_frequencies(docs, templates))
    rare = rare_words(model.vectors, model.df, threshold)
    places = {(w, i, len(terms)) for (_, _, terms), words in zip(model.names, rare, strict=True) for i, w in enumerate(terms) if w in set(words)}
    reach = max((n for _, _, n in places), default=1)
    some = sorted({w for w, _, _ in places})
    if not some:
        return docs.sparkSession.createDataFrame([], "row_key long, start int, at array<int>, license string, score double")
    offsets = F.broadcast(docs.sparkSession.createDataFrame(sorted(places), "w string, place int, length int"))
    word = F.flatten(F.transform(F.split(F.lower("text"), "\n", -1), lambda x, i: F.transform(words_of(x), lambda w: F.struct(w.alias("w"), i.alias("line")))))
    texts = docs.where("text is not null").where(F.lower("text").rlike(_holding(some))).select(F.xxhash64("doc_id", "text").alias("row_key"), word.alias("words"))
    here = F.filter(F.transform("words", lambda x, i: F.when(x["w"].isin(some), i)), lambda i: i.isNotNull())
    near = F.transform(here, lambda i: F.struct(i.alias("i"), F.greatest(i - reach, F.lit(0)).alias("base"), F.slice(F.col("words"), F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("words")))
    cut = texts.select("row_key", F.size("words").alias("size"), near.alias("near"))  # so that no row carries all words of its text
    found = cut.select("row_key", "size", F.explode("near").alias("x")).select("row_key", "size", "x.*").withColumn("w", F.expr("words[i - base].w")).join(offsets, "w")
    start = F.greatest(F.least(F.col("i") - F.col("place"), F.col("size") - F.col("length")), F.lit(0))
    runs = found.withColumn("start", start).withColumn("run", F.expr("slice(words, start - base + 1, length)"))
    return _scored(runs.select("row_key", "start", F.col("run.line").alias("at"), F.col("run.w").alias("words")), ["row_key", "start", "at"], model, threshold)


def whole_licenses(docs: DataFrame, texts: dict[str, str] = TEXTS, threshold: float = 0.8, model: _Model | None = None) -> DataFrame:
    """(row_key, license, score): texts at least that similar to a whole licence."""
    templates = {name: (text,) for name, text in texts.items()}
    model = model or _Model(templates, *document_frequencies(docs, templates))
    rare = sorted({w for words in rare_words(model.vectors, model.df, threshold) for w in words})
    if not rare:
        return docs.sparkSession.createDataFrame([], "row_key long, license string, score double")
    some = docs.where("text is not null").where(F.arrays_overlap(F.split(F.lower("text"), _SPLIT, -1), F.array(*[F.lit(w) for w in rare])))
    return _scored(some.select(F.xxhash64("doc_id", "text").alias("row_key"), words_of(F.col("text")).alias("words")), ["row_key"], model, threshold)


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.6, file_share: float = 0.5, texts: dict[str, str] = TEXTS, file_threshold: float = 0.8) -> DataFrame:
    """(doc_id, path, license, score, line, inherited, inherited_from) of ``files (doc_id, path, text)``."""
    docs = files.select("doc_id", "path", "text")
    wholes = {name: (text,) for name, text in texts.items()}
    n_docs, df = document_frequencies(docs, {"headers": tuple(t for x in templates.values() for t in x), "files": tuple(texts.values())})
    short = _Model(templates, n_docs, df)
    lines = stored(headers(docs, templates, threshold, short), "headers")
    runs = stored(header_runs(docs, templates, threshold, short), "runs")
    whole = whole_licenses(docs, texts, file_threshold, _Model(wholes, n_docs, df)).select("row_key", F.lit(0).alias("pos"), "license", "score", F.lit(True).alias("whole"))
    found = lines.select("row_key", "pos", "license", "score").unionByName(runs.select("row_key", F.col("at")[0].alias("pos"), "license", "score")).withColumn("whole", F.lit(False)).unionByName(whole)
    best = Window.partitionBy("row_key").orderBy(F.desc("whole"), F.desc("score"), "pos", "license")
    # words of matched lines, and of runs outside these lines
    matched = lines.groupBy("row_key", "pos").agg(F.max("n_words").alias("n"))
    outside = runs.select("row_key", "start", F.posexplode("at").alias("nth", "pos")).select("row_key", (F.col("start") + F.col("nth")).alias("i"), "pos").distinct()
    outside = outside.join(matched.select("row_key", "pos").hint("shuffle_merge"), ["row_key", "pos"], "left_anti").select("row_key", F.lit(1).alias("n"))
    per_row = matched.select("row_key", "n").unionByName(outside).groupBy("row_key").agg(F.sum("n").alias("header_words"))
    own = found.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("row_key", "license", "score", F.col("pos").alias("line"), "whole").join(per_row.hint("shuffle_merge"), "row_key", "left")
    slim = docs.select("doc_id", "path", F.xxhash64("doc_id", "text").alias("row_key"), directory_of(F.col("path")).alias("dir"), F.size(words_of(F.coalesce("text", F.lit("")))).alias("n_words"))
    known = stored(slim.join(stored(own, "own").hint("shuffle_merge"), "row_key", "left"), "known")
    files_of = known.where((F.col("license").isNotNull()) & (F.col("whole") | (F.col("header_words") >= file_share * F.col("n_words"))))
    licensed = files_of.groupBy("dir").agg(F.min(F.struct((~F.col("whole")).alias("headers"), (-F.col("score")).alias("s"), "path", "license")).alias("x")).select(F.col("dir").alias("ancestor"), F.col("x.license").alias("inherited"))
    parts = F.split("dir", "/")
    up = known.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("ancestor"))
    # the root is an ancestor of all, and one directory may hold a third of all documents: both joins are salted
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = up.withColumn("salt", F.pmod(F.xxhash64("dir"), F.lit(SALTS)).cast("int"))
    nearest = dealt.join(licensed.select("*", salts).hint("shuffle_merge"), ["ancestor", "salt"]).groupBy("dir").agg(F.max_by(F.struct("inherited", "ancestor"), F.length("ancestor")).alias("x")).select("dir", "x.inherited", F.col("x.ancestor").alias("inherited_from"))
    known = known.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int"))
    out = known.join(stored(nearest, "nearest").select("*", salts).hint("shuffle_merge"), ["dir", "salt"], "left")
    none = F.col("license").isNotNull()
    return out.select("doc_id", "path", "license", "score", "line", F.when(~none, F.col("inherited")).alias("inherited"), F.when(~none, F.col("inherited_from")).alias("inherited_from"))
