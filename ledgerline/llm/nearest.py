"""Approximate nearest neighbours by learned partitions.

Fitting: a neighbour graph of a bounded sample (``fit_rows`` vectors) is cut
into balanced parts (votes of neighbours under a capacity), and a small softmax
classifier learns which parts a vector's neighbours lie in.  The number of
parts grows with the rows: one for about ``part_rows`` vectors.  Beyond
``fan_out`` parts there are two levels; the parts of the second level are
fitted in the same way within each part of the first, each on a bounded sample
of that part's rows and in a task of its own.  At most ``fan_out`` squared
parts are learned, which bounds the classifiers that tasks are sent; what is
larger is dealt in slices.

How many of the most probable parts a query visits is calibrated on the sample,
so that ``target`` of its true neighbours lie in them.  A query that finds
fewer than ``k`` rows so visits all parts.

Indexing and search cover every row: each vector goes to its most probable
part, neighbouring parts are dealt in groups of about ``slice_rows`` vectors (a
larger part in slices) and queries in blocks.  A query travels once to each
group that it asks, with the list of its parts there; each part's vectors are
scored by a matrix product, and candidates rescored in double precision on the
original vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite
components (or another length than the sample's most frequent one) take no
part; ties go to the smaller id; repeated rows with a query's id are not its
neighbours, and other repeated rows count once; fewer than ``k`` candidates
are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm._work import stored


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass(frozen=True)
class Router:
    """A classifier of parts, for some of them one of their own parts, and the
    number of parts to visit.  Parts are numbered through, ``first[p]`` on."""

    top: tuple[np.ndarray, np.ndarray]
    below: dict[int, tuple[np.ndarray, np.ndarray]]
    probes: int = 1

    @property
    def first(self) -> np.ndarray:
        n = [self.below[p][0].shape[1] if p in self.below else 1 for p in range(self.top[0].shape[1])]
        return np.concatenate([[0], np.cumsum(n)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log probability of each part."""
        first, high = self.first, _log_softmax(x @ self.top[0] + self.top[1])
        out = np.empty((len(x), first[-1]))
        for p in range(high.shape[1]):
            low = _log_softmax(x @ self.below[p][0] + self.below[p][1]) if p in self.below else 0.0
            out[:, first[p] : first[p + 1]] = high[:, p : p + 1] + low
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that each row is kept in."""
        first, high = self.first, (x @ self.top[0] + self.top[1]).argmax(1)
        out = first[high]
        for p in np.unique(high).tolist():
            if p in self.below:
                here = high == p
                out[here] += (x[here] @ self.below[p][0] + self.below[p][1]).argmax(1)
        return out


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec double[]) of the vectors that take part."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    return rows.where(fine).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Ids of the k largest inner products of each row with the others."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else out[lo : lo + 512]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """Cuts the graph into parts of at most ``slack`` times the even size."""
    n, rng = len(x), np.random.default_rng(seed)
    centre = x[rng.choice(n, parts, replace=False)]
    room = int(np.ceil(slack * n / parts))
    label = None
    for _ in range(rounds):
        gain = x @ centre.T
        if label is not None:
            votes = np.zeros((n, parts))
            np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph.ravel()]), 1)
            gain = votes + gain / (1e-9 + np.abs(gain).max())
        choice = np.argsort(-gain, axis=1)
        top = np.take_along_axis(gain, choice[:, :2], 1)
        left, new = np.full(parts, room), np.empty(n, np.int64)
        for i in np.argsort(-(top[:, 0] - top[:, -1]), kind="stable"):
            for p in choice[i]:
                if left[p]:
                    left[p] -= 1
                    new[i] = p
                    break
        label = new
        for p in range(parts):
            if (label == p).any():
                centre[p] = x[label == p].mean(0)
    return label


def learn(x: np.ndarray, parts: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a classifier of balanced parts of the sample ``x``."""
    dim = x.shape[1]
    w, b = np.zeros((dim, parts)), np.zeros(parts)
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts, seed=seed)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1 / graph.shape[1])
    goal = 0.5 * share + 0.5 * np.eye(parts)[label]
    scale = np.sqrt((x * x).sum(1).mean())
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, 201):
        p = np.exp(_log_softmax(x @ w + b))
        d = (p - goal) / len(x)
        gw, gb = x.T @ d + 1e-6 * w, d.sum(0)
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.3 / scale
        w -= rate * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.999**step)) + 1e-10)
        b -= 0.3 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-10)
    return w, b


def fit(rows: DataFrame, fit_rows: int = 4096, k: int = 20, target: float = 0.93, part_rows: int = 128, fan_out: int = 128, seed: int = 3) -> Router | None:
    """Learns the router; ``rows (id, vec)`` is a stored table."""
    n_rows = rows.count()
    # a first cut by the hash leaves about 1.5 x fit_rows rows, however many there are
    near = rows.where(F.xxhash64("id") / 2.0**64 + 0.5 < 1.5 * (fit_rows + 50) / max(1, n_rows))
    got = near.orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    if not got:
        return None
    lengths = [len(r["vec"]) for r in got]
    dim = max(set(lengths), key=lengths.count)
    x = np.array([r["vec"] for r in got if len(r["vec"]) == dim], np.float64)
    parts = max(1, min(fan_out, len(x) // 24, -(-n_rows // part_rows)))
    if parts == 1:
        return Router((np.zeros((dim, 1)), np.zeros(1)), {})
    router = Router(learn(x, parts, k, seed), {})
    if n_rows > part_rows * parts:
        router = Router(router.top, _second_level(rows, router, fit_rows, k, part_rows, fan_out, seed))
    order = np.argsort(-router.scores(x), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
    needed = rank[np.arange(len(x))[:, None], router.home(x)[neighbour_graph(x, k)]]
    covered = np.cumsum(np.bincount(needed.ravel(), minlength=order.shape[1])) / needed.size
    return Router(router.top, router.below, int(np.argmax(covered >= target)) + 1)


def _second_level(rows: DataFrame, router: Router, fit_rows: int, k: int, part_rows: int, fan_out: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A classifier within each part of more than ``part_rows`` rows."""
    dim = router.top[0].shape[0]
    placed = rows.mapInPandas(_route(router, dim), "id long, vec array<double>, part int")
    size = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each part
    large = {p: n for p, n in size.items() if n > part_rows}
    if not large:
        return {}
    share = F.create_map(*[F.lit(v) for p, n in large.items() for v in (p, 1.5 * (fit_rows + 50) / n)])[F.col("part")]
    some = placed.where(F.xxhash64("id", F.lit(seed)) / 2.0**64 + 0.5 < share)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        x = _matrix(pdf.sort_values("id", kind="stable")["vec"])[:fit_rows]
        parts = min(fan_out, len(x) // 24, -(-large[part] // part_rows))
        w, b = learn(x, parts, k, seed) if parts > 1 else (np.zeros((dim, 1)), np.zeros(1))
        return pd.DataFrame({"part": [part], "w": [w.tobytes()], "b": [b.tobytes()]})

    got = some.groupBy("part").applyInPandas(task, "part int, w binary, b binary").collect()  # at most fan_out x fan_out x dim numbers
    return {r["part"]: (np.frombuffer(r["w"]).reshape(dim, -1), np.frombuffer(r["b"])) for r in got}


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _route(router: Router, dim: int):
    """Rows with the part that they are kept in."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[pdf["vec"].map(len) == dim]
            if len(pdf):
                yield pdf.assign(part=router.home(_matrix(pdf["vec"])))

    return scan


def _visit(router: Router, dim: int, probes: int, group_of: np.ndarray):
    """Queries with each group that they ask, and which of its parts."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[pdf["vec"].map(len) == dim]
            if not len(pdf):
                continue
            best = np.sort(np.argsort(-router.scores(_matrix(pdf["vec"])), axis=1, kind="stable")[:, :probes], axis=1).astype(np.int32)
            group = group_of[best]  # rising, as parts are grouped in order
            row, col = np.nonzero(np.column_stack([np.ones(len(best), bool), group[:, 1:] != group[:, :-1]]))
            end = np.append(np.where(row[1:] == row[:-1], col[1:], probes), probes)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "vec": pdf["vec"].to_numpy()[row], "group": group[row, col], "parts": [best[r, a:b].tobytes() for r, a, b in zip(row, col, end, strict=True)]})

    return scan


def _search(k: int):
    def task(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            # repeated rows meet here and count once
            rows = rows[~pd.DataFrame({"id": rows["id"], "vec": [x.tobytes() for x in rows["vec"]]}).duplicated().to_numpy()].sort_values(["part", "id"], kind="stable")
            v, ids, part = _matrix(rows["vec"]), rows["id"].to_numpy(np.int64), rows["part"].to_numpy(np.int64)
            edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = dict(zip(part[edge].tolist(), zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True), strict=True))
            q, qid = _matrix(queries["vec"]), queries["id"].to_numpy(np.int64)
            wanted = [np.frombuffer(x, np.int32) for x in queries["parts"]]
            for lo in range(0, len(q), 256):
                some = wanted[lo : lo + 256]
                who, what = np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some)
                s = np.full((len(some), len(v)), -np.inf)
                for p in np.unique(what).tolist():
                    if p in ends:
                        a, b = ends[p]
                        here = who[what == p]
                        s[here, a:b] = q[lo + here] @ v[a:b].T
                s[qid[lo : lo + 256, None] == ids[None, :]] = -np.inf
                n = min(k, s.shape[1])
                least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
                for i in range(len(s)):
                    bound = least[i] - 1e-9 * max(1.0, abs(least[i])) if np.isfinite(least[i]) else -np.finfo(float).max
                    near = np.flatnonzero(s[i] >= bound)
                    if not len(near):
                        continue
                    score = np.zeros(len(near))
                    for d in range(v.shape[1]):  # one order of summing for all, so equal vectors tie
                        score += v[near, d] * q[lo + i, d]
                    top = np.lexsort((ids[near], -score))[:k]
                    out.append((np.full(len(top), qid[lo + i]), ids[near][top], score[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return task


def _listed(values: np.ndarray) -> Column:
    """An array literal, a number for each part."""
    return F.from_json(F.lit(json.dumps(values.tolist())), "array<int>")


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", slice_rows: int = 4_000, query_block: int = 40_000, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query row."""
    every = stored(usable(rows, id_col, vec_col), "vectors")
    asked = every.where(is_query)
    router = fit(every, k=k, **options)
    if router is None:
        return every.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    parts, dim = int(router.first[-1]), router.top[0].shape[0]
    homes = stored(every.mapInPandas(_route(router, dim), "id long, vec array<double>, part int"), "homes")
    size = np.zeros(parts, np.int64)
    for r in homes.groupBy("part").agg(F.count("*").alias("n")).collect():  # a row for each part
        size[r["part"]] = r["n"]
    # neighbouring parts are grouped up to slice_rows rows; a larger part is a group of several slices
    group_of, full = np.zeros(parts, np.int64), size[0]
    for p in range(1, parts):
        full = full + size[p]
        group_of[p] = group_of[p - 1] + int(full > slice_rows)
        full = size[p] if full > slice_rows else full
    slices_of = np.maximum(1, -(-np.bincount(group_of, size) // slice_rows)).astype(np.int64)

    def visit(queries: DataFrame, probes: int) -> DataFrame:
        visits = stored(queries.mapInPandas(_visit(router, dim, probes, group_of), "id long, vec array<double>, group int, parts binary"), "visits")
        wanted = np.zeros(len(slices_of), np.int64)
        for r in visits.groupBy("group").agg(F.count("*").alias("n")).collect():
            wanted[r["group"]] = r["n"]
        slices, blocks = _listed(slices_of)[F.col("group")], _listed(np.maximum(1, -(-wanted // query_block)))[F.col("group")]
        there = homes.withColumn("group", _listed(group_of)[F.col("part")]).withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        ask = visits.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        keys = ["group", "slice", "block"]
        found = ask.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(_search(k), "query_id long, vec_id long, score double")
        nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = visit(asked, router.probes)
    if router.probes == parts:
        return found
    # whoever found fewer than k asks everywhere
    found = stored(found, "found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = asked.join(full.hint("shuffle_merge"), "id", "left_anti")
    if short.isEmpty():
        return found
    short = stored(short, "short")
    few = short.select(F.col("id").alias("query_id")).distinct()
    return found.join(few.hint("shuffle_merge"), "query_id", "left_anti").unionByName(visit(short, parts))
