"""N-gram Jaccard self-join by chosen paths.

Texts become sets of word shingles (``[^\\x20\\x09-\\x0D]+`` words, five at a time;
a shorter text is one shingle).  Equal sets collapse to one class first, so
copies cost a map-side aggregate.

1. *Chosen paths.*  Each set has a min-wise sample of its shingles (one
   permutation, densified; a byte of each is kept to compare sets).  In each
   run a sampled coordinate sends the set to the bucket of the shingle sampled
   there; two sets of similarity s share it with probability s, so R runs miss
   a pair at the threshold t with probability (1 - t)^R.  Runs are repeated
   until that is at most 1 - ``target_recall`` (:func:`runs_for`).  Buckets of
   at most ``bucket_limit`` sets are brute-forced over the samples.  Larger
   ones meet a leader first (sets that are nearly equal to it are linked and
   leave; all that could be similar to one of those are linked, too, by the
   triangle inequality of the Jaccard distance), and the rest splits again on
   ``fan_out`` further sampled shingles, until all buckets are small: each
   bucket is split into subsets of itself without its leader, so it ends.
   Sets linked to a leader keep its name as their root; sets of one root are
   connected already, so they aren't linked again, and a bucket with a single
   root is finished.
2. *Groups.*  Links of the samples are lax (0.45), and their components
   are the groups within which every similar pair must lie.
3. *Exact check.*  In each group all pairs are compared by their whole
   shingle sets.  Groups too large for a task are dealt as pairs of blocks:
   each block with itself first, then those of two, which link what is
   connected within a block as one.  A task returns counts and a spanning
   forest, never the pairs.

Result: one row per document with its class (smallest doc_id of the connected
component of pairs with similarity at least ``threshold``), its number of
links (other documents that similar, copies included) and of copies.

Defined cases: null or wordless text has no shingles: its own class, no link;
repeated rows are copies of each other; a null doc_id is never a class's name
unless all its members' are null; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import _text as X
from ledgerline.llm._graph import components
from ledgerline.llm._work import groups_for, join_skewed, row_key, stored

SAMPLE = 128
LINK, NEAR = 0.45, 0.85
_SEED = np.random.default_rng(20240501)
_DONORS = _SEED.integers(0, SAMPLE, (64, SAMPLE))
_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    starts, ends, at = X.word_spans(data, offsets, X.SPACE_WORDS)
    sums = X.run_sums(X.word_hashes(data, starts, ends))
    n = len(starts)
    every = X.run_hash(sums, np.arange(max(0, n - size + 1)), np.arange(max(0, n - size + 1)) + size)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield X.run_hash(sums, np.array([a]), np.array([b]))
        else:
            yield every[:0]


def sample(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SAMPLE min-wise samples (64 bits) for each non-empty set."""
    full = np.iinfo(np.uint64).max
    out = np.full((len(sets), SAMPLE), full, np.uint64)
    if not sets:
        return out
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = X.mix(flat + _SALT)
    np.minimum.at(out.reshape(-1), row * SAMPLE + (value >> np.uint64(57)).astype(np.int64), X.mix(value))
    filled = out != full
    result = out.copy()
    todo = ~filled
    for donors in _DONORS:
        if not todo.any():
            break
        take = todo & filled[:, donors]
        result[take] = out[:, donors][take]
        todo &= ~take
    rows, cols = np.nonzero(todo)
    result[rows, cols] = out.min(1)[rows]
    return result


_SETS = "doc_id long, row_key long, set_id string, n int, keys array<long>, sig binary"


def runs_for(threshold: float, target_recall: float) -> int:
    """The fewest runs that find a pair at the threshold with probability ``target_recall``."""
    return min(SAMPLE, math.ceil(math.log(1 - target_recall) / math.log(1 - threshold)))


def _scan(size: int, runs: int):
    pick = np.random.default_rng(7).permutation(SAMPLE)[:runs]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("row_key")
            for lo, hi, data, offsets in X.blocks(batch.column("text")):
                sets = list(shingle_sets(data, offsets, size))
                names = []
                for s in sets:
                    m = X.mix(s + np.uint64(len(s)))
                    names.append(f"{int(m.sum(dtype=np.uint64)):016x}{int(np.bitwise_xor.reduce(X.mix(m))):016x}" if len(s) else None)
                sig = sample([s if len(s) else np.zeros(1, np.uint64) for s in sets])
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(lo, hi - lo), "row_key": keys.slice(lo, hi - lo), "set_id": pa.array(names, pa.string()), "n": pa.array([len(s) for s in sets], pa.int32()),
                        "keys": pa.array(list(sig[:, pick].view(np.int64)), pa.list_(pa.int64())), "sig": pa.array([r.astype(np.uint8).tobytes() for r in sig], pa.binary()),
                    }
                )

    return scan


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SAMPLE)


def leader_links(sig: np.ndarray, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the samples of one bucket.

    Leaders are compared with all that follow; only links that join two
    components so far are kept, so a bucket gives fewer links than members.
    Sets with equal ``roots`` are one component from the start.
    """
    left, a, b = np.arange(len(sig)), [], []
    part = left.copy() if roots is None else np.unique(roots, return_inverse=True)[1]
    while len(left) > 1 and (part[left] != part[left[0]]).any():
        lead, rest = left[0], left[1:]
        same = (sig[rest] == sig[lead]).mean(1)
        near = rest[same >= LINK]
        near = near[part[near] != part[lead]]
        if len(near):
            joined, first = np.unique(part[near], return_index=True)
            a += [int(lead)] * len(first)
            b += near[first].tolist()
            part[np.isin(part, joined)] = part[lead]
        left = rest[same < NEAR]
    return np.array(a, np.int64), np.array(b, np.int64)


def _bucket_links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["bucket", "set_id"], kind="stable")
    sig, ids, bucket = _sigs(pdf["sig"]), pdf["set_id"].to_numpy(object), pdf["bucket"].to_numpy()
    roots = pdf["root"].fillna(pdf["set_id"]).factorize()[0]
    edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    a, b = [], []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        x, y = leader_links(sig[lo:hi], roots[lo:hi])
        a.append(x + lo)
        b.append(y + lo)
    a, b = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": ids[a], "b": ids[b]})


def _split(depth: int, fan_out: int):
    """Compares members of large buckets with the leader and splits the rest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, lead = _sigs(batch.column("sig").to_pylist()), _sigs(batch.column("lead_sig").to_pylist())
            bucket = batch.column("bucket").to_numpy()
            ids, root, leads, top = (np.array(batch.column(c).to_pylist(), object) for c in ("set_id", "root", "lead", "lead_root"))
            same = (sig == lead).mean(1)
            near = same >= LINK
            link = near & (np.where(root == None, ids, root) != top)  # noqa: E711
            root = np.where(near, top, root)
            go_on = np.flatnonzero(same < NEAR)
            # coordinates sampled anew in each bucket, alike for all its members
            draw = X.mix(bucket.view(np.uint64)[:, None] + (np.arange(fan_out, dtype=np.uint64) + np.uint64(1 + 100 * depth)) * _SALT) % np.uint64(SAMPLE)
            rows, cols = np.repeat(go_on, fan_out), np.tile(np.arange(fan_out), len(go_on))
            place = draw[rows, cols].astype(np.int64)
            child = X.mix(X.mix(bucket.view(np.uint64)[rows] + place.astype(np.uint64) * _SALT) + sig[rows, place].astype(np.uint64)).view(np.int64)
            yield pa.record_batch(
                {
                    "bucket": pa.array(np.concatenate([np.zeros(int(link.sum()), np.int64), child])),
                    "set_id": pa.array(np.concatenate([ids[link], ids[rows]]), pa.string()),
                    "lead": pa.array(np.concatenate([leads[link], np.full(len(rows), None)]), pa.string()),
                    "root": pa.array(np.concatenate([root[link], root[rows]]), pa.string()),
                }
            )

    return scan


def candidate_links(sets: DataFrame, bucket_limit: int = 2048, fan_out: int = 2) -> DataFrame:
    """Links (a, b) of sets whose samples may be similar."""
    sigs = sets.select("set_id", "sig")
    rows = sets.select("set_id", F.posexplode("keys").alias("run", "key")).select(F.xxhash64("run", "key").alias("bucket"), "set_id", F.lit(None).cast("string").alias("root"))
    links, depth = [], 0
    while True:
        counts = rows.groupBy("bucket").agg(F.count("*").alias("size"), *([F.min(F.coalesce("root", "set_id")).alias("low"), F.max(F.coalesce("root", "set_id")).alias("high")] if depth else []))
        counts = counts.where("size > 1 and low < high" if depth else "size > 1").select("bucket", "size")
        # a shingle that a third of all sets hold is a hot bucket
        there = stored(join_skewed(rows, counts, ["bucket"], size="size").distinct(), f"paths{depth}")
        small = there.where(F.col("size") <= bucket_limit)
        tasks = groups_for(small.count(), 4_000)
        few = small.select("bucket", "set_id", "root").join(sigs.hint("shuffle_merge"), "set_id")
        links.append(stored(few.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(tasks))).groupBy("part").applyInPandas(_drop_part(_bucket_links), "a string, b string").distinct(), f"links{depth}"))
        large = there.where(F.col("size") > bucket_limit)
        if large.isEmpty():
            break
        salts = F.ceil(F.col("size") / bucket_limit)
        leaders = large.groupBy("bucket", "size").agg(F.min(F.struct("set_id", "root")).alias("x")).select("bucket", "size", F.col("x.set_id").alias("lead"), F.coalesce("x.root", "x.set_id").alias("lead_root"))
        leaders = leaders.join(sigs.select(F.col("set_id").alias("lead"), F.col("sig").alias("lead_sig")).hint("shuffle_merge"), "lead")
        leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts.cast("bigint") - 1))).drop("size")
        dealt = large.withColumn("salt", F.pmod(F.xxhash64("set_id"), salts).cast("bigint"))
        met = dealt.join(leaders.hint("shuffle_merge"), ["bucket", "salt"]).join(sigs.hint("shuffle_merge"), "set_id")
        out = stored(met.select("bucket", "set_id", "root", "sig", "lead", "lead_root", "lead_sig").mapInArrow(_split(depth, fan_out), "bucket long, set_id string, lead string, root string"), f"split{depth}")
        links.append(out.where("lead is not null").select(F.col("lead").alias("a"), F.col("set_id").alias("b")).distinct())
        rows = out.where("lead is null").select("bucket", "set_id", "root").distinct()
        depth += 1
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return thinned(every)


def thinned(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: each set stays linked to its least leader, and its others to that one.

    A set has at most one leader for each of its buckets; sets of a large group share theirs.
    """
    leads = links.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("leads"))
    return leads.select(F.col("leads")[0].alias("a"), F.explode(F.concat(F.array("b"), F.slice("leads", 2, F.size("leads")))).alias("b"))


def _drop_part(f):
    return lambda pdf: f(pdf.drop(columns="part"))


def overlaps(flat_a: np.ndarray, len_a: np.ndarray, flat_b: np.ndarray, len_b: np.ndarray, dense_from: int = 24) -> np.ndarray:
    """Sizes of the intersections of all sets of A with all of B.

    Shingles in many sets go through matrix products in bounded slices, those
    in few through their pairs of postings.
    """
    na, nb = len(len_a), len(len_b)
    out = np.zeros((na, nb), np.float32)
    row_a, row_b = np.repeat(np.arange(na), len_a), np.repeat(np.arange(nb), len_b)
    shared = np.intersect1d(flat_a, flat_b)
    if not len(shared):
        return out

    def postings(flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        use = shared[at] == flat
        term, row = at[use], row[use]
        order = np.argsort(term, kind="stable")
        return term[order], row[order], np.bincount(term, minlength=len(shared))

    ta, ra, ca = postings(flat_a, row_a)
    tb, rb, cb = postings(flat_b, row_b)
    begin_a, begin_b = np.cumsum(ca) - ca, np.cumsum(cb) - cb
    heavy = (ca * cb) >= dense_from * dense_from
    width, slot = 2048, np.full(len(shared), -1)
    slot[heavy] = np.arange(int(heavy.sum()))
    sa, sb = slot[ta], slot[tb]
    for lo in range(0, int(heavy.sum()), width):
        x, y = np.zeros((na, width), np.float32), np.zeros((nb, width), np.float32)
        use = (sa >= lo) & (sa < lo + width)
        x[ra[use], sa[use] - lo] = 1
        use = (sb >= lo) & (sb < lo + width)
        y[rb[use], sb[use] - lo] = 1
        out += x @ y.T
    light = np.flatnonzero(~heavy)
    pairs = ca[light] * cb[light]
    for lo, hi in _slices(pairs, 2_000_000):
        t, n = light[lo:hi], pairs[lo:hi]
        which = np.repeat(np.arange(len(t)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i = ra[begin_a[t][which] + k // cb[t][which]]
        j = rb[begin_b[t][which] + k % cb[t][which]]
        np.add.at(out.reshape(-1), i * nb + j, 1)
    return out


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def forest(match: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a Boolean A x B matrix: (row, column) links."""
    out, rows = [], np.flatnonzero(match.any(1))
    seen_r, seen_c = np.zeros(match.shape[0], bool), np.zeros(match.shape[1], bool)
    for r in rows.tolist():
        if seen_r[r]:
            continue
        seen_r[r], front = True, [r]
        while front:
            nxt = []
            for i in front:
                cols = np.flatnonzero(match[i] & ~seen_c)
                seen_c[cols] = True
                out += [(i, int(c)) for c in cols]
                if len(cols):
                    more = np.flatnonzero(match[:, cols].any(1) & ~seen_r)
                    seen_r[more] = True
                    # each further row hangs on one of these columns
                    hang = cols[match[more][:, cols].argmax(1)] if len(more) else []
                    out += [(int(m), int(c)) for m, c in zip(more, hang, strict=True)]
                    nxt += more.tolist()
            front = nxt
    return out


def connected(match: np.ndarray) -> np.ndarray:
    """For each row of a symmetric Boolean matrix the first row of its component."""
    out = np.full(len(match), -1)
    for r in range(len(match)):
        if out[r] < 0:
            out[r], front = r, np.array([r])
            while len(front):
                front = np.flatnonzero(match[front].any(0) & (out < 0))
                out[front] = r
    return out


def _merged(match: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matrix with rows, and columns, of one name taken together; names of both."""
    names = []
    for axis, of in enumerate((rows, cols)):
        name, code = np.unique(of, return_inverse=True)
        order = np.argsort(code, kind="stable")
        match = np.logical_or.reduceat(match.take(order, axis), np.searchsorted(code[order], np.arange(len(name))), axis)
        names.append(name)
    return match, *names


def _verify(threshold: float):
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["gid", "one", "two"], sort=False):
            g = g.drop_duplicates(["set_id"])
            a = g[g["block"] == g["one"]].sort_values("set_id")
            b = a if g["one"].iloc[0] == g["two"].iloc[0] else g[g["block"] == g["two"]].sort_values("set_id")
            if not len(a) or not len(b):
                continue
            sets = [[np.frombuffer(x, np.uint64) for x in part["shingles"]] for part in (a, b)]
            la, lb = (np.array([len(x) for x in s]) for s in sets)
            common = overlaps(np.concatenate(sets[0]), la, np.concatenate(sets[1]), lb)
            match = common >= threshold * (la[:, None] + lb[None, :] - common) - 1e-6
            ia, ib, wa, wb = a["set_id"].to_numpy(object), b["set_id"].to_numpy(object), a["copies"].to_numpy(np.int64), b["copies"].to_numpy(np.int64)
            if a is b:
                np.fill_diagonal(match, False)
                out += [(x, top, int(n)) for x, top, n in zip(ia, ia[connected(match)], match @ wa, strict=True) if n]
            else:
                out += [(x, None, int(n)) for x, n in zip(ia, match @ wb, strict=True) if n]
                out += [(x, None, int(n)) for x, n in zip(ib, match.T @ wa, strict=True) if n]
                few, x, y = _merged(match, a["top"].to_numpy(object), b["top"].to_numpy(object))
                out += [(x[i], y[j], 0) for i, j in forest(few)]
        return pd.DataFrame(out, columns=["a", "b", "n"])

    return task


def join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, row_key, class_id, n_links, n_copies) for each row of ``docs (doc_id, text)``."""
    return _classes(docs, **options).drop("label")


def _classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, target_recall: float = 0.99999, bucket_limit: int = 2048, block_shingles: int = 600_000, block_sets: int = 2048) -> DataFrame:
    """As :func:`join`, with each class's ``label`` (null for wordless rows), also where no row has an id."""
    rows = docs.select("doc_id", "text", row_key().alias("row_key"))
    scanned = stored(rows.mapInArrow(_scan(size, runs_for(threshold, target_recall)), _SETS), "sets")
    members = scanned.select("doc_id", "row_key", "set_id")
    sets = scanned.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    sets = stored(sets, "distinct")
    groups = components(candidate_links(sets, bucket_limit)).select(F.col("node").alias("set_id"), F.col("label").alias("gid"))
    grouped = stored(sets.select("set_id", "least", "row_key", "copies", "n").join(groups.hint("shuffle_merge"), "set_id"), "grouped")
    per_group = grouped.groupBy("gid").agg(F.sum("n").alias("shingles_in"), F.count("*").alias("sets_in"))
    blocks = F.greatest(F.ceil(F.col("shingles_in") / block_shingles), F.ceil(F.col("sets_in") / block_sets)).cast("int")
    placed = join_skewed(grouped, per_group.select("gid", "sets_in", blocks.alias("blocks")), ["gid"], size="sets_in")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).select("row_key", "set_id", "gid", "copies", "blocks", "block")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in X.blocks(batch.column("text")):
                raw = [s.tobytes() for s in shingle_sets(data, offsets, size)]
                yield pa.record_batch([*[batch.column(c).slice(lo, hi - lo) for c in ("set_id", "gid", "copies", "blocks", "block")], pa.array(raw, pa.binary()), pa.array([len(x) // 8 for x in raw], pa.int64())], names=["set_id", "gid", "copies", "blocks", "block", "shingles", "n"])

    # equal rows of documents share a key; one of them stands for the set
    texts = rows.join(placed.hint("shuffle_merge"), "row_key").select("text", "set_id", "gid", "copies", "blocks", "block")
    whole = stored(texts.mapInArrow(shingles, "set_id string, gid string, copies long, blocks int, block int, shingles binary, n long"), "shingles")
    total = whole.agg(F.sum("n")).first()[0] or 0
    tasks = groups_for(int(total), block_shingles // 2)

    def checked(pairs: DataFrame) -> DataFrame:
        part = F.when(F.col("blocks") > 1, F.concat_ws("/", "gid", "one", "two")).otherwise(F.pmod(F.xxhash64("gid"), F.lit(tasks)).cast("string"))
        return stored(pairs.withColumn("part", part).drop("blocks").groupBy("part").applyInPandas(_drop_part(_verify(threshold)), "a string, b string, n long"), "links")

    within = whole.drop("n").withColumn("one", F.col("block")).withColumn("two", F.col("block"))
    found = checked(within)
    large = whole.where("blocks > 1")
    if not large.isEmpty():
        # pairs of blocks know what is connected within each, so that they link components and not sets
        tops = found.where("b is not null").select(F.col("a").alias("set_id"), F.col("b").alias("top"))
        named = large.drop("n").join(tops.hint("shuffle_merge"), "set_id", "left").withColumn("top", F.coalesce("top", "set_id"))
        pairs = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
        found = found.unionByName(checked(pairs.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other")))
    links = found.where("n > 0").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("n"))
    classes = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("set_id"), "label")
    known = sets.select("set_id", "least", "copies").join(classes.hint("shuffle_merge"), "set_id", "left").join(links.hint("shuffle_merge"), "set_id", "left")
    known = stored(known.select("set_id", "least", "copies", F.coalesce("label", "set_id").alias("label"), F.coalesce("n", F.lit(0)).alias("n")), "known")
    names = known.groupBy("label").agg(F.min("least").alias("class_id"), F.count("*").alias("sets"))
    # a class, or one text, may hold a third of all documents
    named = stored(join_skewed(known, names, ["label"], size="sets").select("set_id", "label", "class_id", "copies", "n"), "named")
    out = join_skewed(members.where("set_id is not null"), named, ["set_id"], size="copies")
    out = out.select(
        "doc_id", "row_key", "class_id", (F.col("n") + F.col("copies") - 1).cast("long").alias("n_links"), (F.col("copies") - 1).cast("long").alias("n_copies"), "label",
    )
    # wordless rows, possibly many, have no set to meet: they don't take part in the join
    alone = members.where("set_id is null").select("doc_id", "row_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"), F.lit(None).cast("string").alias("label"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the smallest doc_id (null last), then row key; wordless rows stay."""
    rows = stored(_classes(docs, **options).where("label is not null").groupBy("label", "row_key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("rows")), "rows")
    least = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("x"), F.count("*").alias("keys")).select("label", "keys", F.col("x.row_key").alias("stays"))
    held = stored(join_skewed(rows, least, ["label"], size="keys").select("row_key", (F.col("row_key") == F.col("stays")).alias("stays"), "rows"), "held")
    keyed = docs.withColumn("__key", row_key())
    # a row that stays and has equal ones goes with the others here, and comes back once
    gone = held.where("not stays or rows > 1").select(F.col("row_key").alias("__key"))
    rest = keyed.join(gone.hint("shuffle_merge"), "__key", "left_anti").select(*docs.columns)
    equal = held.where("stays and rows > 1").select(F.col("row_key").alias("__key"))
    if equal.isEmpty():
        return rest
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))
    once = keyed.join(equal.hint("shuffle_merge"), "__key", "left_semi").withColumn("__nth", nth).where("__nth = 1")
    return rest.unionByName(once.select(*docs.columns))
