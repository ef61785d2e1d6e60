"""Prefix trie of conversations, built as a burst trie.

A conversation is the sequence of its turns; a turn's id is a 128-bit hash of
role and text, followed by the number of code points of its text, so a whole
sequence is one binary value whose byte order is the order of the trie.

* Equal sequences are one row first: their ids are gathered in chunks of 256
  neighbouring ids, and one sorted stream folds the chunks into number, least
  id and hash, so a sequence that a third of all conversations share is never
  held as a whole.
* All sequences start in one container below the root.  A container of more
  than ``capacity`` rows bursts: the turns that all its rows share become trie
  heads, and the rows are dealt to new containers by their next turn id.
* The shards hold what remains: containers sorted by sequence, which a sweep
  with one stack turns into nodes.  Totals of subtrees climb from the tops of
  containers to the heads of each round, deepest round first.

The unit of the trie is a conversation, one row with 40 bytes a turn.  Heads
that burst in one round hold more than ``capacity`` rows each, and the capacity
grows with the table, so they are fewer than ``MAX_HEADS``: that bounds what is
broadcast.

Defined cases: null role or text is empty; turns are ordered by turn (null
first), ties by turn id; repeated rows are turns of their own; rows with a null
conv_id belong to no conversation; an empty table has no nodes; very long texts
are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._work import doc_columns, stored

#: Bytes of a turn in a sequence: 16 of its id, 4 of its length.
TURN = 20
#: Containers that can burst in one round, at most.
MAX_HEADS = 50_000
_ROWS = 8192
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _turn_id() -> Column:
    """40 hex digits: 128 bits of (role, text), then the code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.md5(F.encode(told, "UTF-8")), F.lpad(F.hex(F.char_length(text).cast("long")), 8, "0"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of turn ids in order, one row for each conversation."""
    rows = doc_columns(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", _turn_id().alias("id")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t.id).alias("turns"))


def rebuilt(convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """``convs (conv_id, turns)``, each beginning with the first turns of its block's first conversation.

    Conversation c takes h = crc32(c) mod ``most`` turns of c - c mod ``block``
    (none, if there is no such conversation), then its own after the first h.
    """
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int")
    first = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    rows = convs.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    rows = rows.join(first.hint("shuffle_merge"), "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, bucket) to one row for each key; a chunk is the most that is held."""
    out: list[tuple] = []
    key = seq = sha = None
    n = first = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        made = pa.record_batch([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["seq", "n", "first", "ends"])
        out.clear()
        return made

    for b in batches:
        for k, s, ids, m, least in zip(*(b.column(c).to_pylist() for c in ("key", "seq", "ids", "n", "first")), strict=True):
            if k != key:
                if key is not None:
                    out.append((seq, n, first, sha.hexdigest()))
                    if len(out) >= _ROWS:
                        yield batch()
                key, seq, n, first, sha = k, s, 0, least, hashlib.sha256()
            sha.update(ids.encode() if not n else b"," + ids.encode())
            n += m
    if key is not None:
        out.append((seq, n, first, sha.hexdigest()))
    yield batch()


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(seq, n, first, ends): each sequence with its number of conversations, least id and hash of all ids."""
    seq = F.unhex(F.array_join("turns", ""))
    rows = convs.select("conv_id", seq.alias("seq")).select("conv_id", "seq", F.unhex(F.md5("seq")).alias("key"), F.shiftright("conv_id", 8).alias("bucket"))
    chunks = rows.groupBy("key", "bucket").agg(F.any_value("seq").alias("seq"), F.sort_array(F.collect_list("conv_id")).alias("c"))
    chunks = chunks.select("key", "bucket", "seq", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("ids"), F.size("c").cast("long").alias("n"), F.array_min("c").alias("first"))
    return chunks.repartition("key").sortWithinPartitions("key", "bucket").mapInArrow(_fold, "seq binary, n long, first long, ends string")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    most, i = min(len(a), len(b)), 0
    while i < most and a[i : i + TURN] == b[i : i + TURN]:
        i += TURN
    return i // TURN


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that all rows of each bursting container share, from its least and largest sequence."""
    for b in batches:
        pairs = zip(b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True)
        common = [(n := _common(low, high), low[: n * TURN]) for low, high in pairs]
        yield pa.record_batch({c: b.column(c) for c in ("box", "depth", "up", "up_conv", "n", "first")} | {"shared": pa.array([n for n, _ in common], pa.int32()), "path": pa.array([p for _, p in common], pa.binary())})


class _Nodes:
    """Finished nodes, given out in batches; ``up`` is set for tops of containers alone."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(kinds)
        self.rows = []
        names = [c.split()[0] for c in NODE.split(", ")] + ["up"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


_NO_ENDS = hashlib.sha256(b"").hexdigest()
_FIRST, _N, _CHILDREN, _LEAVES, _SAVED, _ENDS, _WAITING = range(7)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose rows come sorted by sequence: one stack, closed and opened at what two rows share."""
    out, stack = _Nodes(), []
    box = up = up_conv = None
    top, last = 0, b""

    def close(to: int) -> None:
        """Closes the open nodes deeper than ``to``."""
        while len(stack) > to - top + 1:
            node, depth = stack.pop(), top + len(stack)
            node[_LEAVES] = node[_LEAVES] or 1
            if depth:
                node[_SAVED] += (node[_N] - 1) * int.from_bytes(last[depth * TURN - 4 : depth * TURN])
            for w in node[_WAITING]:
                out.rows.append((w[0], w[1], node[_FIRST], *w[2:], None))
            done = (node[_FIRST], depth, node[_N], node[_CHILDREN], node[_LEAVES], node[_SAVED], node[_ENDS])
            if stack:
                above = stack[-1]
                above[_FIRST] = min(above[_FIRST], node[_FIRST])
                for i in (_N, _LEAVES, _SAVED):
                    above[i] += node[i]
                above[_CHILDREN] += 1
                above[_WAITING].append(done)
            else:
                out.rows.append((done[0], done[1], up_conv, *done[2:], up or b""))

    for b in batches:
        for k, d, u, uc, seq, n, first, ends in zip(*(b.column(c).to_pylist() for c in ("box", "depth", "up", "up_conv", "seq", "n", "first", "ends")), strict=True):
            if k != box:
                close(top - 1)
                box, top, up, up_conv = k, d, u, uc
                stack.append([first, 0, 0, 0, 0, _NO_ENDS, []])
                shared = top
            else:
                shared = _common(last, seq)
                close(shared)
            last = seq
            stack.extend([first, 0, 0, 0, 0, _NO_ENDS, []] for _ in range(len(seq) // TURN - top + 1 - len(stack)))
            node = stack[-1]
            node[_FIRST], node[_N], node[_ENDS] = min(node[_FIRST], first), node[_N] + n, ends
            if len(out.rows) >= _ROWS:
                yield out.batch()
    close(top - 1)
    yield out.batch()


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the turns that a burst container shares; the deepest has the new containers as children."""
    for b in batches:
        out = _Nodes()
        for h in b.to_pylist():
            depth, deepest, saved = h["depth"], h["shared"], h["saved"]
            rows = []
            for j in range(deepest, depth - 1, -1):
                if j:
                    saved += (h["n"] - 1) * int.from_bytes(h["path"][j * TURN - 4 : j * TURN])
                low, high = j == deepest, j == depth
                rows.append((h["first"], j, h["up_conv"] if high else h["first"], h["n"], h["children"] if low else 1, h["leaves"], saved, h["ends"] or _NO_ENDS if low else _NO_ENDS, (h["up"] or b"") if high else None))
            out.rows = rows
            yield out.batch()


def trie(seqs: DataFrame, capacity: int = 256) -> DataFrame:
    """The nodes (:data:`NODE`) of ``seqs (seq, n, first, ends)``, one row for each sequence."""
    rows = stored(seqs.select(F.unhex(F.md5(F.lit(b""))).alias("box"), F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("up"), F.lit(None).cast("long").alias("up_conv"), "seq", "n", "first", "ends"), "sequences")
    most = max(capacity, -(-rows.count() // MAX_HEADS))
    small, rounds = [], []
    while True:
        large = stored(rows.groupBy("box").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("box", F.lit(True).alias("bursts")), "large")
        marked = rows.join(F.broadcast(large), "box", "left")  # fewer than MAX_HEADS
        small.append(marked.where("bursts is null").drop("bursts"))
        if large.isEmpty():
            break
        full = marked.where("bursts").drop("bursts")
        ends = full.groupBy("box", "depth", "up", "up_conv").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.sum("n").alias("n"), F.min("first").alias("first"))
        heads = stored(ends.mapInArrow(_shared, "box binary, depth int, up binary, up_conv long, n long, first long, shared int, path binary"), "heads")
        dealt = full.select("box", "seq", "n", "first", "ends").join(F.broadcast(heads.select("box", "shared", F.col("first").alias("up_conv"))), "box")
        whole = F.length("seq") == F.col("shared") * TURN
        dealt = dealt.select(F.unhex(F.md5(F.substring("seq", F.lit(1), (F.col("shared") + 1) * TURN))).alias("box"), (F.col("shared") + 1).alias("depth"), F.col("box").alias("up"), "up_conv", "seq", "n", "first", "ends", whole.alias("whole"))
        dealt = stored(dealt, "burst")
        rounds.append((heads, dealt.where("whole").select(F.col("up").alias("box"), "ends")))
        rows = dealt.where("not whole").drop("whole")
    boxes = small[0]
    for more in small[1:]:
        boxes = boxes.unionByName(more)
    low = stored(boxes.repartition("box").sortWithinPartitions("box", "seq").mapInArrow(_sweep, f"{NODE}, up binary"), "nodes")
    parts, tops = [low], low.where("length(up) > 0")
    for heads, whole in reversed(rounds):
        # tops of the containers of this round, and of the heads that burst in the next one
        below = tops.groupBy(F.col("up").alias("box")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        full = heads.join(below.hint("shuffle_merge"), "box").join(whole.hint("shuffle_merge"), "box", "left")
        part = stored(full.mapInArrow(_heads, f"{NODE}, up binary"), "head-nodes")
        parts.append(part)
        tops = tops.unionByName(part.where("length(up) > 0"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.drop("up")


def conversation_trie(conversations: DataFrame, capacity: int = 256) -> DataFrame:
    """The trie of the rebuilt ``conversations (conv_id, turn, role, text)``, one row for each node."""
    convs = rebuilt(stored(sequences(conversations), "convs"))
    return trie(distinct_sequences(convs), capacity)
