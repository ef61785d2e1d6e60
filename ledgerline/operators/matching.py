"""Longest matching blocks of two sequences, and what follows from them.

The rule is Ratcliff-Obershelp's: the longest common block is taken (of equally
long ones the earliest in the first sequence, then in the second), then the
same is done left and right of it.  All stretches of one length are compared at
once by 64-bit rolling hashes, and the block found is compared item by item.
Runs of stretches of the first sequence that occur in the second bound the
block's length from above; the longest run that also moves on by one in the
second bounds it from below.  Mostly both are the same, so a block takes one
comparison; else its length is searched for between the bounds.  A pair takes
memory in proportion to its two sequences, and time in proportion to them (at
worst times the logarithm of the block) for each level of the recursion;
nothing is quadratic but the smallest stretches.
"""

from __future__ import annotations

import itertools
import re

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
#: Pairs of stretches with no more cells than this are compared directly.
_SMALL = 400
#: Lengths of stretches that are looked for first, until some occur in both.
_STRETCHES = (32, 8, 3)
_SPACES = re.compile(r"(\s+)")
_KNOWN: dict[int, np.ndarray] = {}

Block = tuple[int, int, int]


def _powers(base: int, n: int) -> np.ndarray:
    known = _KNOWN.get(base)
    if known is None or len(known) < n:
        out = np.full(max(4096, 2 * n if n < 1 << 20 else n), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n >= 1 << 20:  # not kept
            return out
        known = _KNOWN[base] = out
    return known[:n]


def _spread(x: np.ndarray) -> np.ndarray:
    """Codes as random-looking 64-bit numbers."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Rolling:
    """Hashes of all stretches of a sequence, from sums of its items times powers."""

    def __init__(self, items: np.ndarray):
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(_spread(items) * _powers(_ODD, len(items)), out=self.sums[1:])
        self.back = _powers(_BACK, len(items) + 1)

    def of(self, lo: int, hi: int, size: int) -> np.ndarray:
        """Of the stretches of ``size`` items that lie between ``lo`` and ``hi``."""
        return (self.sums[lo + size : hi + 1] - self.sums[lo : hi - size + 1]) * self.back[lo : hi - size + 1]


def _small(a: list[int], b: list[int]) -> Block:
    best, before = (0, 0, 0), {}
    places: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    for i, x in enumerate(a):
        now = {}
        for j in places.get(x, ()):
            n = now[j] = before.get(j - 1, 0) + 1
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
        before = now
    return best


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and lengths of runs of neighbours; ``on``: whether one goes on into the next."""
    ends = np.append(np.flatnonzero(~on), len(on))
    starts = np.zeros_like(ends)
    starts[1:] = ends[:-1] + 1
    return starts, ends - starts + 1


class Pair:
    """Two sequences of whole numbers."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.ra, self.rb = _Rolling(a), _Rolling(b)

    def longest(self, alo: int, ahi: int, blo: int, bhi: int, most: int) -> Block:
        """The longest block within the limits; its size is known not to pass ``most``."""
        if (ahi - alo) * (bhi - blo) <= _SMALL:
            i, j, n = _small(self.a[alo:ahi].tolist(), self.b[blo:bhi].tolist())
            return alo + i, blo + j, n
        most = min(most, ahi - alo, bhi - blo)

        def hits(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x, y = self.ra.of(alo, ahi, size), self.rb.of(blo, bhi, size)
            there = np.sort(y)
            at = np.minimum(np.searchsorted(there, x), len(there) - 1)
            return np.flatnonzero(there[at] == x), x, y

        shorter = min(ahi - alo, bhi - blo)
        unlike = self.a[alo : alo + shorter] != self.b[blo : blo + shorter]
        begin = int(unlike.argmax()) if unlike.any() else shorter
        if begin >= most or 2 * begin > shorter and not len(hits(begin + 1)[0]):
            return alo, blo, begin
        low, high, best = 0, most + 1, None
        for size in _STRETCHES:
            if size >= high:
                continue
            x, y = self.ra.of(alo, ahi, size), self.rb.of(blo, bhi, size)
            order = np.argsort(y, kind="stable")
            there = y[order]
            at = np.minimum(np.searchsorted(there, x), len(there) - 1)
            mine = np.flatnonzero(there[at] == x)
            if not len(mine):
                high = size
                continue
            theirs = order[at[mine]]  # the first place of each
            on = mine[1:] - mine[:-1] == 1
            starts, runs = _runs(on)
            both_starts, both = _runs(on & (theirs[1:] - theirs[:-1] == 1))
            most_here, sure = int(runs.max()), int(both.max())
            if size + most_here - 1 <= most and most_here == sure:
                first = int(starts[runs.argmax()])
                if first == int(both_starts[both.argmax()]):
                    i, j, n = alo + int(mine[first]), blo + int(theirs[first]), size + sure - 1
                    if np.array_equal(self.a[i : i + n], self.b[j : j + n]):
                        return i, j, n
            low, high = min(most, size + sure - 1), min(high, size + most_here)
            break
        size = low + 1
        while low + 1 < high:
            found = hits(size)
            if len(found[0]):
                low, best = size, found
            else:
                high = size
            size = max((low + high) // 2, low + 1)
        if not low:
            return alo, blo, 0
        if best is None:
            best = hits(low)
        i = int(best[0][0])
        j = int(np.flatnonzero(best[2] == best[1][i])[0])
        if not np.array_equal(self.a[alo + i : alo + i + low], self.b[blo + j : blo + j + low]):  # two hashes met
            i, j, low = _small(self.a[alo:ahi].tolist(), self.b[blo:bhi].tolist())
        return alo + i, blo + j, low

    def found(self, least: float = 0.0) -> list[Block] | None:
        """All matching blocks, as they are found; none if twice their items are less than ``least`` of all."""
        total, rest = max(1, len(self.a) + len(self.b)), min(len(self.a), len(self.b))
        found, size, todo = [], 0, [(0, len(self.a), 0, len(self.b), rest)]
        while todo:
            if 2.0 * (size + rest) / total < least:
                return None
            alo, ahi, blo, bhi, most = todo.pop()
            rest -= min(ahi - alo, bhi - blo)
            if alo == ahi or blo == bhi:
                continue
            i, j, n = self.longest(alo, ahi, blo, bhi, most)
            if n:
                found.append((i, j, n))
                todo += [(alo, i, blo, j, n), (i + n, ahi, j + n, bhi, n)]
                size += n
                rest += min(i - alo, j - blo) + min(ahi - i - n, bhi - j - n)
        return found

    def blocks(self) -> list[Block]:
        """All matching blocks in order; blocks that touch in both sequences are one."""
        found = self.found()
        out: list[Block] = []
        for i, j, n in sorted(found):
            if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
                out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
            else:
                out.append((i, j, n))
        return out


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def numbered(*lists: list) -> list[np.ndarray]:
    """Lists of items as arrays of their numbers, equal items having one."""
    known = {x: i for i, x in enumerate(dict.fromkeys(itertools.chain(*lists)))}
    return [np.fromiter(map(known.__getitem__, items), np.int64, len(items)) for items in lists]


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """Twice the matched characters over all; two empty texts are equal.  Of less than ``least``, it need not be known and is 0."""
    if a == b:
        return 1.0
    found = Pair(letters(a), letters(b)).found(least)
    return 0.0 if found is None else 2.0 * sum(n for _, _, n in found) / (len(a) + len(b))


def edits(a: np.ndarray, b: np.ndarray) -> list[tuple[str, int, int, int, int]]:
    """(op, from, to, from, to): equal, replace, delete and insert in order, without gaps."""
    out, i, j = [], 0, 0
    for x, y, n in [*Pair(a, b).blocks(), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out


def word_edits(a: str | None, b: str | None) -> list[dict]:
    """Edits of words; runs of white space are items of their own."""
    if a == b:
        return [{"op": "equal", "old": a, "new": b}] if a else []
    old, new = (list(filter(None, _SPACES.split(s or ""))) for s in (a, b))
    return [{"op": op, "old": "".join(old[i:j]), "new": "".join(new[k:n])} for op, i, j, k, n in edits(*numbered(old, new))]


def quoted(quote: str, source: str) -> float:
    """Likeness of a quote to the stretch of its source that begins with their longest common block."""
    if not quote or quote in source:
        return 1.0
    _, at, n = Pair(letters(quote), letters(source)).longest(0, len(quote), 0, len(source), len(quote))
    return similarity(quote, source[at : at + max(n, len(quote))])


class Likeness:
    """The text most like a given one, among some; what can't be the most alike isn't compared."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.array([len(t) for t in texts], np.int64)
        kinds = np.unique(np.concatenate([letters(t) for t in texts])) if texts else np.zeros(0, np.uint32)
        self.kinds = kinds
        self.counts = np.stack([self._counts(t)[0] for t in texts]) if texts else np.zeros((0, 0), np.int32)
        self.left = np.ones(len(texts), bool)

    def _counts(self, text: str) -> tuple[np.ndarray, int]:
        codes = letters(text)
        at = np.searchsorted(self.kinds, codes)
        at = np.minimum(at, max(0, len(self.kinds) - 1))
        known = self.kinds[at] == codes if len(self.kinds) else np.zeros(len(codes), bool)
        return np.bincount(at[known], minlength=len(self.kinds)).astype(np.int32), len(codes)

    def take(self, text: str, least: float) -> tuple[int, float] | None:
        """(index, likeness) of the best text left (ties: the first) of at least ``least``; it is taken out.

        Common characters, wherever they stand, bound the likeness from above.
        """
        some = np.flatnonzero(self.left)
        if not len(some):
            return None
        counts, size = self._counts(text)
        total = size + self.sizes[some]
        bound = np.where(total == 0, 1.0, 2.0 * np.minimum(self.counts[some], counts).sum(1) / np.maximum(total, 1))
        best: tuple[float, int] | None = None
        for i in np.lexsort((some, -bound)).tolist():
            if bound[i] < least or best is not None and bound[i] < best[0]:
                break
            score, at = similarity(text, self.texts[some[i]], least if best is None else max(least, best[0])), int(some[i])
            if score >= least and (best is None or score > best[0] or score == best[0] and at < best[1]):
                best = (score, at)
        if best is None:
            return None
        self.left[best[1]] = False
        return best[1], best[0]
