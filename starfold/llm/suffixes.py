"""Byte-level kernels of suffix deduplication: anchors, multikey sorting of suffixes, and the windows that repeat.

A window is a string of WIDTH bytes.  Its anchor is the place of the least k-gram hash in it (the leftmost on ties): equal
windows have their anchor at the same offset, so only suffixes that begin at anchors need to meet, about one in 32.  The
windows of one anchor are consecutive; with the bytes that they cover they form its context.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np

WIDTH = 100
GRAM = 37  # bytes of the k-gram
SPAN = WIDTH - GRAM + 1  # k-grams of a window: 64
PREFIX = 24  # leading bytes by which suffixes are dealt into ranges

_random = np.random.default_rng(1009)
BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
ODD = _random.integers(0, 1 << 64, 16, np.uint64) | np.uint64(1)
HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(data: np.ndarray, ends: np.ndarray):
    """(place, first window, last window, hash of the k-gram) of every anchor in texts that end at ``ends``; windows do not cross texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, np.zeros(0, np.uint64)
    one = BYTE[data]
    h, part = one, {1: one}
    for k in range(5):
        m = 1 << k
        h = h[:-m] * ODD[k] + h[m:]
        part[2 * m] = h
    m = n - GRAM + 1
    h = mixed((part[32][:m] * ODD[6] + part[4][32 : 32 + m]) * ODD[7] + one[36 : 36 + m])
    low = (h & HIGH) | np.arange(m, dtype=np.uint64)
    for k in range(6):
        low = np.minimum(low[: -(1 << k)], low[1 << k :])
    size = np.diff(ends, prepend=0)
    valid = np.arange(n - WIDTH + 1) + WIDTH <= np.repeat(ends, size)[: n - WIDTH + 1]
    start = np.flatnonzero(valid)
    place = (low[start] & LOW).astype(np.int64)
    if not len(place):
        return none, none, none, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    return place[first], start[first], start[last], h[place[first]]


def words(data: np.ndarray) -> np.ndarray:
    """A view of the big-endian 8-byte word at every byte."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))


def multikey(n: int, keys) -> tuple[np.ndarray, np.ndarray]:
    """Sort n rows by a sequence of keys, each a function of row numbers; returns (order, first place of each place's run of equal rows).

    Multikey quicksort with 8-byte characters, all partitions of one depth together: rows that still tie are sorted by the
    next character inside their runs; runs of one row drop out.
    """
    order, run = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)
    for key in keys:
        if len(live) < 2:
            break
        rows, g = order[live], run[live]
        k = key(rows).astype(np.uint64)
        o = np.argsort(k, kind="stable")
        if g[0] != g[-1]:
            o = o[np.argsort(g[o], kind="stable")]
        order[live], k = rows[o], k[o]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        at = np.flatnonzero(new)
        run[live] = np.repeat(live[at], np.diff(np.append(at, len(live))))
        live = live[~(new & np.append(new[1:], True))]
    return order, run


@dataclass
class Contexts:
    """Anchored pieces of text: ``left`` bytes before the anchor, ``n`` windows; ``doc, at`` say where the first window starts."""

    data: np.ndarray
    off: np.ndarray
    left: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    block: np.ndarray

    def __len__(self) -> int:
        return len(self.left)

    @property
    def size(self) -> np.ndarray:
        return self.n + (WIDTH - 1)

    def take(self, rows: np.ndarray) -> Contexts:
        size = self.size[rows]
        return Contexts(gathered(self.data, self.off[rows], size), np.cumsum(size) - size, self.left[rows], self.n[rows], self.doc[rows], self.at[rows], self.block[rows])

    def pack(self) -> bytes:
        """Flat bytes: count, doc, at, left, n, data (the block stays outside)."""
        return b"".join([np.array([len(self)], "<i8").tobytes(), self.doc.astype("<i8").tobytes(), self.at.astype("<i8").tobytes(), self.left.astype("u1").tobytes(), self.n.astype("u1").tobytes(), self.data.tobytes()])

    @staticmethod
    def unpack(raws: list[bytes], blocks: list[int]) -> Contexts:
        cols: list[list] = [[] for _ in range(6)]
        for raw, block in zip(raws, blocks, strict=True):
            m = int(np.frombuffer(raw, "<i8", 1)[0])
            parts = (np.frombuffer(raw, "<i8", m, 8), np.frombuffer(raw, "<i8", m, 8 + 8 * m), np.frombuffer(raw, "u1", m, 8 + 16 * m).astype(np.int64), np.frombuffer(raw, "u1", m, 8 + 17 * m).astype(np.int64), np.frombuffer(raw, "u1", -1, 8 + 18 * m), np.full(m, block))
            for c, p in zip(cols, parts, strict=True):
                c.append(p)
        doc, at, left, n, data, block = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        size = n + (WIDTH - 1)
        return Contexts(data.astype(np.uint8, copy=False), np.cumsum(size) - size, left, n, doc, at, block)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given stretches of data, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat((starts - (ends - sizes)).astype(np.int64), sizes)
    return data[np.arange(total) + shift]


def sorted_contexts(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first place of the equal k-grams, first place of the equal contexts), equal contexts by (doc, at)."""
    w = words(c.data)
    size = c.size
    suffix = [lambda r, o=o: w[c.off[r] + c.left[r] + o] for o in (0, 8, 16, 24, GRAM - 8)]
    order, gram = multikey(len(c), suffix)
    # the k-gram's run, then lengths, then the whole context
    of = np.empty(len(c), np.int64)
    of[order] = gram
    most = int(size.max(initial=8))
    rest = [lambda r: of[r], lambda r: c.left[r] << 8 | c.n[r]]
    rest += [lambda r, j=j: w[c.off[r] + np.minimum(j, size[r] - 8)] for j in range(0, most, 8)]
    order, same = multikey(len(c), rest)
    tie = np.lexsort((c.at[order], c.doc[order], same))
    return order[tie], of[order[tie]], same


@dataclass
class Spans:
    """Stretches of documents that go: bytes ``start`` to ``end`` of ``doc``, whose rows lie in ``block``."""

    block: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def repeated_windows(c: Contexts, gram: np.ndarray, budget: int = 1 << 20):
    """For distinct contexts: yields (context of the window, window, whether an equal window comes before it by (doc, at), its digest)."""
    w = words(c.data)
    order = np.argsort(gram, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]])) if len(order) else np.zeros(0, int)
    total = np.cumsum(c.n[order])
    at = 0
    while at < len(starts):
        begin = starts[at]
        base = total[begin - 1] if begin else 0
        stop = at + 1
        while stop < len(starts) and total[(starts[stop + 1] if stop + 1 < len(starts) else len(order)) - 1] - base <= budget:
            stop += 1
        rows = order[begin : starts[stop] if stop < len(starts) else len(order)]
        n = c.n[rows]
        ctx = np.repeat(rows, n)
        win = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = c.off[ctx] + win
        keys = [lambda r, ctx=ctx, win=win: gram[ctx[r]] << 8 | (c.left[ctx[r]] - win[r])]
        keys += [lambda r, place=place, o=o: w[place[r] + o] for o in (*range(0, WIDTH - 8, 8), WIDTH - 8)]
        o, run = multikey(len(ctx), keys)
        tie = np.lexsort((c.at[ctx[o]] + win[o], c.doc[ctx[o]], run))
        o = o[tie]
        yield ctx[o], win[o], run != np.arange(len(run)), place[o]
        at = stop


def digests(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """SHA-256 of the windows at these places, as rows of four integers."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([sha256(raw[p : p + WIDTH]).digest() for p in place.tolist()]), "<i8").reshape(-1, 4)


def as_spans(block, doc, start, end) -> Spans:
    """Overlapping or touching stretches of one document joined."""
    o = np.lexsort((start, doc))
    block, doc, start, end = block[o], doc[o], start[o], end[o]
    if not len(o):
        return Spans(block, doc, start, end)
    # ends grow with starts inside a document as all stretches come from runs of windows sorted by start
    reach = end.copy()
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return Spans(block[first], doc[first], start[first], np.maximum.reduceat(end, first))
