"""Word shingles of many texts at once, as 64-bit hashes in flat arrays."""

from __future__ import annotations

import numpy as np

WORDS = 5
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = [np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64) | 1) for k in range(WORDS)]
CHUNK = 1 << 20  # bytes hashed together

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32, 0]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, INVERSE)]
    return _powers


def final(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    begin = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    word = final((sums[end] - sums[start]) * down[start])
    text = np.searchsorted(begin, start, "right") - 1
    counts = np.bincount(text, minlength=len(raw))
    first = np.cumsum(counts) - counts
    last = np.repeat(first + counts, counts)
    at = np.arange(len(word))
    total = np.zeros(len(word), np.uint64)
    for k in range(WORDS):
        n = max(0, len(word) - k)
        total[:n] += np.where(at[:n] + k < last[:n], word[k:], np.uint64(0)) * MIX[k]
    keep = (at + WORDS <= last) | (at == np.repeat(first, counts))
    return final(total[keep]), np.where(counts > 0, np.maximum(counts - WORDS + 1, 1), 0)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the shingles of each text in order, repeats included.

    Words are lower-case runs between white space (ASCII); texts of fewer than five words have one shingle of all words,
    texts without words (null and empty ones too) none.  A shingle's hash depends on its words alone.
    """
    hashes, counts, some, size = [], [], [], 0
    for t in [*texts, None]:
        raw = (t or "").lower().encode()
        if some and (size + len(raw) > CHUNK or len(counts) + len(some) == len(texts)):
            h, c = _hashed(some)
            hashes.append(h)
            counts.extend(c.tolist())
            some, size = [], 0
        some.append(raw)
        size += len(raw) + 1
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64)
