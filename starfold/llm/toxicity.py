"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel, trained on labelled sentences.

The kernel compares two words by their common subsequences of three and four symbols (word bounds included) whose
stretch is limited; each occurrence weighs DECAY to its stretch, so an insult with gaps or inserted characters still
shares most of them.  Two sentences are compared by the sum over all pairs of their words.  Nystroem landmarks, words of
the labelled sentences picked by what the ones before leave unexplained, map a sentence to as many numbers, and the
machine (squared hinge loss) is trained there.  Labels are of texts: every sentence of a clean text is clean, and of a
toxic text at least one is toxic; which, the machine of the other half of the texts chooses.

A sentence's margin is a sum over its words, and a word's part is one sum over its subsequences: machine, landmarks and
kernel collapse to one table by subsequence, so a text is scored by gathering table rows over flat code-point arrays,
whatever the number of landmarks.  A logistic curve over the highest sentence margins of a text gives its score.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from itertools import combinations
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BITS = 18  # log2 of the rows of the table; subsequences meet in a row with probability 2**-BITS
DECAY = 0.7
STRETCH = 5  # the last symbol of a subsequence lies at most so far from its first
SAMPLE_TOXIC = 1200  # bounds of the training sample: expected texts of label 1
SAMPLE_CLEAN = 2400  # and of label 0
LANDMARKS = 600
CANDIDATES = 12000  # words that landmarks are picked from
CLEAN = 6000  # sentences of clean texts that train the machine of a half at first
ALTERED = 1500  # of them, those that train it in an altered form too
WORST = 3000  # those that join them after each training, the highest margins first
TURNS = 3  # trainings; between them, toxic texts choose their sentences anew
CHOSEN = 4  # sentences that a toxic text chooses at most
RIDGE = 1e-4  # of the machine, times the weight of all sentences
ALONE = 0.02  # weight of a toxic text in which the machine takes no sentence for toxic
TOP = 3  # sentence margins that a text's score looks at
WORDS = 3  # of a sentence; longer ones are cut, so that one word can decide
OFFSETS = [(a, b) for a, b in combinations(range(1, STRETCH + 1), 2)] + [(a, b, c) for a, b, c in combinations(range(1, STRETCH + 1), 3)]
MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))
RUN = 16  # within runs of more letters every window is compared too
WINDOWS = range(2, 15)  # their numbers of letters
STOPS = np.array([33, 46, 63, 0x2026, 0x3002], np.uint32)  # marks that end a sentence before white space
APART = 6  # of neighbouring windows that begin within so many letters only the highest counts

_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: 1 for letters and marks, 2 for white space, 0 for what is dropped inside a word."""
    if not _letter:
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            g = unicodedata.category(chr(c))[0]
            kind[c] = 1 if g in "LM" else 2 if chr(c).isspace() else 0
        kind[0] = 2
        _letter.append(kind)
    return _letter[0]


def words_of(texts: list[str]):
    """(codes, bounds, text of each word, sentence of each word): lower-case letters with one zero before, between and after words.

    Characters that are neither letters nor white space vanish, so separators inside a word do not part it; runs of
    single letters join to one word, so spelling an insult out does not hide it.  A sentence ends at a line's end, at a stop
    before white space, and after WORDS words.
    """
    low = ("\0" + "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0").encode("utf-32-le")
    codes = np.frombuffer(low, np.uint32)
    kind = letters()[codes]
    text = np.cumsum(codes == 0, dtype=np.int32) - 1
    stop = np.isin(codes, STOPS)
    stop[:-1] &= kind[1:] == 2
    ends = np.cumsum(stop | (codes == 10) | (codes == 0), dtype=np.int32)
    keep = kind > 0
    codes, text, ends, space = codes[keep], text[keep], ends[keep], kind[keep] == 2
    keep = ~space | np.concatenate([[True], ~space[:-1]])  # one bound is enough
    codes, text, ends, space = np.where(space, 0, codes)[keep].astype(np.uint32), text[keep], ends[keep], space[keep]
    bounds = np.flatnonzero(space)
    size = np.diff(bounds) - 1
    single = np.concatenate([[False], size == 1, [False]])  # by the words before and after each bound
    inner = single[:-1] & single[1:] & (text[np.minimum(bounds + 1, len(text) - 1)] == text[np.maximum(bounds - 1, 0)])
    if inner.any():
        codes, text, ends = (np.delete(x, bounds[inner]) for x in (codes, text, ends))
        bounds = np.flatnonzero(codes == 0)
    first = bounds[:-1][np.diff(bounds) > 1] + 1
    if not len(first):
        return codes, bounds, np.zeros(0, np.int32), np.zeros(0, np.int64)
    own = ends[first]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    at = np.arange(len(own))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % WORDS == 0
    return codes, bounds, text[first], np.cumsum(new) - 1


def parts_of(texts: list[str]):
    """(codes, bounds, text of each word) of runs that other characters part, where words_of joins the parts; one-letter parts are left out."""
    low = ("\0" + "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0").encode("utf-32-le")
    codes = np.frombuffer(low, np.uint32)
    kind = letters()[codes]
    text = np.cumsum(codes == 0, dtype=np.int32) - 1
    on = kind == 1
    first = np.flatnonzero(on & ~np.concatenate([[False], on[:-1]]))
    last = np.flatnonzero(on & ~np.concatenate([on[1:], [False]]))
    run = np.cumsum(kind == 2)[first]
    keep = (np.bincount(run, minlength=1)[run] > 1) & (last > first) if len(run) else np.zeros(0, bool)
    first, last = first[keep], last[keep]
    if not len(first):
        return np.zeros(1, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)
    size = last - first + 1
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.zeros(bounds[-1] + 1, np.uint32)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(bounds[:-1] + 1, size) + at] = codes[np.repeat(first, size) + at]
    return out, bounds, text[first]


def windows_of(codes, bounds, text, table: np.ndarray):
    """(sums, text) of windows inside long runs, each normalised and bounded as a word of its own: the local maxima.

    With the sums by stretch, of subsequences inside and of those with a bound before, behind or at both ends, any window is
    a difference of running sums.
    """
    size = np.diff(bounds) - 1
    long = np.flatnonzero(size > RUN)
    if not len(long):
        return np.zeros(0, np.float32), np.zeros(0, np.int32)
    owner = text[np.cumsum(size > 0)[long] - 1]
    n = size[long] + STRETCH + 1
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    take = np.where(at < np.repeat(size[long], n), np.repeat(bounds[long] + 1, n) + at, 0)
    run = np.where(at < np.repeat(size[long], n), codes[take], 0)  # runs, each followed by room
    left = np.repeat(size[long], n) - at  # letters from here on, at the end 0 and less
    pad = np.concatenate([run, np.zeros(STRETCH + 2, np.uint32)])
    before = np.concatenate([[0], pad[:-1]]).astype(np.uint32)  # from one place before
    total = len(run)
    inside, open_, shut, both = (np.zeros((STRETCH + 1, total), np.float64) for _ in range(4))
    for shape in OFFSETS:
        last, weight = shape[-1], DECAY ** (shape[-1] - 1)
        for out, base, a, b in ((inside, pad, 1, 1), (open_, before, 0, 1), (shut, pad, 1, 0), (both, before, 0, 0)):
            piece = lambda k, base=base: base[k : k + total]
            h = a * piece(0) * MULT[0] + b * piece(last) * MULT[3] + piece(shape[0]) * MULT[1] * np.uint32(len(shape))
            if len(shape) == 3:
                h = h + piece(shape[1]) * MULT[2]
            h = h.astype(np.uint32)
            out[last] += weight * table[(h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)]
    run_sums = np.concatenate([np.zeros((STRETCH + 1, 1)), np.cumsum(inside, axis=1)], axis=1)
    best = np.full(total, -np.inf)
    place = np.arange(total)
    for width in WINDOWS:
        p = place[left >= width]
        value = np.zeros(len(p))
        for last in range(2, STRETCH + 1):
            if width > last:
                value += run_sums[last, p + width - last] - run_sums[last, p]
            if width >= last:
                value += open_[last, p] + shut[last, p + width - last]
            if width + 1 == last:
                value += both[last, p]
        best[p] = np.maximum(best[p], value / norms(np.array([width])))
    high = best.copy()
    group = np.repeat(np.arange(len(long)), n)
    for k in range(1, APART + 1):
        same = group[k:] == group[:-k]
        high[k:] = np.where(same, np.maximum(high[k:], best[:-k]), high[k:])
        high[:-k] = np.where(same, np.maximum(high[:-k], best[k:]), high[:-k])
    top = np.flatnonzero((best == high) & np.isfinite(best))
    return best[top].astype(np.float32), owner[group[top]]


def subsequences(codes: np.ndarray):
    """For each shape of subsequence: (places, rows of the hashed table, weight); no shape crosses a word bound."""
    zero = np.concatenate([[0], np.cumsum(codes == 0)])
    n = len(codes)
    scaled = [codes * m for m in MULT]
    for last in range(2, STRETCH + 1):
        if n <= last:
            continue
        m = n - last
        inside = zero[last : last + m] - zero[1 : m + 1] == 0  # bounds only at the ends
        at = np.flatnonzero(inside)
        weight = np.float32(DECAY ** (last - 1))
        ends = scaled[0][at] + scaled[3][at + last]
        for shape in OFFSETS:
            if shape[-1] != last:
                continue
            h = ends + scaled[1][at + shape[0]] * np.uint32(len(shape))
            if len(shape) == 3:
                h = h + scaled[2][at + shape[1]]
            yield at, (h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS), weight


def norms(size: np.ndarray) -> np.ndarray:
    """By word length: the root of the summed squared weights of a word's subsequences."""
    size = np.asarray(size, np.float64)
    total = sum(np.maximum(0, size + 2 - s[-1]) * DECAY ** (2 * (s[-1] - 1)) for s in OFFSETS)
    return np.sqrt(np.maximum(total, 1e-9))


def word_sums(codes, bounds, table: np.ndarray) -> np.ndarray:
    """Of each word, the normalised sum of the table over its subsequences."""
    flat = np.zeros(len(codes), np.float32)
    for at, rows, weight in subsequences(codes):
        flat[at] += weight * table[rows]
    size = np.diff(bounds) - 1
    total = np.add.reduceat(flat, bounds[:-1])[size > 0] if len(bounds) > 1 else flat[:0]
    return total / norms(size[size > 0]).astype(np.float32)


@dataclass
class Model:
    table: np.ndarray  # (2**BITS,) float32: the machine, by subsequence
    bias: float
    curve: np.ndarray  # logistic weights of the TOP margins, and a constant


def kernel_sum(words: list[str], table: np.ndarray) -> np.ndarray:
    """What each word adds to a sentence's margin."""
    out = []
    for i in range(0, len(words), 5000):
        codes, bounds, *_ = words_of(words[i : i + 5000])
        out.append(word_sums(codes, bounds, table.astype(np.float32)))
    return np.concatenate(out) if out else np.zeros(0, np.float32)


class Rows:
    """Words as sparse rows of the hashed, normalised subsequences."""

    def __init__(self, words: list[str]):
        codes, bounds, *_ = words_of(words)
        word = np.cumsum(codes == 0) - 1
        parts = [(word[at].astype(np.int32), rows.astype(np.int32), np.full(len(at), weight, np.float32)) for at, rows, weight in subsequences(codes)]
        self.row, self.column, self.value = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.n = len(bounds) - 1
        self.value /= norms(np.diff(bounds) - 1).astype(np.float32)[self.row]
        order = np.argsort(self.row, kind="stable")
        self.row, self.column, self.value = self.row[order], self.column[order], self.value[order]
        self.start = np.searchsorted(self.row, np.arange(self.n + 1))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], 1 << BITS)

    def one(self, k: int) -> np.ndarray:
        """Row k, filled out."""
        j = slice(self.start[k], self.start[k + 1])
        return np.bincount(self.column[j], self.value[j], 1 << BITS)


def in_turns(owner: np.ndarray):
    """Places of an array, dealt so that no value occurs twice in one turn: what is added by value then needs no care."""
    by = np.argsort(owner, kind="stable")
    turn = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
    order = by[np.argsort(turn, kind="stable")]
    ends = np.cumsum(np.bincount(turn)).tolist() if len(turn) else []
    yield from (order[a:b] for a, b in zip([0, *ends], ends, strict=False))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """(words, landmarks) of the normalised kernel, float32."""
    rows, marks = Rows(words), Rows(landmarks)
    # only table rows that some landmark has
    held, place = np.unique(marks.column, return_inverse=True)
    table = np.zeros((len(held) + 1, marks.n), np.float32)
    np.add.at(table, (place, marks.row), marks.value)
    index = np.full(1 << BITS, -1, np.int32)
    index[held] = np.arange(len(held))
    hit = np.flatnonzero(index[rows.column] >= 0)
    row, at, value = rows.row[hit], index[rows.column[hit]], rows.value[hit]
    out = np.zeros((rows.n, marks.n), np.float32)
    for h in in_turns(row):
        out[row[h]] += value[h, None] * table[at[h]]
    return out


def margins(model: Model, texts: list[str]) -> np.ndarray:
    """(texts, TOP): the highest sentence margins of each text, -1.5 where it has fewer sentences.

    Parts that punctuation separates, and windows of long runs, count as sentences of one word.
    """
    codes, bounds, text, sentence = words_of(texts)
    parts, inner = parts_of(texts), windows_of(codes, bounds, text, model.table)
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.zeros(0, int)
    value = word_sums(codes, bounds, model.table)
    value = np.add.reduceat(value, first) if len(first) else value
    value = np.concatenate([value, word_sums(parts[0], parts[1], model.table), inner[0]])
    text = np.concatenate([text[first], parts[2], inner[1]])
    value = np.clip(value + model.bias, -1.5, 1.5)
    order = np.lexsort((-value, text))
    value, text = value[order], text[order]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    out = np.full((len(texts), TOP), -1.5, np.float32)
    top = place < TOP
    out[text[top], place[top]] = value[top]
    return out


def score(model: Model, texts: list[str | None]) -> np.ndarray:
    """Scores from 0 to 1; null and empty texts score as texts without words."""
    m = np.concatenate([np.zeros((0, TOP), np.float32), *(margins(model, [t or "" for t in texts[a:b]]) for a, b in shared.pieces(texts, 1 << 19))])
    return 1 / (1 + np.exp(-(m @ model.curve[:-1] + model.curve[-1])))


def altered(words: tuple[str, ...], rng: np.random.Generator) -> tuple[str, ...]:
    """The sentence with a letter put into each word, or with one doubled."""
    out = []
    for word in words:
        i = int(rng.integers(1, max(2, len(word))))
        out.append(word[:i] + (chr(97 + int(rng.integers(26))) if rng.integers(2) else word[i - 1]) + word[i:])
    return tuple(out)


def sentences(text: str) -> list[tuple[str, ...]]:
    """The distinct sentences of a text, each as its words."""
    codes, bounds, _, sentence = words_of([text])
    words = [intern(w) for w in "".join(map(chr, codes)).split("\0") if w]
    edge = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])).tolist() if words else []
    return [*dict.fromkeys(tuple(words[a:b]) for a, b in zip(edge, [*edge[1:], len(words)], strict=False))]


def landmarks_of(weight: dict[str, float], n: int = LANDMARKS) -> list[str]:
    """Words picked one by one, the largest of weight times what the kernel's projection on those before leaves (a pivoted Cholesky factor)."""
    words = sorted(weight, key=lambda w: (-weight[w], w))[:CANDIDATES]
    rows, left = Rows(words), np.ones(len(words))
    share = np.array([weight[w] for w in words])
    factor, picked = np.zeros((min(n, len(words)), len(words)), np.float32), []
    for k in range(len(factor)):
        p = int(np.argmax(share * left))
        if left[p] < 1e-3:
            break
        factor[k] = (rows.dot(rows.one(p)) - factor[:k, p] @ factor[:k]) / np.sqrt(left[p])
        left = np.maximum(left - np.square(factor[k], dtype=np.float64), 0)
        left[p] = 0
        picked.append(words[p])
    return picked


class Landmarks:
    """The map of sentences to the landmarks' space, where the kernel is a dot product."""

    def __init__(self, words: list[str]):
        self.words, self.rows = words, Rows(words)
        own = kernel(words, words).astype(np.float64)
        self.factor = np.linalg.cholesky((own + own.T) / 2 + 1e-3 * np.eye(len(words)))

    def features(self, some: list[tuple[str, ...]]) -> np.ndarray:
        """(sentences, landmarks): sums over the words."""
        words = sorted({w for x in some for w in x})
        index = {w: k for k, w in enumerate(words)}
        flat = np.array([index[w] for x in some for w in x], np.int64)
        owner = np.repeat(np.arange(len(some)), [len(x) for x in some])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        out = np.zeros((len(some), len(self.words)), np.float32)
        for i in range(0, len(words), 10000):
            own = kernel(words[i : i + 10000], self.words)
            j = slice(*np.searchsorted(flat, [i, i + 10000]))
            for h in in_turns(owner[j]):
                out[owner[j][h]] += own[flat[j][h] - i]
        return out @ np.linalg.inv(self.factor).T.astype(np.float32)

    def table(self, theta: np.ndarray) -> np.ndarray:
        """The machine as one table by subsequence."""
        return self.rows.back(np.linalg.solve(self.factor.T, theta)).astype(np.float32)


def machine(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """A support vector machine with squared hinge loss, by Newton steps over the sentences within the margin; (weights, bias)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    ridge = np.append(np.full(x.shape[1] - 1, ridge * weight.sum()), 1e-6 * weight.sum())
    w = np.zeros(x.shape[1])

    def loss(f, w):
        return (weight * np.maximum(0, 1 - sign * f) ** 2).sum() + (ridge * w * w).sum()

    f = np.zeros(len(x))
    for _ in range(20):
        on = np.flatnonzero(sign * f < 1)
        own, scaled = x[on], x[on] * weight[on, None].astype(np.float32)
        step = np.linalg.solve((own.T @ scaled).astype(np.float64) + np.diag(ridge), scaled.T.astype(np.float64) @ sign[on]) - w
        move, size, now = x @ step, 1.0, loss(f, w)
        while size > 1e-3 and loss(f + size * move, w + size * step) > now:
            size /= 2
        w, f = w + size * step, f + size * move
        if now - loss(f, w) <= 1e-4 * now:
            break
    return w[:-1], float(w[-1])


class Half:
    """Labelled texts as sets of sentences, and the sentences that train a machine."""

    def __init__(self, rows: list[tuple[list, int]], rng: np.random.Generator):
        self.toxic = [own for own, y in rows if y and own]
        self.clean = [*dict.fromkeys(x for own, y in rows if not y for x in own)]
        self.rng = rng
        drawn = rng.choice(len(self.clean), min(len(self.clean), CLEAN), replace=False) if self.clean else []
        self.negative = [self.clean[i] for i in sorted(drawn)]
        self.x: np.ndarray | None = None  # features of these and of altered forms of some
        self.taken = set(self.negative)

    def margins(self, some: list[tuple[str, ...]], table: np.ndarray, bias: float) -> np.ndarray:
        words = sorted({w for x in some for w in x})
        each = dict(zip(words, kernel_sum(words, table).tolist(), strict=True))
        return np.array([sum(each[w] for w in x) + bias for x in some])

    def choose(self, table: np.ndarray, bias: float) -> list[tuple[tuple[str, ...], float]]:
        """Of each toxic text the sentences above 0 (CHOSEN at most), sharing its weight; without any the highest, at less weight."""
        flat = [x for own in self.toxic for x in own]
        value = np.split(self.margins(flat, table, bias), np.cumsum([len(own) for own in self.toxic])[:-1])
        out = []
        for own, v in zip(self.toxic, value, strict=True):
            best = [k for k in np.argsort(-v, kind="stable")[:CHOSEN] if v[k] > 0]
            out += [(own[k], 1 / len(best)) for k in best] or [(own[int(np.argmax(v))], ALONE)]
        return out

    def train(self, chosen: list, marks: Landmarks) -> tuple[np.ndarray, float]:
        """A machine over the chosen sentences and the negative ones, with altered forms of both."""
        more = [(altered(x, self.rng), 0.3 * w) for x, w in chosen]
        if self.x is None:
            self.x = marks.features([*self.negative, *(altered(x, self.rng) for x in self.negative[:: 1 + len(self.negative) // ALTERED])])
        own = [x for x, _ in (*chosen, *more)]
        sign = np.array([1.0] * len(own) + [-1.0] * len(self.x))
        weight = np.array([w for _, w in (*chosen, *more)] + [1.0] * len(self.x))
        weight[sign > 0] *= 0.5 * weight[sign < 0].sum() / weight[sign > 0].sum()
        theta, bias = machine(np.concatenate([marks.features(own), self.x]), sign, weight)
        table = marks.table(theta)
        value = self.margins(self.clean, table, bias)  # the clean sentences that come out highest join
        new = [self.clean[i] for i in np.argsort(-value, kind="stable")[:WORST] if value[i] > -1 and self.clean[i] not in self.taken]
        if new:
            self.taken.update(new)
            self.x = np.concatenate([self.x, marks.features(new)])
        return table, bias


def first_machine(rows: list[tuple[list, int]], marks: Landmarks) -> tuple[np.ndarray, float]:
    """A machine over whole texts, each the sum of its distinct words to unit scale: what toxic texts choose by at first, all their highest sentence."""
    toxic = [own for own, y in rows if y and own]
    clean = [own for own, y in rows if not y and own][: 2 * len(toxic)]
    bags = [tuple(sorted({w for x in own for w in x})) for own in (*toxic, *clean)]
    x = marks.features(bags) / np.sqrt(np.maximum(1, [len(b) for b in bags]))[:, None].astype(np.float32)
    scale = x.std(0) + 1e-6
    sign = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    theta, _ = machine((x - x.mean(0)) / scale, sign, np.where(sign > 0, len(clean) / len(toxic), 1.0), 0.1)
    return marks.table(theta / scale), -1e9


def learn(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """From (text, label): landmarks, then machines trained on the sentences of clean texts and those that each toxic text chooses.

    At first a toxic text chooses by a machine over whole texts; later by the machine trained on the other half of
    the texts, so no text chooses what was learned from itself.  The mean of both machines is the model; its logistic curve
    is fitted to the margins of texts by the machine of the other half.
    """
    rng = np.random.default_rng(seed)
    none = Model(np.zeros(1 << BITS, np.float32), -1.0, np.array([*[1.0] + [0.0] * (TOP - 1), -2.0]))
    by_label = [[r for r in rows if r[1] == y] for y in (0, 1)]
    sides = [[*by_label[0][k::2], *by_label[1][k::2]] for k in (0, 1)]
    parsed = [[(sentences(t), y) for t, y in side] for side in sides]
    halves = [Half(side, rng) for side in parsed]
    if not all(h.toxic and h.clean for h in halves):  # too few texts to halve
        sides, parsed = [rows], [[*parsed[0], *parsed[1]]]
        halves = [Half(parsed[0], rng)]
        if not halves[0].toxic or not halves[0].clean:
            return none
    share: dict[str, list[float]] = {}
    for own, y in (r for side in parsed for r in side):  # of texts of either label, those that have the word
        for w in {w for x in own for w in x}:
            share.setdefault(w, [0.0, 0.0])[y] += 1 / len(by_label[y])
    marks = Landmarks(landmarks_of({w: abs(a - b) + 0.1 * (a + b) for w, (a, b) in share.items()}))
    found = [first_machine([r for side in parsed for r in side], marks)] * len(halves)
    del share, parsed
    for turn in range(TURNS):
        judges = found if not turn else [*reversed(found)]
        found = [h.train(h.choose(*judge), marks) for h, judge in zip(halves, judges, strict=True)]
    model = Model(np.mean([t for t, _ in found], axis=0), float(np.mean([b for _, b in found])), np.zeros(TOP + 1))
    judges = [Model(t, b, none.curve) for t, b in reversed(found)]
    told = [(j, side[i : i + 200]) for j, side in zip(judges, sides, strict=True) for i in range(0, len(side), 200)]
    x = np.concatenate([margins(j, [t for t, _ in part]) for j, part in told])
    rows = [r for _, part in told for r in part]
    x, y = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64), np.array([float(t) for _, t in rows])
    use = np.ones(TOP + 1, bool)
    for _ in range(TOP):  # a higher margin never lowers the score: weights below zero are left out
        c = logistic(x[:, use], y)
        if (c[:-1] >= 0).all():
            break
        use[np.flatnonzero(use)[:-1][c[:-1] < 0]] = False
    model.curve[use] = c
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps; the last column is the constant."""
    c = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ c))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(len(c)), x.T @ (y - p) - 0.05 * c)
        c += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return c


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Learn from the labels of rows outside the held-out third; of each label a bounded sample, drawn by hashed id, is read.

    One task trains (a lost one is run again) and only the model, of fixed size, comes to the driver.  Null labels and null
    texts teach nothing; a doc_id with several labels counts as toxic if one of them is 1.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (shared.fold_of(F.col("doc_id")) != 1))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, toxic / counts.get(1, 1)))).otherwise(F.lit(min(1.0, clean / counts.get(0, 1))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) < share * (1 << 20)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).limit(2 * (toxic + clean))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(drawn), "doc_id").select("text", "toxic").limit(4 * (toxic + clean))

    def train(batches):
        rows = {(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        model = learn(sorted(rows))
        yield pa.RecordBatch.from_pylist([{"machine": model.table.astype("<f4").tobytes(), "bias": model.bias, "curve": model.curve.tolist()}])

    made = sample.coalesce(1).mapInArrow(train, "machine binary, bias double, curve array<double>").first()
    return Model(np.frombuffer(made["machine"], "<f4"), made["bias"], np.array(made["curve"])) if made else learn([])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row, from its whole text alone; a narrow map.  Null and empty texts are scored as empty, ties score alike."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(told.value, b.column(1).to_pylist()).astype(float))], ["doc_id", "score"])
            shared.trim()

    shared.small_batches(docs.sparkSession, rows=500, bytes_="4m")
    return shared.id_text(docs).mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, model).select("doc_id", (shared.fold_of(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
