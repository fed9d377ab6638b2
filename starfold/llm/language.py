"""Language identification of whole texts, spans of mixed texts included.

Training counts hashed character n-grams of a bounded sample of labelled texts.  Prediction works on flat code-point
arrays: words are runs of letters; the script of a word narrows its candidate languages; each word gets a score per
candidate from its n-grams; Viterbi over the words of a text, with a penalty for every switch, labels spans.  All texts
of a batch advance together, one word a step, so no step runs per word in Python.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BITS = 17  # log2 of the n-gram table's rows
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 1000  # bound of the training sample: expected texts of a language
SWITCH_PENALTY = 9.0  # nats for a change of language between neighbouring words
CLIP = 6.0  # the most that one word can speak against a language
MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))

# Blocks of code points by script (first, last, script).
SCRIPTS = (
    (0x0041, 0x024F, 1), (0x0370, 0x03FF, 2), (0x0400, 0x052F, 3), (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5), (0x0600, 0x077F, 6),
    (0x0900, 0x097F, 7), (0x0980, 0x09FF, 8), (0x0A00, 0x0A7F, 9), (0x0A80, 0x0AFF, 10), (0x0B00, 0x0B7F, 11), (0x0B80, 0x0BFF, 12),
    (0x0C00, 0x0C7F, 13), (0x0C80, 0x0CFF, 14), (0x0D00, 0x0D7F, 15), (0x0D80, 0x0DFF, 16), (0x0E00, 0x0E7F, 17), (0x0E80, 0x0EFF, 18),
    (0x1000, 0x109F, 19), (0x10A0, 0x10FF, 20), (0x1100, 0x11FF, 21), (0x1200, 0x139F, 22), (0x1780, 0x17FF, 23), (0x1E00, 0x1EFF, 1),
    (0x1F00, 0x1FFF, 2), (0x3040, 0x309F, 24), (0x30A0, 0x30FF, 25), (0x3400, 0x4DBF, 26), (0x4E00, 0x9FFF, 26), (0xAC00, 0xD7AF, 21),
    (0xF900, 0xFAFF, 26), (0x20000, 0x3FFFF, 26),
)
N_SCRIPTS = 27
UNSPACED = (17, 18, 19, 23, 24, 25, 26)  # scripts that write no spaces between words
UNIT = (24, 4)  # letters of a scored unit at most, elsewhere and in such scripts

_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """By code point: whether it is a letter or mark, its script, and whether it is a letter."""
    if not _tables:
        letter = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
        script = np.zeros(0x110000, np.uint8)
        for a, b, s in SCRIPTS:
            script[a : b + 1] = s
        alone = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
        _tables.extend([letter, script, alone])
    return _tables


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (2**BITS, languages) float32: log probability of an n-gram
    allowed: np.ndarray  # (scripts, languages) bool


def lowered(text: str) -> str:
    """Lower case of the same length, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def units(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut where the script changes and into stretches of UNIT letters, so that a run without spaces weighs as many words."""
    script = tables()[1][codes]
    size = ends - starts
    place = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    own, before = script[place], script[place - 1]
    first = np.zeros(len(place), bool)
    first[np.cumsum(size) - size] = True
    first |= (own != before) & (own > 0) & (before > 0)
    run = np.flatnonzero(first)
    lone = np.isin(np.arange(N_SCRIPTS), UNSPACED)
    most = np.where(lone[own[run]], UNIT[1], UNIT[0])
    long = np.diff(np.append(run, len(place)))
    at = np.arange(len(place)) - np.repeat(run, long)
    first |= at % np.repeat(most, long) == 0
    starts = place[first]
    return starts, place[np.append(np.flatnonzero(first)[1:], len(place)) - 1] + 1 if len(starts) else ends[:0]


def words_of(texts: list[str]):
    """(codes, starts, ends, word's text, text's begin): code points of all texts, one zero before, between and after; words (see ``units``) as ranges of it."""
    codes = np.frombuffer(("\0" + "\0".join(lowered(t) for t in texts) + "\0").encode("utf-32-le"), np.uint32)
    begin = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    letter = tables()[0][codes]
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = units(codes, change[::2], change[1::2])
    letters = np.cumsum(tables()[2][codes], dtype=np.int32)
    real = letters[ends - 1] > letters[starts - 1]  # marks alone are no word
    starts, ends = starts[real], ends[real]
    return codes, letter, starts, ends, np.searchsorted(begin, starts, "right") - 1, begin


def hashed(codes: np.ndarray, letter: np.ndarray, order: int):
    """(places, rows): the n-grams of this order that lie in a word and its two bounds; others than the bounds are letters."""
    low = np.where(letter, codes, 0)
    n = len(low) - order + 1
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h = (h ^ (low[k : k + n] * MULT[k])) * np.uint32(0x01000193)
    inner = letter[:n] if order == 1 else np.ones(n, bool)
    if order == 2:
        inner = letter[:n] | letter[1:]
    for k in range(1, order - 1):
        inner = inner & letter[k : k + n]
    at = np.flatnonzero(inner)
    return at, (h[at] ^ (h[at] >> np.uint32(15))) >> np.uint32(32 - BITS)


def word_scores(model: Model, codes, letter, starts, ends) -> np.ndarray:
    """(words, languages): log likelihood below the best candidate's, at least -CLIP; -CLIP for languages that the script rules out."""
    total = np.zeros((len(starts), len(model.languages)), np.float32)
    for order in ORDERS:
        at, rows = hashed(codes, letter, order)
        word = np.searchsorted(ends, at, "right")  # the bound before a word belongs to the word
        keep = word < len(starts)
        at, rows, word = at[keep], rows[keep], word[keep]
        if len(word):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            total[word[first]] += np.add.reduceat(model.table[rows], first, axis=0)
    can = model.allowed[tables()[1][codes[starts]]]
    can = can | ~can.any(1, keepdims=True)
    total[~can] = -np.inf
    total -= total.max(1, keepdims=True)
    return np.maximum(total, -CLIP)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of every word; ``counts`` says how many consecutive words each text has."""
    n_words, n_lang = scores.shape
    path = np.zeros(n_words, np.int16)
    if not n_words:
        return path
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    begin = (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts with more than t words
    came = np.zeros((n_words, n_lang), bool)  # whether the best way to here switched
    best = np.zeros(n_words, np.int16)  # the best language one word earlier
    v = np.zeros((len(sizes), n_lang), np.float32)
    for t in range(int(sizes[0])):
        k = active[t]
        at = begin[:k] + t
        now = v[:k]
        if t:
            top = now.argmax(1)
            other = now[np.arange(k), top] - penalty
            switched = other[:, None] > now
            best[at], came[at] = top, switched
            now = np.where(switched, other[:, None], now)
        now = now + scores[at]
        v[:k] = now - now.max(1, keepdims=True)
    state = v.argmax(1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        path[at] = state[:k]
        switched = came[at, state[:k]]
        state[:k] = np.where(switched, best[at], state[:k])
    return path


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from text and non-null lang of the rows outside the held-out third.

    Every language is learned.  The sample is bounded: each keeps rows whose hashed id falls below a share that is expected to give ``per_language`` texts; equal texts count once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (shared.fold_of(F.col("doc_id")) != 1))
    counts = rows.groupBy("lang").count().collect()
    names = sorted(r["lang"] for r in counts)
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, _share double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)
    sample = rows.join(F.broadcast(share), "lang").where(drawn).limit(2 * per_language * len(names)).select("lang", "text").collect()
    grams = np.zeros((1 << BITS, len(names)), np.float64)
    script = np.zeros((N_SCRIPTS, len(names)), np.float64)
    for k, name in enumerate(names):
        texts = sorted({r["text"] for r in sample if r["lang"] == name})
        codes, letter, *_ = words_of(texts)
        for order in ORDERS:
            grams[:, k] += np.bincount(hashed(codes, letter, order)[1], minlength=1 << BITS)
        script[:, k] = np.bincount(tables()[1][codes[letter]], minlength=N_SCRIPTS)
    table = np.log((grams + 0.3) / (grams.sum(0) + 0.3 * (1 << BITS))).astype(np.float32)
    allowed = script > 0.002 * np.maximum(script.sum(0), 1)
    return Model(names, table, allowed)


def familiar(model: Model, texts: list[str | None]) -> list[bool]:
    """Whether at least half the letters of each text are of scripts that some learned language uses; texts without letters are not."""
    known = model.allowed.any(1) if model.languages else np.ones(N_SCRIPTS, bool)
    out = []
    for a, b in shared.pieces(texts):
        some = [t or "" for t in texts[a:b]]
        codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        letter = tables()[2][codes]
        ends = np.cumsum([len(t) for t in some])
        all_, own = (np.diff(np.concatenate([[0], np.cumsum(w)])[np.concatenate([[0], ends])]) for w in (letter, letter & known[tables()[1][codes]]))
        out += ((all_ > 0) & (2 * own >= all_)).tolist()
    return out


def label(model: Model, texts: list[str | None], with_spans: bool = False):
    """(language, score, spans) of each text; ``und`` with score 0 if it is null or has no letter.

    The language is that of most letters; the score is the share of those letters times the language's posterior over
    the whole text.  Spans are (language, start, end) in code points.
    """
    texts = [t or "" for t in texts]
    n = len(model.languages)
    parts = []
    for a, b in shared.pieces(texts) if n else ():
        codes, letter, starts, ends, text, begin = words_of(texts[a:b])
        parts.append((word_scores(model, codes, letter, starts, ends), text + a, starts - begin[text], ends - begin[text]))
    if not sum(len(p[1]) for p in parts):
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    scores, text, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    counts = np.bincount(text, minlength=len(texts))
    path = viterbi(scores, counts)
    letters = np.bincount(text * n + path, weights=ends - starts, minlength=len(texts) * n).reshape(-1, n)
    whole = np.zeros((len(texts), n))
    has = np.flatnonzero(counts)
    whole[has] = np.add.reduceat(scores, (np.cumsum(counts) - counts)[has], axis=0)
    top = letters.argmax(1)
    soft = np.exp((whole - whole.max(1, keepdims=True)) / np.sqrt(np.maximum(counts, 1))[:, None])
    row = np.arange(len(texts))
    score = letters[row, top] / np.maximum(letters.sum(1), 1) * (soft[row, top] / soft.sum(1))
    spans: list[list] = [[] for _ in texts]
    if with_spans:
        edge = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])]))
        for a, b in zip(edge, [*edge[1:], len(path)], strict=True):
            d = text[a]
            spans[d].append({"lang": model.languages[path[a]], "start": int(starts[a]), "end": int(ends[b - 1])})
    found = [model.languages[k] if c else "und" for k, c in zip(top, counts, strict=True)]
    return found, np.where(counts > 0, np.clip(score, 0, 1), 0.0).tolist(), spans


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row; lang, source and doc_id play no part.  A narrow map.

    Null, empty and letterless texts are ``und`` with score 0 and no spans (all texts, where no language was learned);
    texts in scripts that no learned language uses get the nearest one, see ``familiar``; repeated rows are each
    labelled; an empty table gives an empty result.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            lang, score, spans = label(told.value, b.column(1).to_pylist(), True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])
            shared.trim()

    shared.small_batches(docs.sparkSession, rows=2000, bytes_="8m")
    return shared.id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    return predict(docs, fit(docs)).select("doc_id", (shared.fold_of(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
