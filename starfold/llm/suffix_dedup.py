"""Suffix-array deduplication of byte strings that repeat anywhere in a corpus.

Which bytes go: those of every 100-byte string that also starts earlier, in a smaller doc_id or before in the same
document.  Only suffixes at anchors are sorted (see ``suffixes``; no repeat is lost).

1. Every batch of texts tells the buckets of its anchors' k-gram hashes which hashes it holds; a bucket answers the blocks
   of documents with the hashes that occur elsewhere too.  Hashes that repeat inside a batch need no question: one
   entry of them is sent, so a k-gram found everywhere costs each batch one entry.
2. Blocks (documents dealt by doc_id) take the contexts of the anchors that repeat.  Equal contexts of a block are settled
   in it and one of them goes on.  Contexts are dealt into ranges by sampled splitters on the leading bytes of their
   suffix, and each range into parts by k-gram hash, which keeps equal k-grams together.  A k-gram with very many different contexts in one block is settled by that block, and its first windows go to
   step 4; a mark tells its range to do the same.
3. Ranges sort their suffixes by multikey quicksort; equal k-grams are then neighbours, and windows with equal bytes are
   found among them: all but the first by (doc_id, place) are repeats.
4. First windows of k-grams that were split over several sorters are compared across these boundaries, by SHA-256.
5. Blocks join the spans of their documents and cut.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .suffixes import GRAM, PREFIX, WIDTH, Contexts, anchors, as_spans, digests, gathered, repeated_windows, sorted_contexts

BLOCK_BYTES = 12 << 20  # text bytes of a block
PIECE = 1 << 20  # text bytes whose anchors are found together
RANGES = 4096  # bound of the number of ranges; more data deal each range on into more parts
PARTS = 4  # parts of a range by k-gram hash, at least, so that a prefix that many k-grams share is not one group
SAMPLES = 16  # sampled suffixes for each range
SPREAD = 20_000  # contexts of one k-gram over all blocks beyond which blocks settle it themselves
ROWS = "kind int, a int, b int, block int, raw binary"
ASK, TELL, SAMPLE = 0, 1, 2
CONTEXT, SPAN_, WINDOW = 0, 1, 2
NO_ID = -(1 << 63)  # stands for a null doc_id inside
COPY = 1 << 40  # place of the next row with the same doc_id


def joined(texts: list[bytes]):
    """Pieces of about PIECE bytes of whole texts: (numbers of the texts, bytes, ends)."""
    some, size = [], 0
    for i, t in enumerate(texts):
        some.append(i)
        size += len(t)
        if size >= PIECE or i + 1 == len(texts):
            raw = b"".join([texts[k] for k in some])
            yield np.array(some), np.frombuffer(raw, np.uint8), np.cumsum([len(texts[k]) for k in some])
            some, size = [], 0


def by_value(value: np.ndarray):
    """(value, rows) for each distinct value."""
    if not len(value):
        return
    o = np.argsort(value, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], value[o][1:] != value[o][:-1]]))
    for a, b in zip(cut, [*cut[1:], len(o)], strict=True):
        yield int(value[o[a]]), o[a:b]


def rows_of(rows: list[tuple]) -> pd.DataFrame:
    shared.trim()
    return pd.DataFrame(rows, columns=["kind", "a", "b", "block", "raw"]).astype({"kind": "int32", "a": "int32", "b": "int32", "block": "int32"})


def packed_spans(kind_rows: list, block, doc, start, end) -> None:
    s = as_spans(block, doc, start, end)
    for b, r in by_value(s.block):
        kind_rows.append((SPAN_, b, 0, b, zstandard.compress(np.concatenate([s.doc[r], s.start[r], s.end[r]]).astype("<i8").tobytes(), 1)))


def packed_windows(kind_rows: list, n_buckets: int, block, doc, at, digest) -> None:
    for b, r in by_value((digest[:, 0] & ((1 << 31) - 1)) % n_buckets):
        raw = np.concatenate([*digest[r].T, doc[r], at[r], block[r]]).astype("<i8").tobytes()
        kind_rows.append((WINDOW, b, 0, -1, zstandard.compress(raw, 1)))


def asked(n_blocks: int):
    """Step 1, per batch of (block, text)."""

    def run(batches):
        for pdf in batches:
            texts = [t.encode() for t in pdf["text"]]
            block_of = pdf["block"].to_numpy(np.int64)
            h, block, prefix = [], [], []
            for some, data, ends in joined(texts):
                place, _, _, hashes = anchors(data, ends)
                h.append(hashes)
                block.append(block_of[some[np.searchsorted(ends, place, "right")]])
                drawn = place[:: max(1, len(place) // 32)]
                prefix += [data[p : p + PREFIX].tobytes() for p in drawn]
            h, block = np.concatenate(h) if h else np.zeros(0, np.uint64), np.concatenate(block) if block else np.zeros(0, np.int64)
            o = np.lexsort((block, h))
            h, block = h[o], block[o]
            same_h = np.concatenate([h[1:] == h[:-1], [False]]) if len(h) else np.zeros(0, bool)
            again = same_h | np.concatenate([[False], same_h[:-1]]) if len(h) else same_h
            first = again & np.concatenate([[True], ~same_h[:-1]]) if len(h) else same_h
            ask_h, ask_b = np.concatenate([h[~again], h[first]]), np.concatenate([block[~again], np.full(first.sum(), -1)])
            rows = []
            for b, r in by_value((ask_h >> np.uint64(40)).astype(np.int64) % n_blocks):
                rows.append((ASK, b, 0, -1, ask_h[r].tobytes() + ask_b[r].astype("<i4").tobytes()))
            tell_h, tell_b = h[again], block[again]
            new = np.concatenate([[True], (tell_h[1:] != tell_h[:-1]) | (tell_b[1:] != tell_b[:-1])]) if len(tell_h) else np.zeros(0, bool)
            tell_h, tell_b = tell_h[new], tell_b[new]
            rows += [(TELL, b, 0, b, tell_h[r].tobytes()) for b, r in by_value(tell_b)]
            rows += [(SAMPLE, 0, 0, -1, p) for p in prefix]
            yield rows_of(rows)

    return run


def answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 1, per bucket: which of the asking blocks have a hash that occurs elsewhere."""
    hs, bs = [], []
    for raw in pdf["raw"]:
        n = len(raw) // 12
        hs.append(np.frombuffer(raw, "<u8", n))
        bs.append(np.frombuffer(raw, "<i4", n, 8 * n))
    h, b = np.concatenate(hs), np.concatenate(bs)
    o = np.argsort(h, kind="stable")
    h, b = h[o], b[o]
    same = h[1:] == h[:-1]
    again = (np.concatenate([same, [False]]) | np.concatenate([[False], same])) & (b >= 0)
    return rows_of([(TELL, k, 0, k, h[again][r].tobytes()) for k, r in by_value(b[again].astype(np.int64))])


def in_order(docs: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by (doc_id, text); (rows, ids, offset that keeps rows of one doc_id apart)."""
    docs = docs.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)
    return docs, docs["doc_id"].to_numpy(np.int64), docs.groupby("doc_id").cumcount().to_numpy() * COPY


def settle(c: Contexts, gram, rows: list, exchange: np.ndarray, n_buckets: int) -> None:
    """Windows of distinct contexts that share k-grams: repeats become spans; first windows of ``exchange`` contexts go on."""
    parts = []
    for ctx, win, again, place in repeated_windows(c, gram):
        parts.append((ctx[again], win[again]))
        go = ~again & exchange[ctx]
        if go.any():
            packed_windows(rows, n_buckets, c.block[ctx[go]], c.doc[ctx[go]], c.at[ctx[go]] + win[go], digests(c.data, place[go]))
    if parts:
        ctx, win = (np.concatenate(x) for x in zip(*parts, strict=True))
        start = c.at[ctx] + win
        packed_spans(rows, c.block[ctx], c.doc[ctx], start, start + WIDTH)


def spread(block: int, docs: pd.DataFrame, told: np.ndarray, splitters: np.ndarray, subs: int, n_blocks: int) -> pd.DataFrame:
    """Step 2, per block."""
    docs, ids, apart = in_order(docs)
    texts = [t.encode() for t in docs["text"]]
    parts = []
    for some, data, ends in joined(texts):
        place, first, last, h = anchors(data, ends)
        keep = np.isin(h, told) if len(told) else np.zeros(len(h), bool)
        place, first, last = place[keep], first[keep], last[keep]
        size = last - first + WIDTH
        own = np.searchsorted(ends, first, "right")
        begin = ends[own] - np.diff(ends, prepend=0)[own]
        parts.append((gathered(data, first, size), place - first, last - first + 1, ids[some[own]], first - begin + apart[some[own]]))
    rows: list = []
    if not parts:
        return rows_of(rows)
    data, left, n, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = n + (WIDTH - 1)
    c = Contexts(data, np.cumsum(size) - size, left, n, doc, at, np.full(len(n), block))
    order, gram, same = sorted_contexts(c)
    extra = order[same != np.arange(len(same))]  # equal contexts of the block but the first
    packed_spans(rows, c.block[extra], c.doc[extra], c.at[extra], c.at[extra] + c.n[extra] - 1 + WIDTH)
    kept = same == np.arange(len(same))
    order, gram = order[kept], gram[kept]
    counts = np.unique(gram, return_inverse=True, return_counts=True)
    many = counts[2][counts[1]] > max(2, SPREAD // n_blocks) if len(gram) else np.zeros(0, bool)
    if many.any():
        settle(c.take(order[many]), gram[many], rows, np.ones(int(many.sum()), bool), n_blocks)
        heads = order[many][np.unique(gram[many], return_index=True)[1]]
    else:
        heads = order[:0]
    for mark, who in ((0, order[~many]), (1, heads)):
        d = c.take(who)
        if not len(d):
            continue
        at0 = d.off + d.left
        prefix = np.ascontiguousarray(d.data[at0[:, None] + np.arange(PREFIX)]).view(f"S{PREFIX}").reshape(-1)
        r = np.searchsorted(splitters, prefix, "right") if len(splitters) else np.zeros(len(d), np.int64)
        sub = (anchors_hash(d) % np.uint64(subs)).astype(np.int64) if subs > 1 else np.zeros(len(d), np.int64)
        for key, k in by_value(r * subs + sub):
            rows.append((CONTEXT, key // subs, key % subs, block if not mark else -1 - block, zstandard.compress(d.take(k).pack(), 1)))
    return rows_of(rows)


def anchors_hash(c: Contexts) -> np.ndarray:
    """A hash of each context's k-gram."""
    at = c.off + c.left
    a = np.zeros(len(c), np.uint64)
    view = np.ndarray((max(0, len(c.data) - 7),), ">u8", c.data, strides=(1,))
    for o in (0, 8, 16, 24, GRAM - 8):
        a = (a ^ view[at + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        a = a ^ (a >> np.uint64(29))
    return a


def ranged(n_blocks: int):
    """Step 3, per range: sort, find repeats; spans and windows of step 2 pass through."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] != CONTEXT:
            return pdf[["kind", "a", "b", "block", "raw"]]
        blocks = pdf["block"].tolist()
        c = Contexts.unpack([zstandard.decompress(r) for r in pdf["raw"]], blocks)
        order, gram, same = sorted_contexts(c)
        marked = np.unique(gram[c.block[order] < 0])  # k-grams that some block has settled by itself
        real = c.block[order] >= 0
        order, gram, same = order[real], gram[real], same[real]
        first = np.concatenate([[True], same[1:] != same[:-1]]) if len(same) else np.zeros(0, bool)
        rows: list = []
        extra = order[~first]
        packed_spans(rows, c.block[extra], c.doc[extra], c.at[extra], c.at[extra] + c.n[extra] - 1 + WIDTH)
        order, gram = order[first], gram[first]
        several = np.unique(gram, return_inverse=True, return_counts=True)
        go = np.isin(gram, marked)
        need = (several[2][several[1]] > 1) | go if len(gram) else np.zeros(0, bool)
        settle(c.take(order[need]), gram[need], rows, go[need], n_blocks)
        return rows_of(rows)

    return run


def compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 4, per bucket of window digests: all but the first equal window are repeats."""
    rows_ = np.concatenate([np.frombuffer(zstandard.decompress(r), "<i8").reshape(7, -1) for r in pdf["raw"]], axis=1)
    digest, (doc, at, block) = rows_[:4], rows_[4:]
    o = np.lexsort((at, doc, *digest))
    again = np.concatenate([[False], (digest[:, o[1:]] == digest[:, o[:-1]]).all(0)])
    o = o[again]
    rows: list = []
    packed_spans(rows, block[o], doc[o], at[o], at[o] + WIDTH)
    return rows_of(rows)


def cut(docs: pd.DataFrame, spans: pd.DataFrame, extra: list[str] | None) -> pd.DataFrame:
    """Step 5, per block."""
    docs, ids, apart = in_order(docs)
    texts = [t.encode() for t in docs["text"]]
    found = [np.frombuffer(zstandard.decompress(r), "<i8").reshape(3, -1) for r in spans["raw"]]
    doc, start, end = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    copy = start // COPY
    # the row of each span: rows are sorted by (id, copy)
    row = np.searchsorted(ids, doc, "left") + copy
    start, end = start - copy * COPY, end - copy * COPY
    o = np.argsort(row, kind="stable")
    row, start, end = row[o], start[o], end[o]
    out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    for some, data, ends in joined(texts):
        begin = ends - np.diff(ends, prepend=0)
        a, b = np.searchsorted(row, [some[0], some[-1] + 1])
        base = begin[row[a:b] - some[0]]
        step = np.bincount(base + start[a:b], minlength=len(data) + 1) - np.bincount(base + end[a:b], minlength=len(data) + 1)
        gone = np.cumsum(step)[:-1] > 0
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = begin[(begin > 0) & (begin < len(data))]
        head[inner] = gone[inner]
        total, heads = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, head))
        left = data[~gone].tobytes()
        for x, y in zip(begin.tolist(), ends.tolist(), strict=True):
            kept = left[x - total[x] : y - total[y]]
            out["n_bytes"].append(y - x)
            out["n_removed"].append(int(total[y] - total[x]))
            out["n_spans"].append(int(heads[y] - heads[x]))
            out["kept_sha256"].append(sha256(kept).hexdigest())
            out["kept"].append(kept.decode("utf-8", "ignore"))
    made = pd.DataFrame(out, index=docs.index)
    made = made.drop(columns="kept") if extra is None else made
    shared.trim()
    return pd.concat([docs[["doc_id", *(extra or [])]], made], axis=1)


def _cut(docs: DataFrame, extra: list[str] | None) -> DataFrame:
    """The operator; columns ``extra`` of docs come back as x0, x1, ... beside ``kept``, the text left."""
    spark = docs.sparkSession
    shared.small_batches(spark, rows=4000, bytes_="8m")
    own = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra or [])]
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    rows = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"), *own)
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BLOCK_BYTES))
    ranges = min(n_blocks, RANGES)
    subs = PARTS * math.ceil(n_blocks / ranges)
    blocked = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(n_blocks)).cast("int"))

    first, first_path = shared.written(blocked.select("block", "text").mapInPandas(asked(n_blocks), ROWS), "asks")
    samples = first.where(F.col("kind") == SAMPLE)
    n = samples.count()
    share = min(1.0, SAMPLES * ranges / max(n, 1))
    drawn = samples.where(F.pmod(F.xxhash64("raw", F.monotonically_increasing_id()), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * SAMPLES * ranges).select("raw").collect()
    prefix = np.sort(np.array([bytes(r["raw"]) for r in drawn], f"S{PREFIX}"))
    splitters = np.unique(prefix[[len(prefix) * k // ranges for k in range(1, ranges)]]) if len(prefix) else prefix
    replies = first.where(F.col("kind") == ASK).groupBy("a").applyInPandas(answered, ROWS)
    told, told_path = shared.written(replies.unionByName(first.where(F.col("kind") == TELL)), "told")
    shared.remove(spark, first_path)
    shared.release_shuffles(spark)

    def block_step(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(r, "<u8") for r in right["raw"]]
        return spread(int(key[0]), left, np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64), splitters, subs, n_blocks)

    dealt = blocked.select("block", "doc_id", "text").groupBy("block").cogroup(told.select(F.col("a").alias("block"), "raw").groupBy("block")).applyInPandas(block_step, ROWS)
    found, _ = shared.written(dealt.groupBy("kind", "a", "b").applyInPandas(ranged(n_blocks), ROWS), "spans")
    shared.remove(spark, told_path)
    shared.release_shuffles(spark)
    across = found.where(F.col("kind") == WINDOW).groupBy("a").applyInPandas(compared, ROWS)
    spans = found.where(F.col("kind") == SPAN_).unionByName(across).select(F.col("a").alias("block"), "raw")

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = None if extra is None else [f"x{i}" for i in range(len(extra))]
    result = ["doc_id long", *(f"{c} {kinds[c]}" for c in names or []), "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", *(["kept string"] if extra is not None else [])]
    out = blocked.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(lambda key, left, right: cut(left, right, names), ", ".join(result))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Null texts are read as empty; texts under 100 bytes lose nothing.  Null doc_ids come before all others; rows of one
    doc_id count as a sequence in text order, so the second of two repeated rows goes.  An empty table gives an empty
    result; other columns fall away.
    """
    return _cut(docs, None)


def cut_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts: same columns, ``n_chars`` (where there is one) counted anew.

    Bytes that a cut left of a character go too.  Rows stay even if nothing is left of them.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = _cut(docs, extra)
    name = {c: F.col(f"x{i}") for i, c in enumerate(extra)} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept")}
    if "n_chars" in name:
        name["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*(name[c].alias(c) for c in docs.columns))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(shared.documents(spark, sf_dir))
