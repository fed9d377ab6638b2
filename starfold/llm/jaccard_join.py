"""N-gram Jaccard join: MinHash bands, Bayesian pruning of candidates, exact verification.

1. Texts are classed by SHA-256; one of each class goes on.  Its five-word shingles give a MinHash signature.
2. Signatures are cut into bands; texts that agree in a band meet.  Where many meet, they are dealt into blocks, and
   every pair of blocks is one group, so that no group is large and no pair of texts becomes a row.
3. In a group, signatures are compared a step at a time; a pair is dropped once the posterior probability (uniform
   prior) that its similarity reaches the threshold falls below TOLERANCE.  Survivors give a spanning forest, its
   components over all groups are the candidate clusters.
4. The shingle sets of a cluster meet, again in blocks, and every pair is verified exactly.  Each text gets its number of
   links, and the links' components are the classes.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .graph import components
from .shingles import shingles

THRESHOLD = (4, 5)  # similarity, as a fraction
BANDS, ROWS = 25, 5  # a pair at the threshold meets with probability 1 - (1 - 0.8**5)**25 = 0.99995
SIZE = BANDS * ROWS
STEP = 25  # signature places compared before each look at the posterior
TOLERANCE = 1e-5
BLOCK = 256  # texts of a block
FEW = 12  # up to so many texts a group is compared pair by pair, from there on as a matrix


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_11)
    return rng.integers(0, 1 << 32, SIZE, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SIZE, np.uint32)


def signatures(texts: list[str | None]) -> list[bytes | None]:
    """MinHash signatures, SIZE four-byte values each; None for texts without words."""
    made = []
    for i, j in shared.pieces(texts):
        flat, counts = shingles(texts[i:j])
        low = ((flat >> np.uint64(32)) ^ flat).astype(np.uint32)
        has = counts > 0
        out = np.zeros((has.sum(), SIZE), np.uint32)
        if len(out):
            first = (np.cumsum(counts) - counts)[has]
            for k, (a, b) in enumerate(zip(*permutations(), strict=True)):
                out[:, k] = np.minimum.reduceat(low * a + b, first)
        rows = iter(out)
        made += [next(rows).tobytes() if h else None for h in has]
    return made


def least_matches() -> list[tuple[int, int]]:
    """(places compared, matches needed): fewer matches put P(similarity >= threshold) below TOLERANCE.

    With m of n matches and a uniform prior the similarity is Beta(m + 1, n - m + 1), whose upper tail at t is the lower
    tail of a binomial: P(Bin(n + 1, t) <= m).
    """
    t = THRESHOLD[0] / THRESHOLD[1]
    out = []
    for n in range(STEP, SIZE + 1, STEP):
        tail, m = 0.0, -1
        while tail < TOLERANCE:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of signatures (a[i], b[i]) live through the incremental comparison."""
    alive, done, same = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n, need in least_matches():
        same = same + (a[alive, done:n] == b[alive, done:n]).sum(1)
        keep = same >= need
        alive, same, done = alive[keep], same[keep], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def met_before(a: np.ndarray, b: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which pairs agree in an earlier band, where they are compared instead."""
    equal = (a == b).reshape(len(a), BANDS, ROWS).all(2)
    return equal.argmax(1) < band


def labelled(adjacent: np.ndarray) -> np.ndarray:
    """The least index of each node's component."""
    label = np.arange(len(adjacent))
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs(batches):
    """Consecutive rows of equal key (the first three columns) of sorted batches: (table of whole groups, bounds of the groups)."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        bounds = _bounds(t)
        if len(bounds) > 2:
            yield t.slice(0, int(bounds[-2])), bounds[:-1]
        rest = t.slice(int(bounds[-2])).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest, _bounds(rest)


def _bounds(t: pa.Table) -> np.ndarray:
    keys = [t.column(k).to_pylist() if pa.types.is_binary(t.schema.field(k).type) else t.column(k).to_numpy() for k in range(3)]
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        k = np.array(k, dtype=object) if isinstance(k, list) else k
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def prune(batches):
    """From rows (key, lo, hi, band, block, th, sig), sorted: edges ``u, v`` of a forest over the pairs that survive."""
    for t, bounds in runs(batches):
        th = t.column("th").to_pylist()
        block, band = t.column("block").to_numpy(), t.column("band").to_numpy()
        cross = t.column("lo").to_numpy() != t.column("hi").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, SIZE)
        size = np.diff(bounds)
        group = np.repeat(np.arange(len(size)), size)
        small = size[group] <= FEW
        u, v = [], []
        for d in range(1, FEW):
            i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d])) if len(group) > d else np.zeros(0, int)
            i = i[~cross[i] | (block[i] != block[i + d])]
            if len(i):
                i = i[~met_before(sig[i], sig[i + d], band[i])]
                i = i[survivors(sig[i], sig[i + d])]
                u += i.tolist()
                v += (i + d).tolist()
        for g in np.flatnonzero(size > FEW):
            a, m = int(bounds[g]), int(size[g])
            s = sig[a : a + m]
            equal = np.zeros((m, m), bool)
            for k in range(int(band[a])):
                w = np.unique(s[:, k * ROWS : (k + 1) * ROWS], axis=0, return_inverse=True)[1].reshape(-1)
                equal |= w[:, None] == w[None, :]
            pairs = np.triu(~equal, 1)
            if cross[a]:
                pairs &= block[a : a + m, None] != block[None, a : a + m]
            x, y = np.nonzero(pairs)
            adjacent = np.zeros((m, m), bool)
            for k in range(0, len(x), 1 << 15):
                xs, ys = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
                ok = survivors(s[xs], s[ys])
                adjacent[xs[ok], ys[ok]] = adjacent[ys[ok], xs[ok]] = True
            root = labelled(adjacent)
            hit = np.flatnonzero(root != np.arange(m))
            u += (a + root[hit]).tolist()
            v += (a + hit).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([th[i] for i in u], pa.binary()), pa.array([th[i] for i in v], pa.binary())], ["u", "v"])
    shared.trim()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    m = len(sets)
    if m <= 3:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    often = np.bincount(place, minlength=len(values)) > 1
    new = np.cumsum(often) - 1
    keep = often[place]
    place, owner = new[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((m, m), np.float64)
    for c in range(0, int(often.sum()), 4096):
        k = slice(*np.searchsorted(place, [c, c + 4096]))
        has = np.zeros((m, 4096), np.float32)
        has[owner[k], place[k] - c] = 1
        out += has @ has.T
    return out.astype(np.int64)


def verify(batches):
    """From rows (cluster, lo, hi, block, th, text), sorted: ``th, root, links`` of each text in each group, by exact similarity."""
    top, bottom = THRESHOLD
    for t, bounds in runs(batches):
        names, texts = t.column("th").to_pylist(), t.column("text").to_pylist()
        block = t.column("block").to_numpy()
        cross = t.column("lo").to_numpy() != t.column("hi").to_numpy()
        th, root, links = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = list({names[i]: i for i in range(b - 1, a - 1, -1)}.values())[::-1]  # repeated rows count once
            flat, counts = shingles([texts[i] for i in rows])
            ends = np.cumsum(counts)
            sets = [np.unique(flat[e - c : e]) for e, c in zip(ends, counts, strict=True)]
            n = np.array([len(s) for s in sets])
            both = overlaps(sets)
            linked = (both * (top + bottom) >= top * (n[:, None] + n[None, :])) & (both > 0)
            np.fill_diagonal(linked, False)
            if cross[a]:
                own = block[rows]
                linked &= own[:, None] != own[None, :]
            least = labelled(linked)
            for k, i in enumerate(rows):
                th.append(names[i])
                root.append(names[rows[least[k]]])
                links.append(int(linked[k].sum()))
        yield pa.RecordBatch.from_arrays([pa.array(th, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64())], ["th", "root", "links"])
    shared.trim()


def in_blocks(rows: DataFrame) -> DataFrame:
    """Deal the rows of each key into blocks of about BLOCK and repeat every row once for each block that its block must meet.

    Needs ``n``, the rows of the key.  Adds ``block, lo, hi``.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("th", F.lit(5)), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other", "n")


def text_classes(rows: DataFrame) -> DataFrame:
    """``th, rep, class_id, n_links, n_copies`` of each distinct text of ``doc_id, text, th``, written to the shared folder."""
    spark = rows.sparkSession
    shared.small_batches(spark, rows=1000, bytes_="4m")

    def sign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(signatures(b.column(2).to_pylist()), pa.binary())], ["doc_id", "th", "sig"])
        shared.trim()

    signed = rows.select("doc_id", "th", "text").mapInArrow(sign, "doc_id long, th binary, sig binary")
    texts, texts_path = shared.written(signed.groupBy("th").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig")), "texts")
    banded = texts.where("sig is not null").select("th", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig")
    banded = banded.select(F.xxhash64("band", F.substring("sig", F.col("band") * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("key"), "band", "th")
    met = banded.join(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    dealt = in_blocks(met).join(texts.select("th", "sig"), "th").select("key", "lo", "hi", "band", "block", "th", "sig")
    forest = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(prune, "u binary, v binary")
    clusters = components(forest)
    clusters = clusters.select(F.col("u").alias("th"), F.col("v").alias("cluster")).unionByName(clusters.select(F.col("v").alias("th"), F.col("v").alias("cluster")).distinct())
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster").join(texts.select("th", F.col("rep").alias("doc_id")), "th")
    sized = sized.select(F.col("doc_id").alias("rep"), F.col("th").alias("_th"), "cluster", "n")
    held = rows.select("doc_id", "th", "text").join(sized, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("_th"))).select("th", "cluster", "n", "text")
    checked = in_blocks(held).select("cluster", "lo", "hi", "block", "th", "text").repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(verify, "th binary, root binary, links long")
    checked, checked_path = shared.written(checked, "links")
    roots = components(checked.select(F.col("th").alias("u"), F.col("root").alias("v")))
    linked = checked.groupBy("th").agg(F.sum("links").alias("links"))
    known = texts.select("th", "rep", "n_copies").join(linked, "th", "left").join(roots.select(F.col("u").alias("th"), F.col("v").alias("root")), "th", "left").withColumn("root", F.coalesce("root", "th"))
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = known.join(least, "root").select("th", "rep", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"), "n_copies")
    known, _ = shared.written(known, "classes")
    shared.remove(spark, texts_path, checked_path)
    return known


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``th``, the SHA-256 of the text (null: empty)."""
    return docs.withColumn("th", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` of every row.

    Rows are linked if their shingle sets have a Jaccard similarity of 0.8 or more; a class is a component of links and
    equal texts, and ``class_id`` its least doc_id.  ``n_links`` counts the other texts (not rows) that a row's text is
    linked to, ``n_copies`` the rows of equal text.  Null and empty texts are equal to each other and link to nothing;
    repeated rows are copies; other columns fall away.
    """
    rows = keyed(shared.id_text(docs))
    return rows.select("doc_id", "th").join(text_classes(rows), "th").select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each class the row with the least doc_id (nulls: one of them)."""
    own = {k: f"_starfold_{k}" for k in ("id", "th", "kept", "rep")}  # names that no column of docs has
    rows = docs.withColumn(own["id"], F.col("doc_id").cast("long")).withColumn(own["th"], F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))
    known = text_classes(keyed(shared.id_text(docs))).where(F.col("rep").eqNullSafe(F.col("class_id")))
    # texts of one class that share the least doc_id: the least hash stays
    kept = known.groupBy("class_id").agg(F.min("th").alias(own["kept"])).withColumnRenamed("class_id", own["rep"])
    joined = rows.join(kept, (F.col(own["th"]) == F.col(own["kept"])) & F.col(own["id"]).eqNullSafe(F.col(own["rep"])))
    return joined.dropDuplicates([own["id"], own["th"]]).drop(*own.values())


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(shared.documents(spark, sf_dir))
