"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors recomputed in double precision.

Queries and candidates are dealt into blocks by hash; each pair of a query block and a candidate block is one group of a
keyed join.  In a group, unit vectors are rounded to int8 with a scale each; the tile of products gives every cosine up
to a bound that follows from the rounding errors.  Pairs whose upper bound reaches the k-th best lower bound of their
query survive and are computed again from the original vectors.  Each group returns the k best of each of its queries;
these short lists meet by query and a bounded heap merges them, a stream of rows at a time.  The result is exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATES = 4096  # rows of a candidate block
QUERIES = 1024  # rows of a query block
SLICE = 64  # queries whose survivors are recomputed together

VALID = """vec_id is not null and embedding is not null and size(embedding) > 0 and exists(embedding, x -> x != 0)
    and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"""


def rounded(unit: np.ndarray):
    """(int8 values, scale, length of the rounding error) of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(np.square(unit - q * scale[:, None]).sum(1)) + 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of int8 rows, exactly: sums of at most 1,000 places fit a float's integers, longer rows are added up in parts."""
    total = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1000):
        total += a[:, i : i + 1000].astype(np.float32) @ b[:, i : i + 1000].astype(np.float32).T
    return total


def distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each id, by id: of several vectors the least in numeric order of components."""
    order = np.lexsort((*vectors.T[::-1], ids))
    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])] if len(ids) else order
    return ids[order], vectors[order]


def tile(query_ids, queries, ids, vectors, k: int) -> pd.DataFrame:
    """The k nearest of each query among these candidates: ``query_id, vec_id, score``; a candidate with the query's own id is left out."""
    (query_ids, queries), (ids, vectors) = distinct(query_ids, queries), distinct(ids, vectors)
    big = np.abs(vectors).max(1)
    top_q = np.abs(queries).max(1)
    v, q = vectors / big[:, None], queries / top_q[:, None]  # so that squares neither overflow nor vanish
    nv, nq = np.sqrt(np.square(v).sum(1)), np.sqrt(np.square(q).sum(1))
    a, sa, ea = rounded(q / nq[:, None])
    b, sb, eb = rounded(v / nv[:, None])
    out = []
    for i in range(0, len(q), SLICE):
        j = slice(i, i + SLICE)
        near = products(a[j], b) * sa[j, None] * sb
        slack = eb + (1 + eb) * ea[j, None]
        low, high = near - slack, near + slack
        own = query_ids[j, None] == ids
        low[own], high[own] = -np.inf, -np.inf
        if low.shape[1] > k:
            least = np.partition(low, -k, axis=1)[:, -k]
        else:
            least = np.full(len(low), -np.inf)
        row, col = np.nonzero((high >= least[:, None]) & ~own)
        score = np.empty(len(row))
        for s in range(0, len(row), 65536):
            r, c = row[s : s + 65536], col[s : s + 65536]
            score[s : s + 65536] = np.einsum("ij,ij->i", q[i + r], v[c]) / (nq[i + r] * nv[c])
        best = np.lexsort((ids[col], -score, row))
        row, col, score = row[best], col[best], score[best]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out.append(pd.DataFrame({"query_id": query_ids[i + row[keep]], "vec_id": ids[col[keep]], "score": score[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def merged(k: int):
    """Short lists (query_id, vec_id, score), sorted by query, to the k best of each query with their ranks."""

    def out(query: int, heap: list) -> dict:
        best = sorted(heap, reverse=True)
        return {"query_id": [query] * len(best), "rank": [*range(1, len(best) + 1)], "vec_id": [-v for _, v in best], "score": [s for s, _ in best]}

    def run(batches):
        query, heap = None, []
        schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            made = []
            for q, v, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if q != query:
                    if heap:
                        made.append(out(query, heap))
                    query, heap = q, []
                row = (s, -v)
                if len(heap) < k:
                    heapq.heappush(heap, row)
                elif row > heap[0]:
                    heapq.heapreplace(heap, row)
            if made:
                yield pa.RecordBatch.from_pydict({c: [x for m in made for x in m[c]] for c in schema.names}, schema=schema)
        if heap:
            yield pa.RecordBatch.from_pydict(out(query, heap), schema=schema)

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vec_id, embedding`` where ``is_query`` holds, its k nearest other rows by cosine.

    Vectors null, empty, zero or with null or non-finite components take no part, nor do null ids; vectors are compared
    with those of the same length.  Rows of one vec_id count once, as query and as candidate (of several vectors of one
    length the least by components).  Ties go to the smaller vec_id; fewer candidates than k give fewer rows, an empty table gives none.  Other
    columns fall away.
    """
    spark = vectors.sparkSession
    # each embedding is read anew from its source: what is shuffled is one copy per block of the other side
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("q")).where(VALID).withColumn("dim", F.size("embedding"))
    n, nq = rows.select(F.count("*"), F.count_if("q")).first()
    n_c, n_q = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(nq / QUERIES))
    hashed = F.xxhash64("vec_id", F.lit(3))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.where("q").select("dim", F.pmod(hashed, F.lit(n_q)).cast("int").alias("qb"), each(n_c).alias("cb"), "vec_id", "embedding")
    right = rows.select("dim", each(n_q).alias("qb"), F.pmod(hashed, F.lit(n_c)).cast("int").alias("cb"), "vec_id", "embedding")

    def group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return tile(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), k)
        read = lambda x: (x["vec_id"].to_numpy(np.int64), np.stack(x["embedding"].to_numpy()).astype(np.float64))
        return tile(*read(left), *read(right), k)

    keys = ["dim", "qb", "cb"]
    short = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(group, "query_id long, vec_id long, score double")
    return short.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merged(k), "query_id long, rank int, vec_id long, score double")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


