"""Packing by power-of-two decomposition: no sequence crosses documents.

The ids of a document, its end id included, are cut into pieces of ``limit`` (a power of two) and then, for what is
left, of the powers of two that its binary form names, longest first.  Each piece is a whole sequence without padding, so
no sequence crosses documents.  ``bucketed`` then brings sequences of equal length together, so a batch takes one bucket;
what it moves is the rows of pieces, and a bucket is spread over as many partitions as tasks made it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, shared
from .codec import vocabulary

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out, at, size = [], 0, limit
    while at < n:
        while size > n - at:
            size >>= 1
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket`` (log2 of the length), and ``ids`` on demand.

    Null and empty texts hold the end id alone: one piece of length 1.  Repeated rows are packed each for itself; null
    doc_ids stay null.  ``sequence_id`` is the task's partition in the high bits and a counter in the low 33.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches):
        from pyspark import TaskContext

        model = bpe.load(path, own_merges=False)
        end = np.array([end_id], model.dtype)
        sequence = TaskContext.get().partitionId() << 33
        for b in batches:
            rows, kept = [[] for _ in range(8)], []
            for doc, ids in zip(b.column(0).to_pylist(), model.encode_many(b.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end])
                raw = memoryview(ids.astype("<u4").tobytes())
                for start, length in cuts(len(ids), limit):
                    row = (doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(ids), sequence, 0, length.bit_length() - 1)
                    for col, v in zip(rows, row, strict=True):
                        col.append(v)
                    if with_ids:
                        kept.append(ids[start : start + length])
                    sequence += 1
            types = [pa.int64()] * 7 + [pa.int32()]
            arrays = [pa.array(c, k) for c, k in zip(rows, types, strict=True)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        shared.trim()

    shared.small_batches(docs.sparkSession)
    return shared.id_text(docs).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def bucketed(pieces: DataFrame) -> DataFrame:
    """The pieces with equal lengths side by side: partitions by (bucket, packing task), sorted by bucket and sequence.

    The most frequent length is spread like any other, since no partition takes a whole bucket.
    """
    task = F.shiftright("sequence_id", 33)
    return pieces.repartition("bucket", task).sortWithinPartitions("bucket", "sequence_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(pack(shared.documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))
