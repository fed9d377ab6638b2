"""Token-ID files: flat unsigned integers with 64-bit document offsets, read through memory maps.

Documents are range-partitioned by ``doc_id`` and sorted; each partition becomes one shard of three flat files: ``ids``
(unsigned, two bytes when the vocabulary fits, else four), ``off`` (n+1 64-bit offsets in ids) and ``doc`` (64-bit
document ids).  The first id of a shard in the whole corpus is the prefix sum of the shard sizes, known once all shards
are written.  A file belongs to one task attempt; the table of shards, written afterwards, names the attempts that
count, so lost executors and repeated tasks leave only unused files.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, shared
from .codec import vocabulary

SHARDS = "shard int, n_docs long, n_tokens long, n_null long, width int, stem string"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def arrow_name(uri: str) -> str:
    """A folder that Spark names, as Arrow names it: Hadoop has its own schemes for one object store, and files need none."""
    scheme, rest = uri.split(":", 1) if ":" in uri else ("file", uri)
    if scheme == "file" and not rest.startswith("//"):
        rest = "//" + rest
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_name(uri))


class Far:
    """A flat file of a remote store as an array of which only slices are read."""

    def __init__(self, store, path: str, dtype: str):
        self.file, self.dtype = store.open_input_file(path), np.dtype(dtype)
        self.size = self.file.size() // self.dtype.itemsize

    def __getitem__(self, places: slice) -> np.ndarray:
        a, b, _ = places.indices(self.size)
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def _mapped(uri: str, dtype: str):
    """A read-only memory map; of a file in a remote store, ranges are read as they are asked for."""
    from pyarrow import fs

    store, path = _store(uri)
    if not isinstance(store, fs.LocalFileSystem):
        return Far(store, path, dtype)
    return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.zeros(0, dtype)


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int | None = 0) -> DataFrame:
    """Write the ids of all texts under ``folder`` in ascending ``doc_id`` order; returns the written table of shards.

    Null and empty texts hold the end id alone; null doc_ids come first; repeated ids stand side by side, by text.
    """

    def run(batches):
        from pyspark import TaskContext

        model = bpe.load(path, own_merges=False)
        stem = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        off, n_docs, n_null, files = 0, 0, 0, None
        end = np.array([] if end_id is None else [end_id], model.dtype).tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            if files is None:
                store, at = _store(stem)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                files = [store.open_output_stream(f"{at}.{kind}") for kind in ("ids", "off", "doc")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            sizes = []
            for ids in model.encode_many(b.column(1).to_pylist()):
                raw = ids.tobytes() + end
                files[0].write(raw)
                sizes.append(len(raw) // model.dtype.itemsize)
            ends = off + np.cumsum(sizes)
            files[1].write(ends.astype("<i8").tobytes())
            files[2].write(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            off, n_docs, n_null = int(ends[-1]), n_docs + b.num_rows, n_null + b.column(0).null_count
        if files:
            for f in files:
                f.close()
            shared.trim()
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "n_docs": n_docs, "n_tokens": off, "n_null": n_null, "width": model.dtype.itemsize, "stem": stem}], schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_null", pa.int64()), ("width", pa.int32()), ("stem", pa.string())]))

    shared.small_batches(docs.sparkSession)
    ordered = shared.id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return shared.written(ordered.mapInArrow(run, SHARDS), "shards")[0]


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document from the files: its id, the ids before it in the corpus, its count, and the crc32 of its ids as four-byte integers."""

    def run(batches):
        for b in batches:
            for s in b.to_pylist():
                ids, off, doc = _mapped(s["stem"] + ".ids", f"<u{s['width']}"), _mapped(s["stem"] + ".off", "<i8"), _mapped(s["stem"] + ".doc", "<i8")
                for i in range(0, s["n_docs"], 1024):
                    j = min(i + 1024, s["n_docs"])
                    ends = np.asarray(off[i : j + 1])
                    at = (4 * (ends - ends[0])).tolist()
                    raw = memoryview(np.asarray(ids[int(ends[0]) : int(ends[-1])]).astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                    null = np.arange(i, j) < s["n_null"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(doc[i:j]), mask=null), pa.array(s["base"] + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = shards.withColumn("base", before.cast("long"))
    return based.repartition(max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard").mapInArrow(run, ROWS)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(shared.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), shared.new_folder(spark, "tokens")))
