"""BPE encoding and decoding of whole texts as a DataFrame operator (method: contiguous rank array, see ``bpe``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, shared


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, text, ids array<int>`` of every whole text.

    Null texts are read as empty and have no ids; repeated rows and null ids stay as they are; other columns fall away.
    A narrow map: nothing is shuffled, and a lost task is simply run again.
    """

    def run(batches):
        model = bpe.load(path)
        for b in batches:
            ids = model.encode_many(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "text", "ids"])

    shared.small_batches(docs.sparkSession)
    return shared.id_text(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to rows with ``ids`` (null ids: empty text)."""

    @F.pandas_udf("string")
    def text_of(ids):
        model = bpe.load(path)
        return ids.map(lambda x: "" if x is None else model.decode(x.tolist()))

    return encoded.withColumn("decoded", text_of("ids"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` in one pass: each text is encoded, its ids written as decimals and decoded again.

    Null and empty texts give no ids and the hash of nothing; every input row gives one row.
    """

    def run(batches):
        from hashlib import sha256

        model = bpe.load(path)
        decimal = model.decimal.__getitem__
        for b in batches:
            n, said, back = [], [], []
            for ids in model.encode_many(b.column(1).to_pylist()):
                ids = ids.tolist()
                n.append(len(ids))
                said.append(sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                back.append(sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        shared.trim()

    shared.small_batches(docs.sparkSession)
    return shared.id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(shared.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
