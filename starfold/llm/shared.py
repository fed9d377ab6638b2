"""What the operators of this subpackage share: the shared folder, tables that cut lineage, and column hygiene."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a new temporary folder; any other raises, as its executors have other disks.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="starfold-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/starfold-{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store through Spark's own file-system layer."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs whose frames are gone."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 2000, bytes_: str = "16m") -> None:
    """Bound what crosses to Python at once, by rows and by bytes, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null read as empty; all other columns, clashing names included, fall away here."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold_of(doc_id):
    """The remainder that holds rows out of training: crc32 of the id as text, modulo 3 (null ids: that of the empty text, 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def crc32_mod3(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


def pieces(texts: list, size: int = 1 << 20):
    """Ranges (a, b) of consecutive texts of about ``size`` characters in all, so that flat arrays over a range stay small."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size or i + 1 == len(texts):
            yield a, i + 1
            a, total = i + 1, 0


def trim() -> None:
    """Give memory that a batch has freed back to the system: workers live on, and two of them share an executor with its JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
