"""Sources and sinks of light curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_DAYS = 19723.0  # 2024-01-01 in days since 1970


def days(ts: str):
    """Timestamp column as days since 2024-01-01, double."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(8.64e10) - F.lit(EPOCH_DAYS)


def lc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as light curves: a star per user, a band per event type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("object_id"), F.col("event_id").alias("row_id"), days("ts").alias("t"), F.col("event_type").alias("band"), F.col("value").alias("mag"), (F.lit(0.01) * (1 + F.col("event_id") % 25)).alias("magerr")
    )


def lc_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` read as flux curves: a star per supplier, a band per return flag (day-granular times)."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("object_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("row_id"), days("l_shipdate").alias("t"), F.col("l_returnflag").alias("band"), F.col("l_extendedprice").alias("flux"), (F.col("l_extendedprice") * F.col("l_discount") / F.lit(10.0)).alias("flux_err")
    )


def read_text(spark: SparkSession, path: str, bands: list[str] = ["u", "g", "r", "i", "z"], object_id: int = 0) -> DataFrame:  # noqa: B006
    """White-space columns time, magnitude, error, band code (0-based into ``bands``); unreadable lines become a null row's absence.

    Lines with fewer than four columns or values that are no numbers are left out.
    """
    p = F.split(F.trim("value"), r"\s+")
    num = lambda i: F.expr(f"try_cast(get(p, {i}) as double)")
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("p", p).select(num(0).alias("t"), num(1).alias("mag"), num(2).alias("magerr"), num(3).alias("code"), F.monotonically_increasing_id().alias("row_id"))
    band = F.get(F.array(*map(F.lit, bands)), F.col("code").cast("int"))
    return rows.where("t is not null and mag is not null and magerr is not null").select(F.lit(object_id).cast("long").alias("object_id"), "row_id", "t", band.alias("band"), "mag", "magerr").where("band is not null")


def read_catalog(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet catalog, flat or directory-partitioned; only the named columns (nested fields too) are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def nest(objects: DataFrame, sources: DataFrame, key: str = "object_id", name: str = "sources") -> DataFrame:
    """Object rows with an array of their source structs, by time; objects without sources have an empty array.

    Sources meet per key only: one array per object is inherent to the nested form.
    """
    cols = [c for c in sources.columns if c != key]
    packed = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*sorted(cols, key=lambda c: (c != "t", c))))).alias(name))
    return objects.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))


def unnest(nested: DataFrame, name: str = "sources", keep: list[str] = ["object_id"], outer: bool = False) -> DataFrame:  # noqa: B006
    """One row per nested source; with ``outer`` objects without sources give a row of nulls."""
    fields = nested.schema[name].dataType.elementType.fieldNames()
    one = (F.explode_outer if outer else F.explode)(name).alias("_s")
    return nested.select(*keep, one).select(*keep, *(F.col(f"_s.{f}").alias(f) for f in fields))


def unnest_alerts(alerts: DataFrame, zero_point: float = 31.4) -> DataFrame:
    """Alert rows with ``diaObjectId`` and ``prvDiaSources`` as a magnitude light curve."""
    from starfold.functions.photometry import with_magnitude

    flat = unnest(alerts.withColumnRenamed("diaObjectId", "object_id"), "prvDiaSources")
    flat = flat.select("object_id", F.col("midpointMjdTai").alias("t"), "band", F.col("scienceFlux").alias("flux"), F.col("scienceFluxErr").alias("flux_err"))
    return with_magnitude(flat, zero_point).drop("flux", "flux_err")


def of_class(rows: DataFrame, path: str = "xm.vsx_Type", contains: str = "RRAB") -> DataFrame:
    """Rows whose (possibly nested, possibly null) class string holds ``contains``."""
    return rows.where(F.coalesce(F.contains(F.col(path), F.lit(contains)), F.lit(False)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_candidates(df: DataFrame, path: str) -> None:
    """Candidates as Parquet, range-partitioned by ``rss_frac`` so that files and rows are in order."""
    df.repartitionByRange("rss_frac").sortWithinPartitions("rss_frac").write.mode("overwrite").parquet(path)


def checkpointed(df: DataFrame, path: str, reuse: bool = True) -> DataFrame:
    """The Parquet at ``path``; written from ``df`` first unless it is there and ``reuse`` is set."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
    if not (reuse and there):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown(df: DataFrame, rows: int = 50) -> str:
    """A small (bounded) result as a Markdown table."""
    cols, got = df.columns, df.limit(rows).collect()
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in got])
