"""Trial periods per object: f_k = 2/T + k dphi/T over the whole time span T of the object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key into ``spark.sql.shuffle.partitions`` partitions that adaptive execution leaves apart.

    Groups of heavy kernels weigh by their work, not their bytes; coalesced by size, they would end in a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spans(lc: DataFrame) -> DataFrame:
    """``object_id, t_min, t_max, span``: all bands, before any cut."""
    return lc.groupBy("object_id").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max")).withColumn("span", F.col("t_max") - F.col("t_min"))


def _sized(span: DataFrame, pmin: float, dphi: float, least: int) -> DataFrame:
    n = F.floor((F.lit(1.0 / pmin) - 2 / F.col("span")) / (F.lit(dphi) / F.col("span"))).cast("long")
    return span.where("span > 0").withColumn("n_freq", F.greatest(n, F.lit(least).cast("long")))


def _frequency(k):
    return lambda dphi: 2 / F.col("span") + k * (F.lit(dphi) / F.col("span"))


def search_grid(span: DataFrame, pmin: float, dphi: float, pmax: float | None = None) -> DataFrame:
    """``object_id, t_min, span, k, freq, period`` for the period search; with ``pmax`` only pmin <= period <= pmax.

    Only the range of k that can lie within the limits is generated.  Objects without any trial period give no rows.
    """
    if pmax is not None and pmax <= pmin:
        raise ValueError("pmax must exceed pmin")
    sized = _sized(span, pmin, dphi, 0).where("n_freq > 0")
    low = F.lit(0).cast("long") if pmax is None else F.greatest(F.lit(0).cast("long"), F.floor((F.lit(1.0 / pmax) - 2 / F.col("span")) / (F.lit(dphi) / F.col("span"))).cast("long") - 1)
    sized = sized.withColumn("_low", low).where("_low < n_freq")
    grid = sized.select("object_id", "t_min", "span", F.explode(F.sequence(F.col("_low"), F.col("n_freq") - 1)).alias("k"))
    grid = grid.withColumn("freq", _frequency(F.col("k"))(dphi)).withColumn("period", 1 / F.col("freq"))
    return grid if pmax is None else grid.where(F.col("period").between(pmin, pmax))


def fit_grid(span: DataFrame, pmin: float, dphi: float, pmax: float | None = None) -> DataFrame:
    """The grid of the template fit: one trial period at least, and no lower limit on the period."""
    sized = _sized(span, pmin, dphi, 1)
    grid = sized.select("object_id", "t_min", "span", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_freq") - 1)).alias("k"))
    grid = grid.withColumn("freq", _frequency(F.col("k"))(dphi)).withColumn("period", 1 / F.col("freq"))
    return grid if pmax is None else grid.where(F.col("period") <= pmax)


def explicit_grid(span: DataFrame, periods: list[float]) -> DataFrame:
    """Given periods for every object, in the order given."""
    grid = span.select("object_id", "t_min", "span", F.posexplode(F.array(*map(F.lit, periods))).alias("k", "period"))
    return grid.select("object_id", "t_min", "span", F.col("k").cast("long").alias("k"), (1 / F.col("period")).alias("freq"), "period")
