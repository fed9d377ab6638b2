"""Best periods and ranked peaks of a periodogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_period(psi: DataFrame, value: str = "psi", keys: list[str] = ["object_id"]) -> DataFrame:  # noqa: B006
    """``<keys>, period, <value>`` at the highest value; on ties the lowest k, that is the longest period."""
    top = F.max(F.struct(F.col(value), (-F.col("k")).alias("k"), F.col("period"))).alias("_b")
    return psi.groupBy(*keys).agg(top).select(*keys, F.col("_b.period").alias("period"), F.col(f"_b.{value}").alias(value))


def highest(psi: DataFrame) -> DataFrame:
    """The highest trial period of every object, in the columns of ``top_periods``."""
    w = Window.partitionBy("object_id").orderBy("k")
    x = psi.withColumn("_p", F.coalesce(F.lead("period").over(w), F.col("period")))
    top = F.max(F.struct("psi", (-F.col("k")).alias("k"), "period", "freq", "_p")).alias("_b")
    x = x.groupBy("object_id").agg(top).select("object_id", "_b.*")
    err = F.abs(F.col("period") - F.col("_p")) / 2
    return x.select("object_id", F.lit(1).alias("rank"), "period", err.alias("period_err"), F.col("psi").alias("power"), (-F.col("k")).alias("index"), "freq", F.lit(0.0).alias("thresh"))


def top_periods(psi: DataFrame, n: int = 10, keys: list[str] = ["object_id"], strict: bool = False) -> DataFrame:  # noqa: B006
    """``<keys>, rank, period, period_err, power, index, freq, thresh``: the n highest strict local maxima, ends left out.

    ``period_err`` is half the step to the next trial period; ties go to the lower k.  Objects with fewer maxima give fewer
    rows; with ``strict`` they are an error.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    thresh = F.col("thresh") if "thresh" in psi.columns else F.lit(0.0)
    x = psi.select(*keys, "k", "freq", "period", "psi", thresh.alias("thresh"), F.lag("psi").over(w).alias("_a"), F.lead("psi").over(w).alias("_b"), F.lead("period").over(w).alias("_p"))
    x = x.where((F.col("psi") > F.col("_a")) & (F.col("psi") > F.col("_b"))).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("psi"), "k"))).where(F.col("rank") <= n)
    if strict:
        have = F.count("*").over(Window.partitionBy(*keys))
        x = x.withColumn("rank", F.when(have == n, F.col("rank")).otherwise(F.raise_error(F.lit(f"fewer than {n} local maxima")).cast("int")))
    return x.select(*keys, "rank", "period", (F.abs(F.col("period") - F.col("_p")) / 2).alias("period_err"), F.col("psi").alias("power"), F.col("k").alias("index"), "freq", "thresh")


def period_correct(found: DataFrame, within: float = 0.01) -> DataFrame:
    """Adds ``correct``: whether ``period`` lies within ``within`` of ``period_true``."""
    return found.withColumn("correct", F.abs(F.col("period") - F.col("period_true")) < within)
