"""Streaming extension: running variability of objects over an observation stream.

Sums per (object, band) are kept by the state store; every micro-batch updates the reduced chi-square of what it touched.
Late rows count like others, as the sums have no order; a watermark bounds the state by dropping idle objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_variability(stream: DataFrame, every: str = "10 days", late: str = "2 days") -> DataFrame:
    """``object_id, band, window, n, chi2``: variability of each object and band in tumbling windows of event time ``ts``.

    Rows older than the watermark are dropped; null or NaN magnitudes and errors that are not positive do not count.
    """
    good = stream.where("mag is not null and not isnan(mag) and magerr > 0 and not isnan(magerr)").withWatermark("ts", late)
    x = good.groupBy("object_id", "band", F.window("ts", every)).agg(F.count("*").alias("n"), F.var_samp("mag").alias("_v"), F.avg(F.col("magerr") * F.col("magerr")).alias("_e"))
    return x.where("n >= 2").select("object_id", "band", F.col("window.start").alias("start"), "n", (F.col("_v") / F.col("_e")).alias("chi2"))
