"""Scalar photometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import small

MAX_ERROR = 0.2

# Offsets of the constant term when templates move between filter systems, by band.
SYNTHETIC = {"g": 0.011, "r": 0.028, "i": 0.006, "z": 0.024, "Y": 0.0, "y": 0.0}
EMPIRICAL = {"g": 0.118, "r": -0.162, "i": 0.195, "z": 0.024, "Y": 0.0, "y": 0.0}
# Colour polynomials of the same move: band -> (colour, linear, quadratic, constant).
COLOUR_TERMS = {"g": ("g-i", 0.016, -0.003, 0.006), "r": ("r-i", 0.185, -0.015, 0.010), "i": ("r-i", 0.150, -0.003, -0.009), "z": ("i-z", 0.270, 0.036, -0.003)}
MEAN_COLOURS = {"g-i": 0.3, "r-i": 0.1, "i-z": 0.1}


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def magnitude(flux: Column, zero_point: float = 31.4) -> Column:
    """-2.5 log10(flux) + zero point; null where flux is not positive or NaN."""
    return F.when(finite(flux) & (flux > 0), F.lit(-2.5) * F.log10(flux) + F.lit(zero_point))


def magnitude_error(flux: Column, error: Column) -> Column:
    """Propagated error; 9.99, which every cut drops, where flux is not positive or NaN."""
    return F.when(finite(flux) & (flux > 0), F.lit(2.5 / math.log(10)) * F.abs(error) / flux).otherwise(F.lit(9.99))


def with_magnitude(df: DataFrame, zero_point: float = 31.4) -> DataFrame:
    f, e = F.col("flux"), F.col("flux_err")
    return df.withColumn("mag", magnitude(f, zero_point)).withColumn("magerr", magnitude_error(f, e))


def search_cut(lc: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """Observations for the period search: 0 <= error <= 0.2, zero included."""
    ok = ~F.isnan("magerr") & F.col("magerr").between(0.0, MAX_ERROR)
    return lc.where(ok & F.col("band").isin(bands) if bands else ok)


def catalog_cut(lc: DataFrame, bands: list[str]) -> DataFrame:
    """Observations for catalog fits: 0 < error <= 0.2 and a known band."""
    return lc.where(~F.isnan("magerr") & (F.col("magerr") > 0) & (F.col("magerr") <= MAX_ERROR) & F.col("band").isin(bands))


def with_enough(lc: DataFrame, least: int = 10) -> DataFrame:
    """Rows of objects with at least ``least`` rows: one small aggregate and a semi join, so a large object splits over tasks."""
    return lc.join(lc.groupBy("object_id").count().where(F.col("count") >= least).select("object_id"), "object_id", "left_semi")


def correction(method: str = "synthetic", colours: dict[str, float] | None = None) -> dict[str, float]:
    """Offset by band; ``empirical`` goes before colours.  Unknown methods are an error."""
    if method == "empirical":
        return dict(EMPIRICAL)
    if method != "synthetic":
        raise ValueError(f"unknown correction method {method!r}")
    if colours is None:
        return dict(SYNTHETIC)
    c = MEAN_COLOURS | colours
    return {b: a1 * c[k] + a2 * c[k] ** 2 + a0 for b, (k, a1, a2, a0) in COLOUR_TERMS.items()} | {"Y": 0.0, "y": 0.0}


def corrected(templates: DataFrame, method: str = "synthetic", colours: dict[str, float] | None = None) -> DataFrame:
    """Templates with the band's offset added to ``c0``; rows without dust (the per-band-offset mode) stay.  Apply once."""
    offset = F.coalesce(*(F.when(F.col("band") == b, F.lit(v)) for b, v in correction(method, colours).items()), F.lit(0.0))
    return templates.withColumn("c0", F.when(F.col("dust").isNotNull(), F.col("c0") + offset).otherwise(F.col("c0")))


def polynomial(c0, p1, p2, period) -> Column:
    """Band constant as a quadratic of the period."""
    return c0 + p1 * period + p2 * period * period


def distance_kpc(mu: Column) -> Column:
    return F.pow(F.lit(10.0), (mu - 10) / 5)


def dereddened(lc: DataFrame, ebv: DataFrame, dust: DataFrame) -> DataFrame:
    """``mag_0`` = mag - E(B-V) of the object times the band's dust coefficient (no coefficient or no map value: unchanged)."""
    return lc.join(ebv, "object_id", "left").join(small(dust), "band", "left").withColumn("mag_0", F.col("mag") - F.coalesce(F.col("ebv") * F.col("dust"), F.lit(0.0))).drop("ebv", "dust")


def phase_fit(t, freq, phi) -> Column:
    """Fold of the template fit: (t f + phi) mod 1, in absolute time."""
    return F.pmod(t * freq + phi, F.lit(1.0))


def phase_plot(t, period, t_min) -> Column:
    """Fold for display: time since the whole day of the first observation."""
    return F.pmod((t - F.floor(t_min)) / period, F.lit(1.0))


def phase_theta(t, period, t_min) -> Column:
    """Fold of the dispersion statistic: fraction of the cycles since the first observation."""
    x = (t - t_min) / period
    return x - F.floor(x)
