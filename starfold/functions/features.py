"""Aggregates over light curves: variability, null model, colours, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .photometry import finite

LCHI, SIGNIFICANCE = 0.5, 0.0
R_I, G_R, G_R_MEAN = 0.068, 0.268, 0.488


def variability(lc: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """``object_id, lchi_med, sig_max``: median over bands of log10 reduced chi-square, maximum of log10 amplitude significance.

    Bands with fewer than two usable rows do not count; objects without usable bands have 0 and 0 (all of ``objects``, or of
    the light curve).  Two-level aggregation, so large objects combine before the shuffle.
    """
    good = lc.where(finite(F.col("mag")) & finite(F.col("magerr")) & (F.col("magerr") > 0))
    # errors at the extremes: the first row by time (then row id) among equal magnitudes
    least, most = F.min(F.struct("mag", "t", "row_id", "magerr")), F.max(F.struct("mag", (-F.col("t")).alias("_t"), (-F.col("row_id")).alias("_r"), "magerr"))
    band = good.groupBy("object_id", "band").agg(F.count("*").alias("n"), F.var_samp("mag").alias("v"), F.avg(F.col("magerr") * F.col("magerr")).alias("e2"), least.alias("lo"), most.alias("hi")).where("n >= 2")
    sig = (F.col("hi.mag") - F.col("lo.mag")) / F.sqrt(F.col("hi.magerr") * F.col("hi.magerr") + F.col("lo.magerr") * F.col("lo.magerr"))
    logs = band.select("object_id", F.log10(F.greatest(F.col("v") / F.col("e2"), F.lit(1e-10))).alias("lchi"), F.log10(F.greatest(sig, F.lit(1e-10))).alias("sig"))
    both = logs.groupBy("object_id").agg(F.percentile("lchi", F.lit(0.5)).alias("lchi_med"), F.max("sig").alias("sig_max"))
    every = (objects if objects is not None else lc).select("object_id").distinct()
    return every.join(both, "object_id", "left").select("object_id", F.coalesce("lchi_med", F.lit(0.0)).alias("lchi_med"), F.coalesce("sig_max", F.lit(0.0)).alias("sig_max"))


def variable(features: DataFrame) -> DataFrame:
    return features.where((F.col("lchi_med") >= LCHI) & (F.col("sig_max") >= SIGNIFICANCE))


def point_sources(objects: DataFrame, low: float = 21.0, high: float = 24.5) -> DataFrame:
    """Objects that are not extended and whose r magnitude lies strictly between the limits; pushed to the scan."""
    return objects.where((F.col("extendedness") == 0) & (F.col("r_psfMag") > low) & (F.col("r_psfMag") < high))


def null_model(lc: DataFrame) -> DataFrame:
    """``object_id, n_obs, m_mean, rss_null``: weighted mean and weighted sum of squares about it, in two passes.

    Rows without a finite magnitude or error do not count, nor do objects without any other row.
    """
    w = lc.where(finite(F.col("mag")) & finite(F.col("magerr"))).withColumn("w", 1 / F.greatest(F.col("magerr") * F.col("magerr"), F.lit(1e-30)))
    mean = w.groupBy("object_id").agg(F.count("*").alias("n_obs"), (F.sum(F.col("w") * F.col("mag")) / F.sum("w")).alias("m_mean"))
    d = F.col("mag") - F.col("m_mean")
    return w.join(mean, "object_id").groupBy("object_id", "n_obs", "m_mean").agg(F.sum(F.col("w") * d * d).alias("rss_null"))


def quality_flags(fits: DataFrame, low: float = 0.3, high: float = 1.5, depth: float = 0.5) -> DataFrame:
    """``flag_amp`` (amplitude outside the range of the class) and ``flag_depth`` (shallow minimum)."""
    return fits.withColumn("flag_amp", ~F.abs("A").between(low, high)).withColumn("flag_depth", F.col("rss_depth") < depth)


def clean(fits: DataFrame) -> DataFrame:
    return fits.where(~F.col("flag_amp") & ~F.col("flag_depth"))


def best_clean(fits: DataFrame, n: int = 15) -> DataFrame:
    """The report's head: the ``n`` clean fits of least ``rss_frac`` (ties: the least object_id)."""
    return clean(fits).orderBy("rss_frac", "object_id").limit(n)


def best_observed(lc: DataFrame, n: int = 1) -> DataFrame:
    """``object_id, n_good``: the ``n`` objects with most usable rows (ties: the least object_id)."""
    good = lc.where(finite(F.col("mag")) & finite(F.col("magerr")))
    return good.groupBy("object_id").agg(F.count("*").alias("n_good")).orderBy(F.desc("n_good"), "object_id").limit(n)


def classification_features(fits: DataFrame, null_period: float = 0.5) -> DataFrame:
    """Adds ``rss_dof`` (rss over n_obs - 4) and ``amp_rss`` (amplitude over it): what the classifier of fitted stars reads."""
    dof = F.col("rss") / F.greatest(F.col("n_obs") - 4, F.lit(1))
    return fits.withColumn("rss_dof", dof).withColumn("amp_rss", F.try_divide("A", "rss_dof"))


def phase_concentration(lc: DataFrame, period: float | str) -> DataFrame:
    """``object_id, r_bar, kappa``: how strongly observations gather at one phase of the period (a number or a column).

    ``r_bar`` is the mean resultant length of the folded times; ``kappa`` the concentration of the von Mises distribution by
    the usual rational approximation, r (2 - r^2) / (1 - r^2).  A high value warns of an alias of the sampling.
    """
    p = F.col(period) if isinstance(period, str) else F.lit(period)
    angle = 2 * F.pi() * F.col("t") / p
    sums = lc.groupBy("object_id").agg(F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"))
    r = sums.select("object_id", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("r_bar"))
    return r.withColumn("kappa", F.try_divide(F.col("r_bar") * (2 - F.col("r_bar") * F.col("r_bar")), 1 - F.col("r_bar") * F.col("r_bar")))


def colour_diagnostics(lc: DataFrame, templates: DataFrame, period: float) -> DataFrame:
    """``band, obs_mean, beta, mu_implied`` (without reddening) for each band of a template at a period."""
    from .photometry import polynomial
    from .sizes import small

    mean = lc.groupBy("band").agg(F.avg("mag").alias("obs_mean"))
    x = mean.join(small(templates), "band").withColumn("beta", polynomial(F.col("c0"), F.col("p1"), F.col("p2"), F.lit(period)))
    return x.select("band", "obs_mean", "beta", (F.col("obs_mean") - F.col("beta")).alias("mu_implied"))


def colour_excess(diagnostics: DataFrame, blue: str = "g", red: str = "i") -> DataFrame:
    """``observed, template, excess``: the colour blue - red of the rows of ``colour_diagnostics``; null where a band is missing."""
    of = lambda c, b: F.max(F.when(F.col("band") == b, F.col(c)))
    x = diagnostics.agg((of("obs_mean", blue) - of("obs_mean", red)).alias("observed"), (of("beta", blue) - of("beta", red)).alias("template"))
    return x.withColumn("excess", F.col("observed") - F.col("template"))


def rejects(fits: DataFrame, ebv: float = 1.0, low: float = 0.3, high: float = 2.0, kappa: float = 5.0) -> DataFrame:
    """Fits that the documented limits on reddening, amplitude and kappa leave out (``kappa`` only where the column is there)."""
    out = (F.col("ebv") > ebv) | (F.col("A") < low) | (F.col("A") > high)
    return fits.where(out | (F.col("kappa") > kappa) if "kappa" in fits.columns else out)


def period_class(period, kind) -> F.Column:
    """RRab in (0.4, 0.9), RRc in (0.25, 0.45); in the overlap the library's class decides."""
    ab, c = (period > 0.4) & (period < 0.9), (period > 0.25) & (period < 0.45)
    return F.when(ab & c, kind).when(ab, F.lit("RRab")).when(c, F.lit("RRc"))


def band_summary(lc: DataFrame, keys: list[str] = ["band"]) -> DataFrame:  # noqa: B006
    """Count, mean, sample deviation and median error by band."""
    return lc.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("mag").alias("mean_mag"), F.stddev_samp("mag").alias("std_mag"), F.percentile("magerr", F.lit(0.5)).alias("med_err"))


def summary(df: DataFrame, column: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Median, mean, population deviation, extremes, count and NaN count; any NaN makes the five statistics NaN."""
    x, nan = F.col(column), F.isnan(column)
    poison = lambda c: F.when(F.max(nan.cast("int")) == 1, F.lit(float("nan"))).otherwise(c)
    return df.groupBy(*keys).agg(poison(F.percentile(x, F.lit(0.5))).alias("median"), poison(F.avg(x)).alias("mean"), poison(F.stddev_pop(x)).alias("std"), poison(F.min(x)).alias("min"), poison(F.max(x)).alias("max"), F.count(x).alias("n"), F.count_if(nan).alias("n_nan"))


def colour_pairs(lc: DataFrame, bands: tuple[str, str, str] = ("g", "r", "i"), hours: float = 1.0) -> DataFrame:
    """``object_id, n_ri, ri_min, n_gr, gr_min`` over pairs of observations less than ``hours`` apart (strictly).

    An interval self join on (object, time bin): rows of the other two bands are repeated into the neighbouring bins, so each
    pair meets once and no object is joined whole with itself.
    """
    g, r, i = bands
    dt = hours / 24.0
    lc = lc.where(F.col("band").isin(g, r, i) & F.col("mag").isNotNull()).select("object_id", "t", "band", F.col("mag").alias("m")).withColumn("bin", F.floor(F.col("t") / dt))
    red = lc.where(F.col("band") == r).select("object_id", "bin", F.col("t").alias("tr"), F.col("m").alias("mr"))
    other = lc.where(F.col("band") != r).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    pairs = red.join(other, ["object_id", "bin"]).where(F.abs(F.col("tr") - F.col("t")) < dt)
    ri, gr = F.when(F.col("band") == i, F.col("mr") - F.col("m")), F.when(F.col("band") == g, F.col("m") - F.col("mr"))
    return pairs.groupBy("object_id").agg(F.count(ri).alias("n_ri"), F.min(ri).alias("ri_min"), F.count(gr).alias("n_gr"), F.min(gr).alias("gr_min"))


def colour_cut(lc: DataFrame, bands: tuple[str, str, str] = ("g", "r", "i"), hours: float = 1.0) -> DataFrame:
    """``object_id, passes``: blue enough in some pair; without any pair by the mean colour; without any colour it passes."""
    g, r, _ = bands
    mean = lc.groupBy("object_id").agg((F.avg(F.when(F.col("band") == g, F.col("mag"))) - F.avg(F.when(F.col("band") == r, F.col("mag")))).alias("gr"))
    both = mean.join(colour_pairs(lc, bands, hours), "object_id", "left")
    pair = F.col("ri_min").isNotNull() | F.col("gr_min").isNotNull()
    blue = F.coalesce(F.col("ri_min") < R_I, F.lit(False)) | F.coalesce(F.col("gr_min") < G_R, F.lit(False))
    return both.select("object_id", F.when(pair, blue).otherwise(F.coalesce(F.col("gr") < G_R_MEAN, F.lit(True))).alias("passes"))


def status_counts(objects: DataFrame, least: int = 10) -> DataFrame:
    """Objects by what becomes of them before the fit: ``few_obs, not_variable, to_fit`` from ``n_good, lchi_med, sig_max``."""
    few = F.col("n_good") < least
    var = (F.col("lchi_med") >= LCHI) & (F.col("sig_max") >= SIGNIFICANCE)
    return objects.agg(F.count_if(few).alias("few_obs"), F.count_if(~few & ~var).alias("not_variable"), F.count_if(~few & var).alias("to_fit"))


def error_rescale(stars: DataFrame, least: int = 10) -> DataFrame:
    """``healpix, band, n, a0, a1, a2``: least-squares quadratic of log10 reduced chi-square over mean magnitude, per cell and band.

    ``stars`` has one row per constant star and band: ``healpix, band, mean_mag, chi2``.  Sums of powers about the cell's mean
    magnitude, solved by Cramer's rule; cells with fewer than ``least`` stars or no spread are left out.
    """
    y = F.log10(F.greatest("chi2", F.lit(1e-10)))
    good = stars.where("mean_mag is not null and chi2 is not null").withColumn("y", y)
    mid = good.groupBy("healpix", "band").agg(F.avg("mean_mag").alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    x = F.col("mean_mag") - F.col("m")
    s = good.join(mid, ["healpix", "band"]).groupBy("healpix", "band", "m", "n").agg(*(F.sum(F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)), *(F.sum(F.pow(x, F.lit(float(k))) * F.col("y")).alias(f"y{k}") for k in range(3)))
    c = F.col
    n, s1, s2, s3, s4, y0, y1, y2 = c("n"), c("s1"), c("s2"), c("s3"), c("s4"), c("y0"), c("y1"), c("y2")
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    d = det([[n, s1, s2], [s1, s2, s3], [s2, s3, s4]])
    b = [det(m) for m in ([[y0, s1, s2], [y1, s2, s3], [y2, s3, s4]], [[n, y0, s2], [s1, y1, s3], [s2, y2, s4]], [[n, s1, y0], [s1, s2, y1], [s2, s3, y2]])]
    s = s.withColumn("d", d).where(F.abs("d") > 1e-20).select("healpix", "band", "n", "m", *((v / c("d")).alias(f"b{k}") for k, v in enumerate(b)))
    m = c("m")
    return s.select("healpix", "band", "n", (c("b0") - c("b1") * m + c("b2") * m * m).alias("a0"), (c("b1") - 2 * c("b2") * m).alias("a1"), c("b2").alias("a2"))
