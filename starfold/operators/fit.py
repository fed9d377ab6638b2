"""Template fits over a grid of trial periods.

Relational kernels give one weighted linear step at a fixed period and phase, and the residual over a phase x period
grid.  The iterative fit runs as Arrow groups, vectorised over trial periods and starts at once.  The phase step descends
by default; ``phase_step="reference"`` turns its sign for parity with the published behaviour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.functions.photometry import phase_fit, polynomial
from starfold.functions.sizes import small
from starfold.schema import FIT, RSS_GRID

from . import native
from .grid import dealt
from .templates import Template, interpolated

CELLS = 1 << 18  # (trial period x start x observation) cells held at once
SMALL = 1e-20


# ---- relational kernels


def weighted(lc: DataFrame) -> DataFrame:
    """Adds ``w`` = 1/error^2; errors that are not positive count as the object's median positive error."""
    median = lc.where(F.col("magerr") > 0).groupBy("object_id").agg(F.percentile("magerr", F.lit(0.5)).alias("_med"))
    s = F.when(F.col("magerr") > 0, F.col("magerr")).otherwise(F.col("_med"))
    return lc.join(median, "object_id", "left").withColumn("w", 1 / (s * s)).drop("_med")


def on_template(lc: DataFrame, templates: DataFrame) -> DataFrame:
    """Observations with their band of each template (broadcast if the library is small); bands that it lacks fall away."""
    return lc.join(small(templates), "band")


def linear_step(points: DataFrame, keys: list[str], rss: bool = False) -> DataFrame:
    """``<keys>, n, mu, ebv, A, det`` (and ``rss`` on demand) from rows with ``w, y, d, g`` (y: magnitude less the band constant): weighted least squares of y on (1, d, g).

    Nine grouped sums and Cramer's rule; singular systems (|det| below 1e-20) give null coefficients.
    """
    w, y, d, g = (F.col(c) for c in "wydg")
    s = points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(e).alias(a) for a, e in {"s": w, "sd": w * d, "sg": w * g, "sdd": w * d * d, "sdg": w * d * g, "sgg": w * g * g, "sy": w * y, "sdy": w * d * y, "sgy": w * g * y, "syy": w * y * y}.items()))
    c = F.col
    a = [[c("s"), c("sd"), c("sg")], [c("sd"), c("sdd"), c("sdg")], [c("sg"), c("sdg"), c("sgg")]]
    b = [c("sy"), c("sdy"), c("sgy")]
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    put = lambda k: [[b[r] if k == j else a[r][j] for j in range(3)] for r in range(3)]
    s = s.withColumn("det", det(a))
    one = lambda k: F.when(F.abs("det") >= SMALL, F.try_divide(det(put(k)), c("det")))
    out = s.withColumns({"mu": one(0), "ebv": one(1), "A": one(2)})
    left = F.greatest(c("syy") - c("mu") * c("sy") - c("ebv") * c("sdy") - c("A") * c("sgy"), F.lit(0.0))
    known = F.when(c("mu").isNotNull(), left)
    return out.select(*keys, "n", "mu", "ebv", "A", "det", *([known.alias("rss")] if rss else []))


def points_at(lc: DataFrame, templates: DataFrame, trials: DataFrame) -> DataFrame:
    """Rows for ``linear_step``: observations with the template at each trial (``object_id, k, freq, period, phi``)."""
    x = on_template(lc, templates).join(trials, "object_id")
    x = x.withColumn("y", F.col("mag") - polynomial(F.col("c0"), F.col("p1"), F.col("p2"), F.col("period"))).withColumn("d", F.coalesce("dust", F.lit(0.0)))
    return x.withColumn("g", interpolated(F.col("gamma"), phase_fit(F.col("t"), F.col("freq"), F.col("phi")))).drop("gamma")


def phase_grid(lc: DataFrame, templates: DataFrame, trials: DataFrame, phases: int) -> DataFrame:
    """``object_id, template_id, k, period, phi, rss, mu, ebv, A``: the best of ``phases`` equal phase offsets at each trial, without iteration.

    One pass over observation x trial: the residual follows from the grouped sums, rss = sum w y^2 - solution . moments,
    taken about the object's mean magnitude so that little cancels.
    """
    keys = ["object_id", "template_id", "k", "period", "phi"]
    each = trials.withColumn("phi", F.explode(F.array(*(F.lit(i / phases) for i in range(phases)))))
    mean = lc.groupBy("object_id").agg(F.avg("mag").alias("_mean"))
    points = points_at(lc, templates, each.join(mean, "object_id")).withColumn("y", F.col("y") - F.col("_mean"))
    both = linear_step(points, [*keys, "_mean"], rss=True).withColumn("mu", F.col("mu") + F.col("_mean"))
    best = F.min(F.struct("rss", "phi", "mu", "ebv", "A")).alias("_b")
    return both.where("rss is not null").groupBy(*keys[:-1]).agg(best).select(*keys[:-1], *(F.col(f"_b.{c}").alias(c) for c in ("phi", "rss", "mu", "ebv", "A")))


def band_step(points: DataFrame, amplitude: float = 1.0) -> DataFrame:
    """One alternating step of the offset-per-band model at a fixed phase: ``object_id, band, mu_b, A``.

    Offsets are weighted means of magnitude less amplitude x template, then the amplitude is one weighted regression.
    Points hold ``w, mag, g``.
    """
    w, g = F.col("w"), F.col("g")
    mu = points.groupBy("object_id", "band").agg((F.sum(w * (F.col("mag") - amplitude * g)) / F.sum(w)).alias("mu_b"))
    x = points.join(mu, ["object_id", "band"])
    a = x.groupBy("object_id").agg(F.sum(w * (F.col("mag") - F.col("mu_b")) * g).alias("_n"), F.sum(w * g * g).alias("_d"))
    return mu.join(a.select("object_id", F.when(F.col("_d") > SMALL, F.try_divide("_n", "_d")).otherwise(F.lit(amplitude)).alias("A")), "object_id")


def predicted(obs: DataFrame, best: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds ``mag_pred`` to ``object_id, t, band`` rows from best fits ``object_id, period, phi, mu, ebv, A``."""
    x = on_template(obs, templates).join(best.select("object_id", "period", "phi", "mu", "ebv", "A"), "object_id")
    g = interpolated(F.col("gamma"), phase_fit(F.col("t"), 1 / F.col("period"), F.col("phi")))
    value = polynomial(F.col("c0"), F.col("p1"), F.col("p2"), F.col("period")) + F.col("mu") + F.col("ebv") * F.col("dust") + F.col("A") * g
    return x.select(*obs.columns, value.alias("mag_pred"))


def model_curve(best: DataFrame, templates: DataFrame, steps: int = 200) -> DataFrame:
    """``object_id, band, phase, mag_pred`` over two cycles: the dense model curve of each best fit, for display."""
    bands = sorted(r["band"] for r in templates.select("band").distinct().collect())
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    grid = best.select("object_id", "period", "phi").withColumn("band", each(bands)).withColumn("phase", each([i / steps for i in range(2 * steps)]))
    # the time at which the fold of the fit has this phase
    obs = grid.select("object_id", "band", "phase", ((F.col("phase") - F.col("phi")) * F.col("period")).alias("t"))
    return predicted(obs, best, templates).select("object_id", "band", "phase", "mag_pred")


def fit_top_periods(rss: DataFrame, n: int = 10, keys: list[str] = ["object_id"]) -> DataFrame:  # noqa: B006
    """The n grid points of least rss (not local minima), ranked; fewer where the grid is shorter."""
    from pyspark.sql import Window

    return rss.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rss", "k"))).where(F.col("rank") <= n)


def best_template(fits: DataFrame) -> DataFrame:
    """Per object the fit of least rss; on ties the first template by id.  Failed fits (null rss) do not count."""
    cols = [c for c in fits.columns if c not in ("object_id", "rss", "template_id")]
    least = fits.where(F.col("rss").isNotNull() & ~F.isnan("rss")).groupBy("object_id").agg(F.min_by(F.struct("template_id", "rss", *cols), F.struct("rss", "template_id")).alias("_b"))
    return least.select("object_id", "_b.*")


# ---- Arrow kernels


def interpolate(gamma: np.ndarray, band: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Template values of observations (last axis) at phases, on the circle."""
    n = gamma.shape[1]
    x = (phase % 1.0) * n
    lo = np.floor(x).astype(np.int64) % n
    frac = x - np.floor(x)
    return (1 - frac) * gamma[band, lo] + frac * gamma[band, (lo + 1) % n]


class Curves:
    """Template values and slopes of observations at many phases: both from one index into flat tables."""

    def __init__(self, tpl: Template, band: np.ndarray):
        self.n = tpl.gamma.shape[1]
        self.tables = [(ext.ravel(), np.diff(ext, axis=1, append=0.0).ravel()) for v in (tpl.gamma, tpl.slopes()) for ext in [np.concatenate([v, v[:, :1]], 1)]]
        self.offset = band * (self.n + 1)

    def at(self, phase: np.ndarray, slopes: bool = True) -> list[np.ndarray]:
        x = (phase - np.floor(phase)) * self.n
        low = x.astype(np.int64)
        x -= low
        low += self.offset
        return [value.take(low) + x * step.take(low) for value, step in self.tables[: 1 + slopes]]


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many symmetric 3 x 3 systems, and which of them are regular."""
    det = np.linalg.det(a)
    ok = np.abs(det) >= SMALL
    safe = np.where(ok[..., None, None], a, np.eye(3))
    return np.linalg.solve(safe, b[..., None])[..., 0], ok


def fit_dusty(t, mag, w, band, tpl: Template, freq, newton=5, phi0=None, sign=1.0):
    """(rss, phi, coefficients) for starts ``phi0`` (frequencies, starts): alternate the linear solve of (mu, E, A) and a phase step.

    The final residual takes the new phase with the coefficients before it; the best start is kept.
    """
    period = 1 / freq
    beta = tpl.betas[band, 0] + tpl.betas[band, 1] * period[:, None] + tpl.betas[band, 2] * period[:, None] ** 2
    y = (mag - beta)[:, None, :]
    d, curves = tpl.dust[band], Curves(tpl, band)
    phi = phi0.copy()
    coef = np.zeros((*phi.shape, 3))
    live = np.ones(phi.shape, bool)
    turn = (freq[:, None] * t)[:, None, :]
    ones = np.broadcast_to(w, turn.shape)
    for _ in range(newton):
        g, s = curves.at(turn + phi[..., None])
        wg, wd = ones * g, ones * d
        a = np.empty((*phi.shape, 3, 3))
        a[..., 0, 0], a[..., 0, 1], a[..., 0, 2] = w.sum(), (w * d).sum(), wg.sum(-1)
        a[..., 1, 1], a[..., 1, 2], a[..., 2, 2] = (w * d * d).sum(), (wg * d).sum(-1), (wg * g).sum(-1)
        a[..., 1, 0], a[..., 2, 0], a[..., 2, 1] = a[..., 0, 1], a[..., 0, 2], a[..., 1, 2]
        b = np.stack([(ones * y).sum(-1) + 0 * phi, (wd * y).sum(-1) + 0 * phi, (wg * y).sum(-1)], -1)
        new, ok = _solved(a, b)
        live &= ok
        coef = np.where(live[..., None], new, coef)
        res = y - coef[..., :1] - coef[..., 1:2] * d - coef[..., 2:] * g
        slope = coef[..., 2:] * s
        down = (w * slope * slope).sum(-1)
        move = live & (np.abs(down) > SMALL)
        phi = np.where(move, (phi + sign * (w * res * slope).sum(-1) / np.where(move, down, 1)) % 1.0, phi)
    g = curves.at(turn + phi[..., None], False)[0]
    rss = (w * (y - coef[..., :1] - coef[..., 1:2] * d - coef[..., 2:] * g) ** 2).sum(-1)
    s = rss.argmin(1)
    k = np.arange(len(freq))
    return rss[k, s], phi[k, s], coef[k, s]


def fit_offsets(t, mag, w, band, tpl: Template, freq, newton=5, phi0=None, sign=1.0):
    """(rss, phi, (offset per band, amplitude)): alternate offsets, amplitude and a phase step; bands without rows have NaN offsets."""
    n_b = len(tpl.bands)
    member = (band[:, None] == np.arange(n_b)).astype(float)
    wb = w @ member
    has = wb > 0
    curves = Curves(tpl, band)
    phi = phi0.copy()
    amp = np.ones(phi.shape)
    mu = np.zeros((*phi.shape, n_b))
    turn = (freq[:, None] * t)[:, None, :]
    for _ in range(newton):
        g, s = curves.at(turn + phi[..., None])
        mu = ((w * (mag - amp[..., None] * g)) @ member) / np.where(has, wb, 1)
        left = mag - mu[..., band]
        down = (w * g * g).sum(-1)
        amp = np.where(down > SMALL, (w * left * g).sum(-1) / np.where(down > SMALL, down, 1), amp)
        slope = amp[..., None] * s
        down = (w * slope * slope).sum(-1)
        move = np.abs(down) > SMALL
        phi = np.where(move, (phi + sign * (w * (left - amp[..., None] * g) * slope).sum(-1) / np.where(move, down, 1)) % 1.0, phi)
    g = curves.at(turn + phi[..., None], False)[0]
    rss = (w * (mag - mu[..., band] - amp[..., None] * g) ** 2).sum(-1)
    s = rss.argmin(1)
    k = np.arange(len(freq))
    return rss[k, s], phi[k, s], np.concatenate([np.where(has, mu[k, s], np.nan), amp[k, s][:, None]], 1)


def fitted(t, mag, magerr, bands, tpl: Template, freq, newton=5, starts=4, warm=False, use_errors=True, phase_step="descent"):
    """(rss, phi, coefficients) of one object at many frequencies.

    With ``warm`` (dusty mode; a sequential walk over the grid) every fit starts from the phase of the one before it.  No quality cut.
    """
    if missing := sorted(set(bands) - set(tpl.bands)):
        raise ValueError(f"bands {missing} not in template bands {list(tpl.bands)}")
    band = np.array([tpl.bands.index(b) for b in bands], np.int64)
    if use_errors:
        good = magerr > 0
        sigma = np.where(good, magerr, np.median(magerr[good]) if good.any() else 1.0)
        w = 1 / sigma**2
    else:
        w = np.ones(len(t))
    sign = 1.0 if phase_step == "descent" else -1.0
    kernel = fit_offsets if tpl.dust is None else fit_dusty
    if warm and tpl.dust is not None:
        parts, phi = [], np.zeros((1, 1))
        for f in freq:
            r, p, c = kernel(t, mag, w, band, tpl, np.array([f]), newton, phi, sign)
            parts.append((r, p, c))
            phi = p.reshape(1, 1)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    step = max(1, CELLS // (len(t) * starts))
    parts = [kernel(t, mag, w, band, tpl, freq[i : i + step], newton, np.broadcast_to(np.arange(starts) / starts, (len(freq[i : i + step]), starts)).copy(), sign) for i in range(0, len(freq), step)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def frequencies(t: np.ndarray, pmin: float, dphi: float, pmax: float | None = None) -> np.ndarray:
    """The fit grid of one object."""
    span = t.max() - t.min()
    if span <= 0:
        return np.zeros(0)
    f = 2 / span + np.arange(max(1, int((1 / pmin - 2 / span) / (dphi / span)))) * (dphi / span)
    return f if pmax is None else f[1 / f <= pmax]


def fit(lc: DataFrame, templates: list[Template], pmin: float = 0.2, dphi: float = 0.02, pmax: float | None = None, blocks: int = 1, least: int = 5, windows: DataFrame | None = None, **how) -> DataFrame:
    """The best fit of every object by every template, as FIT rows (offsets by band in ``mu_band``, or ``mu, ebv``).

    The library is dealt into ``blocks`` so that one object's work spreads over tasks: groups are (object, block).  Bands that
    a template lacks are left out for it; templates with fewer than ``least`` rows left, without a spread of times, or whose
    fit fails numerically give no row.  ``windows`` (``object_id, template_id, low, high``) restricts an object to one
    template and a range of periods.  ``how`` goes to ``fitted``.
    """
    spark = lc.sparkSession
    cols = ["object_id", "row_id", "t", "band", "mag", "magerr"]
    rows = lc.select(*cols).where("t is not null and mag is not null and not isnan(mag) and magerr is not null and not isnan(magerr)")
    # exploded even if there is one: a constant would fall out of the groups but not of the deal, and Spark would deal again, into as few tasks as bytes fill
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1 if windows is None else 0))))
    if windows is None:
        rows = rows.withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(pmax).cast("double")).withColumn("only", F.lit(None).cast("string"))
    else:
        rows = rows.join(windows.select("object_id", "low", "high", F.col("template_id").alias("only")), "object_id")
    settings = {"newton": 5, "starts": 4, "warm": False, "use_errors": True, "phase_step": "descent"} | how
    told = [dphi, least, *(float(settings[c]) for c in ("newton", "starts", "warm", "use_errors")), 1.0 if settings["phase_step"] == "descent" else -1.0]
    packed = F.array_sort(F.collect_list(F.struct("t", "row_id", "band", "mag", "magerr"))).alias("_o")
    x = dealt(rows, "object_id", "block").groupBy("object_id", "block").agg(packed, *(F.first(c).alias(c) for c in ("low", "high", "only")))
    library = F.broadcast(native.frame(spark, templates, blocks if windows is None else 1))
    x = x.join(library, "block") if windows is None else x.join(library.drop("block"), F.col("only") == F.col("template_id"))
    range_ = F.array(F.coalesce(F.nanvl("low", F.lit(None).cast("double")), F.lit(float(pmin))), F.coalesce("high", F.lit(float("nan"))))
    found = F.call_function(native.function(spark), "_o.t", "_o.mag", "_o.magerr", "_o.band", "_bands", "_table", range_, F.array(*(F.lit(float(v)) for v in told)))
    x = x.select("object_id", "template_id", "_bands", F.explode(found).alias("_r"))
    r = lambda i: F.get("_r", F.lit(i))
    dusty = F.size("_r") == 8
    offsets = F.map_from_entries(F.filter(F.transform("_bands", lambda b, i: F.struct(b.alias("key"), F.get("_r", i + 8).alias("value"))), lambda e: ~F.isnan(e["value"])))
    names = ("period", "phi", "rss", "rss_median", "n_obs", "A")
    values = [r(i).cast("long" if c == "n_obs" else "double").alias(c) for i, c in enumerate(names)]
    return x.select("object_id", "template_id", *values, F.when(dusty, r(6)).alias("mu"), F.when(dusty, r(7)).alias("ebv"), F.when(~dusty, offsets).alias("mu_band"))


def rss_grid(lc: DataFrame, template: Template, pmin: float, dphi: float, pmax: float | None = None, **how) -> DataFrame:
    """The whole grid of residuals, ``object_id, template_id, k, period, rss, phi``."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "row_id"])
        t, mag, err = (pdf[c].to_numpy(float) for c in ("t", "mag", "magerr"))
        freq = frequencies(t, pmin, dphi, pmax)
        if not len(freq):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in RSS_GRID.split(", ")})
        rss, phi, _ = fitted(t, mag, err, pdf["band"].tolist(), template, freq, **how)
        return pd.DataFrame({"object_id": key[0], "template_id": template.name, "k": np.arange(len(freq)), "period": 1 / freq, "rss": rss, "phi": phi})

    return dealt(lc.where(F.col("band").isin(list(template.bands))), "object_id").groupBy("object_id").applyInPandas(one, RSS_GRID)


def depth(fits: DataFrame, null: DataFrame) -> DataFrame:
    """Adds ``rss_frac`` (least rss over the constant model's), ``rss_depth`` (1 - least over median) and ``rss_dof``."""
    x = fits.join(null.select("object_id", "rss_null"), "object_id")
    return x.withColumn("rss_frac", F.col("rss") / F.greatest("rss_null", F.lit(1e-30))).withColumn("rss_depth", 1 - F.col("rss") / F.greatest("rss_median", F.lit(1e-30))).withColumn("rss_dof", F.col("rss") / F.greatest(F.col("n_obs") - 4, F.lit(1)))
