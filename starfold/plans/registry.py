"""The registered queries of the light-curve engine with their DuckDB counterparts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold import schema
from starfold.functions import features, photometry
from starfold.operators import fit, grid, library, peaks, periodogram, templates
from starfold.plans import pipelines
from starfold.sources import lightcurves as sources
from starfold.sources.lightcurves import lc_events, lc_lineitem, nest, of_class, unnest

PMIN, DPHI = 0.5, 0.25  # of verified periodograms
PRODUCTION = (0.2, 0.02)  # least period and phase step of the queries without SQL
BANDS3 = ("click", "purchase", "view")
DUSTY = templates.synthetic("dusty", BANDS3, 8, 0.15)
PLAIN = templates.synthetic("plain", BANDS3, 8, 0.1, dusty=False)
LIBRARY = [
    templates.synthetic(f"t{i}", BANDS3 if i % 3 else BANDS3[:2], 8 if i % 4 else 12, round(0.05 * i - 0.1, 3), dusty=False) for i in range(8)
]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its DuckDB SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, to) + F.lit(0.0))
    return df


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _rows(template_list) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"[{', '.join(f'{x!r}::DOUBLE' for x in v)}]" if isinstance(v, list) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for t in template_list for r in t.rows())


LC = """lc AS (SELECT user_id AS object_id, event_id AS row_id, epoch_us(ts) / 8.64e10 - 19723.0 AS t, event_type AS band,
  value AS mag, 0.01::DOUBLE * (1 + event_id % 25) AS magerr FROM events)"""
FLUX = """fl AS (SELECT l_suppkey AS object_id, (l_orderkey * 8 + l_linenumber)::BIGINT AS row_id, epoch_us(l_shipdate) / 8.64e10 - 19723.0 AS t,
  l_returnflag AS band, l_extendedprice::DOUBLE AS flux, l_extendedprice::DOUBLE * l_discount::DOUBLE / 10.0::DOUBLE AS flux_err FROM lineitem)"""
MAG = """mg AS (SELECT object_id, row_id, t, band, CASE WHEN flux > 0 THEN -2.5::DOUBLE * log10(flux) + 31.4::DOUBLE END AS mag,
  CASE WHEN flux > 0 THEN (2.5::DOUBLE / ln(10::DOUBLE)) * abs(flux_err) / flux ELSE 9.99 END AS magerr FROM fl)"""
GOOD = "good AS (SELECT * FROM lc WHERE magerr BETWEEN 0 AND 0.2::DOUBLE)"
SPAN = "span AS (SELECT object_id, min(t) AS t_min, max(t) AS t_max, max(t) - min(t) AS span FROM lc GROUP BY 1)"


def _grid(pmin=PMIN, dphi=DPHI, least=0, name="grid") -> str:
    n = f"greatest(floor(({1 / pmin!r}::DOUBLE - 2 / span) / ({dphi!r}::DOUBLE / span))::BIGINT, {least})"
    return f"""{name} AS (SELECT object_id, t_min, span, k, 2 / span + k * ({dphi!r}::DOUBLE / span) AS freq, 1 / (2 / span + k * ({dphi!r}::DOUBLE / span)) AS period
  FROM (SELECT object_id, t_min, span, unnest(range(0, {n})) AS k FROM span WHERE span > 0))"""


STATS = "stats AS (SELECT object_id, band, min(t) AS t0, avg(mag) AS m0, var_pop(mag) AS v0, count(*) AS n0 FROM good GROUP BY 1, 2 HAVING var_pop(mag) > 0)"
POWER = f"""sums AS (SELECT g.object_id, g.band, k, freq, period, first(v0) AS v0, first(n0) AS n0,
    sum(sin(2 * (2 * pi() * freq * (t - t0)))) AS s2, sum(cos(2 * (2 * pi() * freq * (t - t0)))) AS c2,
    sum((mag - m0) * sin(2 * pi() * freq * (t - t0))) AS sh, sum((mag - m0) * cos(2 * pi() * freq * (t - t0))) AS ch
  FROM good g JOIN stats s USING (object_id, band) JOIN grid USING (object_id) GROUP BY 1, 2, 3, 4, 5),
tau AS (SELECT *, atan(s2 / c2) / 2 AS tau FROM sums),
power AS (SELECT object_id, band, k, freq, period,
  0.5 * ((ch * cos(tau) + sh * sin(tau)) ** 2 / (0.5 * (n0 + (c2 * cos(2 * tau) + s2 * sin(2 * tau)))) + (sh * cos(tau) - ch * sin(tau)) ** 2 / (0.5 * (n0 - (c2 * cos(2 * tau) + s2 * sin(2 * tau))))) / v0 AS power FROM tau)"""
THETA = """folded AS (SELECT g.object_id, g.band, k, freq, period, mag, t, row_id, v0 * n0 AS spread, (t - t0) / period - floor((t - t0) / period) AS p
  FROM good g JOIN stats USING (object_id, band) JOIN grid USING (object_id)),
steps AS (SELECT *, coalesce(lead(mag) OVER w, first_value(mag) OVER w) - mag AS d FROM folded WINDOW w AS (PARTITION BY object_id, band, k ORDER BY p, t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
theta AS (SELECT object_id, band, k, freq, period, sum(d * d) / first(spread) AS theta FROM steps GROUP BY 1, 2, 3, 4, 5)"""
PSI = "psi AS (SELECT object_id, band, k, freq, period, power, theta, 2 * power / theta AS psi FROM power JOIN theta USING (object_id, band, k, freq, period))"
MULTI = "multi AS (SELECT object_id, k, freq, period, sum(psi) AS psi FROM psi GROUP BY 1, 2, 3, 4)"
SEARCH = f"WITH {LC}, {GOOD}, {SPAN}, {_grid()}, {STATS}, {POWER}, {THETA}, {PSI}, {MULTI}"


def _lc(spark, sf):
    return lc_events(spark, sf)


def _mag(spark, sf):
    return photometry.with_magnitude(lc_lineitem(spark, sf))


# ---- cuts, photometry, features


@query(f"WITH {LC}, {GOOD} SELECT object_id, row_id, band, {r6('t')} AS t, {r6('mag')} AS mag, {r6('magerr')} AS magerr FROM good")
def quality_cut_search(spark, sf):
    return rounded(photometry.search_cut(_lc(spark, sf)).select("object_id", "row_id", "band", "t", "mag", "magerr"), "t", "mag", "magerr")


@query(f"WITH {FLUX}, {MAG} SELECT object_id, row_id, band, {r6('mag')} AS mag, {r6('magerr')} AS magerr FROM mg WHERE magerr > 0 AND magerr <= 0.2::DOUBLE AND band IN ('A', 'R')")
def quality_cut_catalog(spark, sf):
    return rounded(photometry.catalog_cut(_mag(spark, sf), ["A", "R"]).select("object_id", "row_id", "band", "mag", "magerr"), "mag", "magerr")


@query(f"WITH {LC}, {GOOD} SELECT object_id, row_id FROM good WHERE band = 'click' AND object_id IN (SELECT object_id FROM good WHERE band = 'click' GROUP BY 1 HAVING count(*) >= 10)")
def min_obs_filter(spark, sf):
    return photometry.with_enough(photometry.search_cut(_lc(spark, sf), ["click"]), 10).select("object_id", "row_id")


@query(f"WITH {LC} SELECT band, count(*) AS n, round(avg(mag), 3) AS mean_mag, round(stddev_samp(mag), 3) AS std_mag, round(quantile_cont(magerr, 0.5), 3) AS med_err FROM lc GROUP BY 1")
def band_summary(spark, sf):
    return rounded(features.band_summary(_lc(spark, sf)), "mean_mag", "std_mag", "med_err", to=3)


@query(f"WITH {FLUX}, {MAG} SELECT object_id, row_id, {r6('mag')} AS mag, {r6('magerr')} AS magerr FROM mg")
def flux_to_mag(spark, sf):
    return rounded(_mag(spark, sf).select("object_id", "row_id", "mag", "magerr"), "mag", "magerr")


FILTERS = templates.Template("rr", ("g", "r", "i", "z", "y", "K"), DUSTY.gamma[[0, 1, 2, 0, 1, 2]], dust=DUSTY.dust[[0, 1, 2, 0, 1, 2]], betas=DUSTY.betas[[0, 1, 2, 0, 1, 2]])


def _corrections() -> str:
    cases = []
    for name, off in (("synthetic", photometry.correction()), ("empirical", photometry.correction("empirical")), ("colours", photometry.correction(colours={"g-i": 0.5, "r-i": 0.2}))):
        cases.append(f"SELECT '{name}' AS method, band, round(c0 + CASE band {' '.join(f'WHEN \'{b}\' THEN {v!r}::DOUBLE' for b, v in off.items())} ELSE 0 END, 6) AS c0, p1 FROM tpl")
    return f"WITH tpl(template_id, band, bidx, gamma, dust, c0, p1, p2) AS (VALUES {_rows([FILTERS])}) " + " UNION ALL ".join(cases)


@query(_corrections())
def filter_correction(spark, sf):
    base = templates.frame(spark, [FILTERS])
    made = [("synthetic", {}), ("empirical", {"method": "empirical"}), ("colours", {"colours": {"g-i": 0.5, "r-i": 0.2}})]
    parts = [photometry.corrected(base, **how).select(F.lit(name).alias("method"), "band", "c0", "p1") for name, how in made]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "c0")


@query(f"WITH {FLUX}, {MAG} SELECT object_id, {r6('pow(10.0::DOUBLE, (avg(mag) - 10) / 5)')} AS kpc FROM mg GROUP BY 1")
def distance_kpc(spark, sf):
    mu = _mag(spark, sf).groupBy("object_id").agg(F.avg("mag").alias("mu"))
    return rounded(mu.select("object_id", photometry.distance_kpc(F.col("mu")).alias("kpc")), "kpc")


@query(f"WITH tpl(template_id, band, bidx, gamma, dust, c0, p1, p2) AS (VALUES {_rows([DUSTY])}), per AS (SELECT o_orderkey AS id, 0.2::DOUBLE + o_orderkey % 100 / 125.0::DOUBLE AS period FROM orders) SELECT id, band, {r6('c0 + p1 * period + p2 * period * period')} AS beta FROM per, tpl")
def beta_polynomial(spark, sf):
    per = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.lit(0.2) + F.col("o_orderkey") % 100 / F.lit(125.0)).alias("period"))
    each = per.withColumn("_t", F.explode(F.array(*(F.struct(F.lit(b).alias("band"), *(F.lit(float(v)).alias(n) for n, v in zip(("c0", "p1", "p2"), DUSTY.betas[i], strict=True))) for i, b in enumerate(DUSTY.bands)))))
    return rounded(each.select("id", "_t.band", photometry.polynomial(F.col("_t.c0"), F.col("_t.p1"), F.col("_t.p2"), F.col("period")).alias("beta")), "beta")


@query(f"WITH {LC}, tpl(template_id, band, bidx, gamma, dust, c0, p1, p2) AS (VALUES {_rows([DUSTY])}) SELECT object_id, row_id, {r6('mag - coalesce(dust * (0.01::DOUBLE * (object_id % 20)), 0)')} AS mag_0 FROM lc LEFT JOIN tpl USING (band)")
def dust_subtract(spark, sf):
    lc = _lc(spark, sf)
    ebv = lc.select("object_id").distinct().withColumn("ebv", F.lit(0.01) * (F.col("object_id") % 20))
    return rounded(photometry.dereddened(lc, ebv, templates.frame(spark, [DUSTY]).select("band", "dust")).select("object_id", "row_id", "mag_0"), "mag_0")


VAR = """ok AS (SELECT * FROM lc WHERE magerr > 0 AND mag IS NOT NULL),
perband AS (SELECT object_id, band, count(*) AS n, log10(greatest(var_samp(mag) / avg(magerr * magerr), 1e-10)) AS lchi,
  log10(greatest((max(mag) - min(mag)) / sqrt(arg_max(magerr, (mag, -t, -row_id)) ** 2 + arg_min(magerr, (mag, t, row_id)) ** 2), 1e-10)) AS sig FROM ok GROUP BY 1, 2 HAVING count(*) >= 2),
feat AS (SELECT object_id, coalesce(quantile_cont(lchi, 0.5), 0) AS lchi_med, coalesce(max(sig), 0) AS sig_max FROM (SELECT DISTINCT object_id FROM lc) LEFT JOIN perband USING (object_id) GROUP BY 1)"""


@query(f"WITH {LC}, {VAR} SELECT object_id, {r6('lchi_med')} AS lchi_med, {r6('sig_max')} AS sig_max FROM feat")
def variability_features(spark, sf):
    return rounded(features.variability(_lc(spark, sf)), "lchi_med", "sig_max")


@query(f"WITH {LC}, {VAR} SELECT object_id FROM feat WHERE lchi_med >= 0.5 AND sig_max >= 0")
def variability_prefilter(spark, sf):
    return features.variable(features.variability(_lc(spark, sf))).select("object_id")


NULLM = "w AS (SELECT *, 1 / greatest(magerr * magerr, 1e-30) AS w FROM lc), wm AS (SELECT object_id, count(*) AS n_obs, sum(w * mag) / sum(w) AS m_mean FROM w GROUP BY 1), nul AS (SELECT object_id, n_obs, m_mean, sum(w * (mag - m_mean) * (mag - m_mean)) AS rss_null FROM w JOIN wm USING (object_id) GROUP BY 1, 2, 3)"


@query(f"WITH {LC}, {NULLM} SELECT object_id, n_obs, {r6('m_mean')} AS m_mean, round(rss_null, 3) AS rss_null FROM nul")
def rss_null(spark, sf):
    return rounded(rounded(features.null_model(_lc(spark, sf)), "m_mean"), "rss_null", to=3)


@query(f"WITH {LC}, a AS (SELECT object_id, stddev_pop(mag) / 100 AS A, 1 - min(magerr) / (max(magerr) * 0.5::DOUBLE) AS rss_depth FROM lc GROUP BY 1) SELECT object_id, NOT (abs(A) BETWEEN 0.3::DOUBLE AND 1.5::DOUBLE) AS flag_amp, rss_depth < 0.5 AS flag_depth FROM a")
def quality_flags(spark, sf):
    a = _lc(spark, sf).groupBy("object_id").agg((F.stddev_pop("mag") / 100).alias("A"), (1 - F.min("magerr") / (F.max("magerr") * 0.5)).alias("rss_depth"))
    return features.quality_flags(a).select("object_id", "flag_amp", "flag_depth")


@query(f"WITH {LC} SELECT band, {r6('quantile_cont(mag, 0.5)')} AS median, {r6('avg(mag)')} AS mean, {r6('stddev_pop(mag)')} AS std, min(mag) AS min, max(mag) AS max, count(mag) AS n, count(*) FILTER (isnan(mag)) AS n_nan FROM lc GROUP BY 1")
def summary_stats(spark, sf):
    return rounded(features.summary(_lc(spark, sf), "mag", ["band"]), "median", "mean", "std")


@query("SELECT count(*) FILTER (n_good < 60) AS few_obs, count(*) FILTER (n_good >= 60 AND NOT (lchi_med >= 0.5 AND sig_max >= 0)) AS not_variable, count(*) FILTER (n_good >= 60 AND lchi_med >= 0.5 AND sig_max >= 0) AS to_fit FROM (" + f"WITH {LC}, {VAR} SELECT object_id, n_good, lchi_med, sig_max FROM feat JOIN (SELECT object_id, count(*) AS n_good FROM lc GROUP BY 1) USING (object_id))")
def status_counts(spark, sf):
    lc = _lc(spark, sf)
    return features.status_counts(features.variability(lc).join(lc.groupBy("object_id").agg(F.count("*").alias("n_good")), "object_id"), 60)


@query("SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_linenumber - 1 = 0 AND l_quantity > 21 AND l_quantity < 24.5")
def object_cut(spark, sf):
    o = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") - 1).alias("extendedness"), F.col("l_quantity").alias("r_psfMag"))
    return features.point_sources(o).select("id", "line")


# ---- grids and periodograms


@query(f"WITH {LC}, {SPAN} SELECT object_id, {r6('t_min')} AS t_min, {r6('t_max')} AS t_max, {r6('span')} AS span FROM span")
def time_span(spark, sf):
    return rounded(grid.spans(_lc(spark, sf)), "t_min", "t_max", "span")


@query(f"WITH {LC}, {SPAN}, {_grid()} SELECT object_id, k, {r6('freq')} AS freq, {r6('period')} AS period FROM grid WHERE period BETWEEN 0.5::DOUBLE AND 0.9::DOUBLE")
def period_grid_search(spark, sf):
    return rounded(grid.search_grid(grid.spans(_lc(spark, sf)), PMIN, DPHI, 0.9).select("object_id", "k", "freq", "period"), "freq", "period")


@query(f"WITH {LC}, {SPAN}, {_grid(least=1)} SELECT object_id, k, {r6('freq')} AS freq, {r6('period')} AS period FROM grid WHERE period <= 0.9::DOUBLE")
def period_grid_fit(spark, sf):
    return rounded(grid.fit_grid(grid.spans(_lc(spark, sf)), PMIN, DPHI, 0.9).select("object_id", "k", "freq", "period"), "freq", "period")


@query(f"WITH {LC}, {GOOD}, {SPAN}, {_grid()}, {STATS}, {POWER} SELECT object_id, band, k, {r6('power')} AS power FROM power")
def lomb_scargle(spark, sf):
    lc = _lc(spark, sf)
    return rounded(periodogram.lomb_scargle(periodogram.usable(lc), grid.search_grid(grid.spans(lc), PMIN, DPHI)).select("object_id", "band", "k", "power"), "power")


@query(f"WITH {LC}, {GOOD}, {SPAN}, {_grid()}, {STATS}, {THETA} SELECT object_id, band, k, {r6('theta')} AS theta FROM theta")
def lafler_kinman(spark, sf):
    lc = _lc(spark, sf)
    return rounded(periodogram.lafler_kinman(periodogram.usable(lc), grid.search_grid(grid.spans(lc), PMIN, DPHI)).select("object_id", "band", "k", "theta"), "theta")


@query(f"{SEARCH} SELECT object_id, band, k, {r6('psi')} AS psi FROM psi")
def psi_periodogram(spark, sf):
    return rounded(periodogram.hybrid(_lc(spark, sf), PMIN, DPHI).select("object_id", "band", "k", "psi"), "psi")


@query(f"{SEARCH} SELECT object_id, k, {r6('psi')} AS psi FROM multi")
def psi_multiband(spark, sf):
    return rounded(periodogram.combined(periodogram.hybrid(_lc(spark, sf), PMIN, DPHI)).select("object_id", "k", "psi"), "psi")


@query(f"{SEARCH} SELECT object_id, {r6('arg_max(period, (psi, -k))')} AS period, {r6('max(psi)')} AS psi FROM multi GROUP BY 1")
def best_period(spark, sf):
    best = periodogram.search(_lc(spark, sf), PMIN, DPHI, n=0)
    return rounded(best.select("object_id", "period", F.col("power").alias("psi")), "period", "psi")


@query(f"WITH {LC}, {GOOD}, {SPAN}, {_grid()}, {STATS}, {POWER}, tot AS (SELECT object_id, k, period, sum(power) AS power FROM power GROUP BY 1, 2, 3) SELECT object_id, round(arg_max(period, (power, -k)), 6) AS period, {r6('max(power)')} AS power FROM tot GROUP BY 1")
def best_period_power(spark, sf):
    power = periodogram.hybrid(_lc(spark, sf), PMIN, DPHI, theta=False)
    return rounded(peaks.best_period(power.groupBy("object_id", "k", "period").agg(F.sum("power").alias("power")), "power"), "period", "power")


@query()
def period_search(spark, sf):
    """The search as users call it, over the production grid."""
    return pipelines.period_search(_lc(spark, sf), *PRODUCTION)


@query(f"""{SEARCH}, lm AS (SELECT *, lag(psi) OVER w AS a, lead(psi) OVER w AS b, lead(period) OVER w AS p2 FROM multi WINDOW w AS (PARTITION BY object_id ORDER BY k)),
rk AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY psi DESC, k) AS rank FROM lm WHERE psi > a AND psi > b)
SELECT object_id, rank::INT AS rank, {r6('period')} AS period, {r6('abs(period - p2) / 2')} AS period_err, {r6('psi')} AS power, k AS "index", {r6('freq')} AS freq, 0.0::DOUBLE AS thresh FROM rk WHERE rank <= 5""")
def top_periods(spark, sf):
    return rounded(pipelines.period_search(_lc(spark, sf), PMIN, DPHI, n=5), "period", "period_err", "power", "freq")


FOLD = f"WITH {LC}, {SPAN}, f AS (SELECT object_id, row_id, band, mag, ((t - floor(t_min)) / 0.7::DOUBLE) - floor((t - floor(t_min)) / 0.7::DOUBLE) AS phase FROM lc JOIN span USING (object_id))"


def _folded(spark, sf):
    lc = _lc(spark, sf)
    x = lc.join(grid.spans(lc).select("object_id", "t_min"), "object_id")
    return x.select("object_id", "row_id", "band", "mag", photometry.phase_plot(F.col("t"), F.lit(0.7), F.col("t_min")).alias("phase"))


@query(FOLD + f" SELECT object_id, row_id, band, mag, {r6('phase')} AS phase FROM f")
def phase_fold(spark, sf):
    return rounded(_folded(spark, sf), "phase")


@query(FOLD + f" SELECT object_id, row_id, band, mag, {r6('phase + c')} AS phase FROM f, (VALUES (0), (1)) v(c)")
def phase_fold_two_cycles(spark, sf):
    return rounded(_folded(spark, sf).withColumn("phase", F.explode(F.array(F.col("phase"), F.col("phase") + 1))), "phase")


# ---- templates

TPL = f"tpl(template_id, band, bidx, gamma, dust, c0, p1, p2) AS (VALUES {_rows([DUSTY])})"
LIB = f"lib(template_id, band, bidx, gamma, dust, c0, p1, p2) AS (VALUES {_rows(LIBRARY)})"


def interp(gamma: str, phase: str) -> str:
    n = f"len({gamma})"
    x = f"(({phase}) - floor({phase})) * {n}"
    lo = f"(floor({x})::BIGINT % {n})"
    return f"((1 - ({x} - floor({x}))) * {gamma}[{lo} + 1] + ({x} - floor({x})) * {gamma}[({lo} + 1) % {n} + 1])"


@query(f"WITH {LIB} SELECT template_id, band, i, {r6('(gamma[(i + 1) % len(gamma) + 1] - gamma[(i + len(gamma) - 1) % len(gamma) + 1]) * (len(gamma) / 2.0)')} AS slope FROM (SELECT *, unnest(range(0, len(gamma))) AS i FROM lib)")
def template_dgamma(spark, sf):
    x = templates.frame(spark, LIBRARY).select("template_id", "band", F.posexplode(templates.slopes(F.col("gamma"))).alias("i", "slope"))
    return rounded(x.withColumn("i", F.col("i").cast("long")), "slope")


@query(f"WITH {LC}, {TPL} SELECT object_id, row_id, {r6(interp('gamma', 't * 1.3::DOUBLE + 0.25::DOUBLE'))} AS g FROM lc JOIN tpl USING (band)")
def template_interp(spark, sf):
    x = fit.on_template(_lc(spark, sf), templates.frame(spark, [DUSTY]))
    return rounded(x.select("object_id", "row_id", templates.interpolated(F.col("gamma"), photometry.phase_fit(F.col("t"), F.lit(1.3), F.lit(0.25))).alias("g")), "g")


@query(f"WITH {LC}, {TPL}, b AS (SELECT DISTINCT object_id, 0.45::DOUBLE + (object_id % 40) / 100.0::DOUBLE AS period, (object_id % 7) / 7.0::DOUBLE AS phi FROM lc) SELECT object_id, row_id, {r6('c0 + p1 * period + p2 * period * period + 15 + 0.1::DOUBLE * dust + 0.8::DOUBLE * ' + interp('gamma', 't * (1 / period) + phi'))} AS mag_pred FROM lc JOIN tpl USING (band) JOIN b USING (object_id)")
def template_predict(spark, sf):
    obs = _lc(spark, sf).select("object_id", "row_id", "t", "band")
    return rounded(fit.predicted(obs, _best(spark, sf), templates.frame(spark, [DUSTY])).select("object_id", "row_id", "mag_pred"), "mag_pred")


def _best(spark, sf):
    return _lc(spark, sf).select("object_id").distinct().select("object_id", (F.lit(0.45) + F.col("object_id") % 40 / F.lit(100.0)).alias("period"), (F.col("object_id") % 7 / F.lit(7.0)).alias("phi"), F.lit(15.0).alias("mu"), F.lit(0.1).alias("ebv"), F.lit(0.8).alias("A"))


@query(f"WITH {LC}, {TPL}, b AS (SELECT DISTINCT object_id, 0.45::DOUBLE + (object_id % 40) / 100.0::DOUBLE AS period FROM lc), p AS (SELECT i / 20.0::DOUBLE AS phase FROM range(0, 40) r(i)) SELECT object_id, band, {r6('phase')} AS phase, {r6('c0 + p1 * period + p2 * period * period + 15 + 0.1::DOUBLE * dust + 0.8::DOUBLE * ' + interp('gamma', 'phase'))} AS mag_pred FROM b, tpl, p")
def model_curve(spark, sf):
    return rounded(fit.model_curve(_best(spark, sf), templates.frame(spark, [DUSTY]), 20), "phase", "mag_pred")


@query(f"WITH {LIB}, sets AS (SELECT template_id, list_sort(list(band)) AS bands FROM lib GROUP BY 1), same AS (SELECT template_id FROM sets WHERE bands = (SELECT arg_min(bands, template_id) FROM sets)), pt AS (SELECT band, i, {interp('gamma', 'i / 8.0::DOUBLE')} AS v FROM lib SEMI JOIN same USING (template_id), range(0, 8) r(i)) SELECT band, i, {r6('avg(v)')} AS gamma FROM pt GROUP BY 1, 2")
def template_average(spark, sf):
    x = templates.averaged(templates.frame(spark, LIBRARY), 8).select("band", F.posexplode("gamma").alias("i", "gamma"))
    return rounded(x.withColumn("i", F.col("i").cast("long")), "gamma")


@query(f"WITH {LIB}, sh AS (SELECT template_id, list_position(gamma, list_min(gamma)) - 1 AS shift FROM lib WHERE band = 'click') SELECT template_id, band, i, gamma[(i + shift) % len(gamma) + 1] AS g, shift::INT AS shift FROM (SELECT *, unnest(range(0, len(gamma))) AS i FROM lib JOIN sh USING (template_id))")
def phase_align(spark, sf):
    x = templates.aligned(templates.frame(spark, LIBRARY), "click").select("template_id", "band", F.posexplode("gamma").alias("i", "g"), "shift")
    return x.withColumn("i", F.col("i").cast("long"))


@query(f"WITH {LIB} SELECT template_id, band, i, {r6(interp('gamma', 'i / 20.0::DOUBLE'))} AS g FROM lib, range(0, 20) r(i)")
def template_resample(spark, sf):
    x = templates.frame(spark, LIBRARY).select("template_id", "band", F.posexplode(templates.resampled(F.col("gamma"), 20)).alias("i", "g"))
    return rounded(x.withColumn("i", F.col("i").cast("long")), "g")


# ---- fits

WLC = "wl AS (SELECT lc.*, 1 / (magerr * magerr) AS w FROM lc)"


def det(m) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cramer() -> str:
    a = [["s", "sd", "sg"], ["sd", "sdd", "sdg"], ["sg", "sdg", "sgg"]]
    b = ["sy", "sdy", "sgy"]
    put = lambda k: [[b[r] if k == j else a[r][j] for j in range(3)] for r in range(3)]
    return f"CASE WHEN abs({det(a)}) >= 1e-20 THEN {det(put(0))} / {det(a)} END AS mu, CASE WHEN abs({det(a)}) >= 1e-20 THEN {det(put(1))} / {det(a)} END AS ebv, CASE WHEN abs({det(a)}) >= 1e-20 THEN {det(put(2))} / {det(a)} END AS A"


SUMS = "sum(w) AS s, sum(w * d) AS sd, sum(w * g) AS sg, sum(w * d * d) AS sdd, sum(w * d * g) AS sdg, sum(w * g * g) AS sgg, sum(w * y) AS sy, sum(w * d * y) AS sdy, sum(w * g * y) AS sgy"
POINT = f"SELECT object_id, template_id, k, period, phi, w, dust AS d, mag - (c0 + p1 * period + p2 * period * period) AS y, {interp('gamma', 't * freq + phi')} AS g FROM wl JOIN tpl USING (band) JOIN trials USING (object_id)"


@query(f"WITH {LC}, {WLC}, {TPL}, trials AS (SELECT DISTINCT object_id, 0 AS k, 1 / 0.6::DOUBLE AS freq, 0.6::DOUBLE AS period, 0.25::DOUBLE AS phi FROM lc), pt AS ({POINT}), su AS (SELECT object_id, count(*) AS n, {SUMS} FROM pt GROUP BY 1) SELECT object_id, n, round(mu, 4) + 0.0 AS mu, round(ebv, 4) + 0.0 AS ebv, round(A, 4) + 0.0 AS A FROM (SELECT object_id, n, {_cramer()} FROM su)")
def linear_fit_rr(spark, sf):
    lc = fit.weighted(_lc(spark, sf))
    trials = lc.select("object_id").distinct().select("object_id", F.lit(0).alias("k"), F.lit(1 / 0.6).alias("freq"), F.lit(0.6).alias("period"), F.lit(0.25).alias("phi"))
    x = fit.linear_step(fit.points_at(lc, templates.frame(spark, [DUSTY]), trials), ["object_id"])
    return rounded(x.select("object_id", "n", "mu", "ebv", "A"), "mu", "ebv", "A", to=4)


@query(f"WITH {LC}, {WLC}, {TPL}, pt AS (SELECT object_id, band, w, mag, {interp('gamma', 't * 1.5::DOUBLE + 0.1::DOUBLE')} AS g FROM wl JOIN tpl USING (band)), mu AS (SELECT object_id, band, sum(w * (mag - 1.0 * g)) / sum(w) AS mu_b FROM pt GROUP BY 1, 2), a AS (SELECT object_id, sum(w * (mag - mu_b) * g) / sum(w * g * g) AS A FROM pt JOIN mu USING (object_id, band) GROUP BY 1) SELECT object_id, band, {r6('mu_b')} AS mu_b, {r6('A')} AS A FROM mu JOIN a USING (object_id)")
def mb_step(spark, sf):
    x = fit.on_template(fit.weighted(_lc(spark, sf)), templates.frame(spark, [DUSTY]))
    x = x.withColumn("g", templates.interpolated(F.col("gamma"), photometry.phase_fit(F.col("t"), F.lit(1.5), F.lit(0.1))))
    return rounded(fit.band_step(x.select("object_id", "band", "w", "mag", "g")), "mu_b", "A")


RSSG = f"""WITH {LC}, {WLC}, {TPL}, {SPAN}, {_grid(0.6, 1.0, 1)}, trials AS (SELECT object_id, k, freq, period, p / 4.0::DOUBLE AS phi FROM grid, range(0, 4) r(p)),
pt AS ({POINT}), su AS (SELECT object_id, template_id, k, period, phi, {SUMS} FROM pt GROUP BY 1, 2, 3, 4, 5), co AS (SELECT object_id, k, period, phi, {_cramer()} FROM su),
re AS (SELECT object_id, k, period, phi, sum(w * (y - mu - ebv * d - A * g) ** 2) AS rss FROM pt JOIN co USING (object_id, k, period, phi) GROUP BY 1, 2, 3, 4),
best AS (SELECT object_id, k, period, arg_min(phi, (rss, phi)) AS phi, min(rss) AS rss FROM re GROUP BY 1, 2, 3)"""


def _phase_grid(spark, sf):
    lc = _lc(spark, sf)
    trials = grid.fit_grid(grid.spans(lc), 0.6, 1.0).select("object_id", "k", "freq", "period")
    return fit.phase_grid(fit.weighted(lc), templates.frame(spark, [DUSTY]), trials, 4)


@query(RSSG + " SELECT object_id, k, round(rss, 2) AS rss FROM best")
def rss_phase_grid(spark, sf):
    return rounded(_phase_grid(spark, sf).select("object_id", "k", "rss"), "rss", to=2)


@query(RSSG + f" SELECT object_id, rank::INT AS rank, {r6('period')} AS period, round(rss, 2) AS rss FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY rss, k) AS rank FROM best) WHERE rank <= 5")
def fit_top_periods(spark, sf):
    return rounded(rounded(fit.fit_top_periods(_phase_grid(spark, sf), 5).select("object_id", "rank", "period", "rss"), "period"), "rss", to=2)


@query(RSSG + f", {NULLM.replace('w AS (SELECT *,', 'w AS (SELECT lc.*,').replace(' w AS', ' w0 AS').replace('w AS (SELECT lc', 'w0 AS (SELECT lc').replace('FROM w ', 'FROM w0 ')} SELECT object_id, round(min(rss) / greatest(first(rss_null), 1e-30), 5) AS rss_frac, round(1 - min(rss) / greatest(quantile_cont(rss, 0.5), 1e-30), 5) + 0.0 AS rss_depth FROM best JOIN nul USING (object_id) GROUP BY 1")
def rss_depth(spark, sf):
    g = _phase_grid(spark, sf)
    x = g.groupBy("object_id").agg(F.min("rss").alias("rss"), F.percentile("rss", F.lit(0.5)).alias("rss_median"), F.lit(10).alias("n_obs"))
    return rounded(fit.depth(x, features.null_model(_lc(spark, sf))).select("object_id", "rss_frac", "rss_depth"), "rss_frac", "rss_depth", to=5)


TRIAL = "tr AS (SELECT vec_id // 10 AS object_id, 't' || (vec_id % 10) AS template_id, round(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + 0.001, 6) AS rss, 0.4::DOUBLE + vec_id % 50 / 100.0::DOUBLE AS period, label FROM embeddings)"


def _trials(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    e = lambda i: F.pow(F.get("embedding", F.lit(i)).cast("double"), F.lit(2.0))
    return v.select(F.floor(F.col("vec_id") / 10).alias("object_id"), F.concat(F.lit("t"), (F.col("vec_id") % 10).cast("string")).alias("template_id"), F.round(e(0) + e(1) + F.lit(0.001), 6).alias("rss"), (F.lit(0.4) + F.col("vec_id") % 50 / F.lit(100.0)).alias("period"), "label")


@query(f"WITH {TRIAL} SELECT object_id, arg_min(template_id, (rss, template_id)) AS template_id, min(rss) AS rss, round(arg_min(period, (rss, template_id)), 6) AS period FROM tr GROUP BY 1")
def best_template(spark, sf):
    return rounded(fit.best_template(_trials(spark, sf)).select("object_id", "template_id", "rss", "period"), "period")


# ---- nested data, band sets


def _nested(spark, sf):
    lc = _lc(spark, sf)
    return nest(lc.select("object_id").distinct(), lc.select("object_id", "t", "row_id", "band", "mag"))


@query(f"WITH {LC} SELECT object_id, count(*)::INT AS n, arg_min(row_id, (t, band, mag, row_id)) AS first_row, {r6('sum(mag)')} AS total FROM lc GROUP BY 1")
def nest_sources(spark, sf):
    x = _nested(spark, sf)
    return rounded(x.select("object_id", F.size("sources").alias("n"), F.col("sources")[0]["row_id"].alias("first_row"), F.aggregate("sources", F.lit(0.0), lambda s, r: s + r["mag"]).alias("total")), "total")


@query(f"WITH {LC} SELECT object_id, row_id, band, {r6('t')} AS t, mag FROM lc")
def unnest_sources(spark, sf):
    return rounded(unnest(_nested(spark, sf)).select("object_id", "row_id", "band", "t", "mag"), "t")


@query("SELECT o_orderkey AS id FROM orders WHERE contains(o_orderpriority, 'URGENT')")
def struct_class_filter(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return of_class(o.select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderpriority").alias("vsx_Type")).alias("xm")), "xm.vsx_Type", "URGENT").select("id")


PRIORITIES = ("1-URGENT", "2-HIGH", "5-LOW")


def _sets(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("template_id"), F.col("o_orderpriority").alias("band"))


@query("WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS b FROM orders GROUP BY 1) SELECT array_to_string(b, ',') AS bands, count(*) AS n FROM s GROUP BY b ORDER BY n DESC, b LIMIT 1")
def modal_band_set(spark, sf):
    return templates.modal_bands(_sets(spark, sf)).select(F.array_join("bands", ",").alias("bands"), "n")


@query(f"WITH s AS (SELECT o_custkey AS object_id, list_sort(list(DISTINCT o_orderpriority)) AS b FROM orders GROUP BY 1) SELECT object_id, array_to_string(list_filter(b, lambda x: x NOT IN {PRIORITIES}), ',') AS missing, array_to_string(list_filter(b, lambda x: x IN {PRIORITIES}), ',') AS shared, len(list_filter(b, lambda x: x NOT IN {PRIORITIES})) = 0 AS is_subset FROM s")
def band_set_ops(spark, sf):
    own = F.array(*map(F.lit, PRIORITIES))
    x = templates.band_sets(_sets(spark, sf)).withColumn("m", F.sort_array(F.array_except("bands", own)))
    return x.select(F.col("template_id").alias("object_id"), F.array_join("m", ",").alias("missing"), F.array_join(F.sort_array(F.array_intersect("bands", own)), ",").alias("shared"), (F.size("m") == 0).alias("is_subset"))


@query(f"WITH {LIB} SELECT template_id, band FROM lib WHERE template_id IN (SELECT template_id FROM lib WHERE band IN ('purchase', 'view') GROUP BY 1 HAVING count(*) >= 2) AND band IN ('purchase', 'view')")
def template_subset(spark, sf):
    return templates.sharing(templates.frame(spark, LIBRARY), ["purchase", "view"]).where(F.col("band").isin("purchase", "view")).select("template_id", "band")


# ---- colours

CP = """r AS (SELECT * FROM lc WHERE band = 'purchase'), o AS (SELECT * FROM lc WHERE band IN ('click', 'view')),
pr AS (SELECT r.object_id, CASE WHEN o.band = 'view' THEN r.mag - o.mag END AS ri, CASE WHEN o.band = 'click' THEN o.mag - r.mag END AS gr FROM r JOIN o ON r.object_id = o.object_id AND abs(r.t - o.t) < 6.0::DOUBLE / 24.0::DOUBLE),
cp AS (SELECT object_id, count(ri) AS n_ri, min(ri) AS ri_min, count(gr) AS n_gr, min(gr) AS gr_min FROM pr GROUP BY 1)"""
COLOURS = ("click", "purchase", "view")


@query(f"WITH {LC}, {CP} SELECT object_id, n_ri, {r6('ri_min')} AS ri_min, n_gr, {r6('gr_min')} AS gr_min FROM cp")
def color_pairs(spark, sf):
    return rounded(features.colour_pairs(_lc(spark, sf), COLOURS, 6.0), "ri_min", "gr_min")


@query(f"WITH {LC}, {CP}, mean AS (SELECT object_id, avg(mag) FILTER (band = 'click') - avg(mag) FILTER (band = 'purchase') AS gr FROM lc GROUP BY 1) SELECT object_id, CASE WHEN ri_min IS NOT NULL OR gr_min IS NOT NULL THEN coalesce(ri_min < 0.068::DOUBLE, FALSE) OR coalesce(gr_min < 0.268::DOUBLE, FALSE) ELSE coalesce(gr < 0.488::DOUBLE, TRUE) END AS passes FROM mean LEFT JOIN cp USING (object_id)")
def color_cut(spark, sf):
    return features.colour_cut(_lc(spark, sf), COLOURS, 6.0)


@query(f"WITH {LC}, {TPL} SELECT band, {r6('avg(mag)')} AS obs_mean, {r6('c0 + p1 * 0.6::DOUBLE + p2 * 0.6::DOUBLE * 0.6::DOUBLE')} AS beta, {r6('avg(mag) - (c0 + p1 * 0.6::DOUBLE + p2 * 0.6::DOUBLE * 0.6::DOUBLE)')} AS mu_implied FROM lc JOIN tpl USING (band) GROUP BY band, c0, p1, p2")
def color_diagnostics(spark, sf):
    return rounded(features.colour_diagnostics(_lc(spark, sf), templates.frame(spark, [DUSTY]), 0.6), "obs_mean", "beta", "mu_implied")


# ---- library analysis

EMB = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"
L2 = "SELECT a.id, b.id AS id2, sqrt(list_sum(list_transform(range(1, len(a.vec) + 1), lambda i: (a.vec[i] - b.vec[i]) ** 2))) AS dist FROM v a JOIN v b ON a.id < b.id"
LV = f"lv AS (SELECT template_id AS id, flatten(list(gamma ORDER BY band)) AS vec FROM lib WHERE template_id IN (SELECT template_id FROM lib GROUP BY 1 HAVING count(*) = 3 AND min(len(gamma)) = 8) GROUP BY 1)"


def _vecs(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


@query(f"WITH {EMB}, d AS ({L2}) SELECT id, id2, {r6('dist')} AS dist FROM d")
def pairwise_l2(spark, sf):
    return library.pairwise_l2(_vecs(spark, sf), to=6)


@query(f"WITH {EMB}, c AS (SELECT id, list_transform(vec, lambda x: x - list_avg(vec)) AS vec FROM v), u AS (SELECT id, list_transform(vec, lambda x: x / (sqrt(list_dot_product(vec, vec)) + 1e-12)) AS vec FROM c) SELECT a.id, b.id AS id2, {r6('1 - list_dot_product(a.vec, b.vec)')} AS dist FROM u a JOIN u b ON a.id < b.id")
def pearson_distance(spark, sf):
    return library.pearson_distance(_vecs(spark, sf), to=6)


@query(f"WITH {EMB}, d AS ({L2}) SELECT count(*) AS n, {r6('avg(dist)')} AS mean, {r6('quantile_cont(dist, 0.5)')} AS median, {r6('max(dist)')} AS max, {r6('min(dist) FILTER (dist > 0)')} AS min_positive FROM d")
def distance_summary(spark, sf):
    return rounded(library.distance_summary(library.pairwise_l2(_vecs(spark, sf))), "mean", "median", "max", "min_positive")


RT = "rt AS (SELECT object_id AS trial, template_id, rss, period, 't' || (object_id % 10) AS truth_id FROM tr)"


def _recovery(spark, sf):
    return _trials(spark, sf).select(F.col("object_id").alias("trial"), "template_id", "rss", "period", F.concat(F.lit("t"), (F.col("object_id") % 10).cast("string")).alias("truth_id"))


@query(f"WITH {TRIAL}, {RT}, m AS (SELECT *, min(rss) OVER (PARTITION BY trial) AS m FROM rt) SELECT trial, count(*) FILTER (rss <= 1.1::DOUBLE * m) AS n_10, count(*) FILTER (rss <= 1.5::DOUBLE * m) AS n_50 FROM m GROUP BY 1")
def competitive_counts(spark, sf):
    return library.competitive_counts(_recovery(spark, sf))


LOO = "m AS (SELECT *, min(rss) OVER (PARTITION BY trial) AS m FROM rt), f AS (SELECT *, (rss <= 1.5::DOUBLE * m)::INT AS flag FROM m), o AS (SELECT *, sum(flag) OVER (PARTITION BY template_id) - flag AS others FROM f)"


@query(f"WITH {TRIAL}, {RT}, {LOO} SELECT trial, count(*) AS n_union, min(rss) AS rss_best, {r6('(min(rss) - first(m)) / first(m)')} AS excess FROM o WHERE others > 0 GROUP BY 1")
def loo_union(spark, sf):
    return rounded(library.loo_union(_recovery(spark, sf), 1.5), "excess")


EX = "full_ AS (SELECT trial, min(rss) AS rf, first(truth_id) AS truth_id FROM rt GROUP BY 1), part AS (SELECT trial, min(rss) AS rs FROM rt WHERE template_id IN ('t1', 't4', 't7') GROUP BY 1), ex AS (SELECT trial, rf, rs, (rs - rf) / rf AS excess, truth_id IN ('t1', 't4', 't7') AS truth_in FROM full_ JOIN part USING (trial))"


def _excess(spark, sf):
    return library.excess(_recovery(spark, sf), spark.createDataFrame([("t1",), ("t4",), ("t7",)], "template_id string"))


@query(f"WITH {TRIAL}, {RT}, {EX} SELECT trial, rf AS rss_full, rs AS rss_subset, {r6('excess')} AS excess, truth_in FROM ex")
def subset_excess(spark, sf):
    return rounded(_excess(spark, sf), "excess")


@query(f"WITH {TRIAL}, {RT}, {EX} SELECT truth_in, {r6('quantile_cont(excess, 0.5)')} AS median, {r6('quantile_cont(excess, 0.75)')} AS p75, {r6('quantile_cont(excess, 0.9)')} AS p90, {r6('max(excess)')} AS max FROM ex GROUP BY 1")
def excess_quantiles(spark, sf):
    return rounded(library.excess_quantiles(_excess(spark, sf), ["truth_in"]), "median", "p75", "p90", "max")


@query("WITH e AS (SELECT CASE WHEN label % 2 = 0 THEN 'ab' ELSE 'c' END AS truth, CASE WHEN embedding[1] > 0 THEN 'ab' ELSE 'c' END AS v1, CASE WHEN embedding[2] > 0 THEN 'ab' ELSE 'c' END AS v2 FROM embeddings), l AS (SELECT truth, 'v1' AS variant, v1 AS found FROM e UNION ALL SELECT truth, 'v2', v2 FROM e) SELECT truth AS class, variant, count(*) FILTER (found = truth) AS n_ok, count(*) AS n FROM l GROUP BY 1, 2")
def class_accuracy(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    side = lambda c: F.when(c, F.lit("ab")).otherwise(F.lit("c"))
    x = v.select(side(F.col("label") % 2 == 0).alias("truth"), side(F.get("embedding", F.lit(0)) > 0).alias("v1"), side(F.get("embedding", F.lit(1)) > 0).alias("v2"))
    return library.accuracy(x, ["v1", "v2"])


CAL = "st AS (SELECT c_nationkey AS healpix, c_mktsegment AS band, c_acctbal::DOUBLE / 1000 AS mean_mag, 1 + abs(c_acctbal::DOUBLE) / 500 + c_custkey % 13 AS chi2 FROM customer)"


@query(f"WITH {CAL}, g AS (SELECT *, log10(chi2) AS y FROM st), m AS (SELECT healpix, band, avg(mean_mag) AS m, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 10), s AS (SELECT healpix, band, m, n, sum(mean_mag - m) AS s1, sum((mean_mag - m) ** 2) AS s2, sum((mean_mag - m) ** 3) AS s3, sum((mean_mag - m) ** 4) AS s4, sum(y) AS y0, sum((mean_mag - m) * y) AS y1, sum((mean_mag - m) ** 2 * y) AS y2 FROM g JOIN m USING (healpix, band) GROUP BY 1, 2, 3, 4), d AS (SELECT *, {det([['n', 's1', 's2'], ['s1', 's2', 's3'], ['s2', 's3', 's4']])} AS d, {det([['y0', 's1', 's2'], ['y1', 's2', 's3'], ['y2', 's3', 's4']])} AS e0, {det([['n', 'y0', 's2'], ['s1', 'y1', 's3'], ['s2', 'y2', 's4']])} AS e1, {det([['n', 's1', 'y0'], ['s1', 's2', 'y1'], ['s2', 's3', 'y2']])} AS e2 FROM s) SELECT healpix, band, n, {r6('e0 / d - e1 / d * m + e2 / d * m * m')} AS a0, {r6('e1 / d - 2 * (e2 / d) * m')} AS a1, {r6('e2 / d')} AS a2 FROM d WHERE abs(d) > 1e-20")
def error_rescale(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    stars = c.select(F.col("c_nationkey").alias("healpix"), F.col("c_mktsegment").alias("band"), (F.col("c_acctbal").cast("double") / 1000).alias("mean_mag"), (1 + F.abs(F.col("c_acctbal").cast("double")) / 500 + F.col("c_custkey") % 13).alias("chi2"))
    return rounded(features.error_rescale(stars), "a0", "a1", "a2")


# ---- iterative and random operators (no SQL; see the tests)


def _sparse(spark, sf):
    return photometry.search_cut(_lc(spark, sf), list(BANDS3))


@query()
def template_fit_rr(spark, sf):
    return fit.fit(_sparse(spark, sf), [DUSTY], *PRODUCTION).drop("mu_band")


@query()
def template_fit_mb(spark, sf):
    return fit.fit(_sparse(spark, sf), [PLAIN], *PRODUCTION).withColumn("mu_band", F.array_join(F.transform(F.array_sort(F.map_entries("mu_band")), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"], 4).cast("string"))), ","))


@query()
def template_fit_warm(spark, sf):
    return fit.fit(_sparse(spark, sf), [DUSTY], *PRODUCTION, warm=True).drop("mu_band")


@query()
def library_fit(spark, sf):
    return fit.best_template(fit.fit(_sparse(spark, sf), LIBRARY, *PRODUCTION, blocks=4)).drop("mu_band")


@query()
def candidate_job(spark, sf):
    return pipelines.candidates(_lc(spark, sf), LIBRARY, list(BANDS3), pipelines.Job(blocks=4))


@query()
def two_stage(spark, sf):
    return pipelines.two_stage(_sparse(spark, sf), LIBRARY[:4]).drop("mu_band")


@query()
def mc_threshold(spark, sf):
    return periodogram.threshold(_lc(spark, sf), *PRODUCTION, runs=2, seed=1)


DIGEST = "md5('3:' || row_id::VARCHAR)"


@query(f"WITH {LC}, a AS (SELECT *, row_number() OVER (PARTITION BY object_id, band ORDER BY t, row_id) AS i FROM lc), b AS (SELECT object_id, band, mag AS mag_scrambled, row_number() OVER (PARTITION BY object_id, band ORDER BY {DIGEST}, row_id) AS i FROM lc) SELECT object_id, row_id, band, mag, mag_scrambled FROM a JOIN b USING (object_id, band, i)")
def scramble(spark, sf):
    return periodogram.scrambled(_lc(spark, sf), 3).select("object_id", "row_id", "band", "mag", "mag_scrambled")


@query(f"WITH {LC}, a AS (SELECT *, ('0x' || substr({DIGEST}, 1, 8))::BIGINT % count(*) OVER (PARTITION BY object_id, band) + 1 AS i FROM lc), b AS (SELECT object_id, band, mag AS mag_bootstrap, row_number() OVER (PARTITION BY object_id, band ORDER BY t, row_id) AS i FROM lc) SELECT object_id, row_id, band, mag_bootstrap FROM a JOIN b USING (object_id, band, i)")
def bootstrap(spark, sf):
    return periodogram.bootstrapped(_lc(spark, sf), 3).select("object_id", "row_id", "band", "mag_bootstrap")


def _uniform(what: str) -> str:
    return f"((('0x' || substr(md5('5:' || trial || ':' || b || ':' || j || ':{what}'), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)"


SIM = f"""{LIB}, tr AS (SELECT i AS trial, 't' || (i % 8) AS template_id, 0.45::DOUBLE + 0.01::DOUBLE * i AS period FROM range(0, 24) r(i)),
nb AS (SELECT template_id, count(*) AS nb FROM lib GROUP BY 1),
ob AS (SELECT trial, period, band, gamma, bidx AS b, unnest(range(0, 30 // nb + (bidx < 30 % nb)::INT)) AS j FROM tr JOIN lib USING (template_id) JOIN nb USING (template_id)),
dr AS (SELECT *, 180.0::DOUBLE * {_uniform('t')} AS t, sqrt(-2 * ln({_uniform('r')})) * cos({2 * math.pi!r}::DOUBLE * {_uniform('a')}) AS z FROM ob)"""


def _truth(spark):
    return spark.range(24).select(F.col("id").alias("trial"), F.concat(F.lit("t"), (F.col("id") % 8).cast("string")).alias("template_id"), (F.lit(0.45) + F.lit(0.01) * F.col("id")).alias("period"))


@query(f"WITH {SIM} SELECT trial AS object_id, row_number() OVER (PARTITION BY trial ORDER BY t, b, j) - 1 AS row_id, {r6('t')} AS t, band, {r6('20.0::DOUBLE + 1.0::DOUBLE * gamma[floor((t / period - floor(t / period)) * len(gamma))::BIGINT % len(gamma) + 1] + 0.05::DOUBLE * z')} AS mag FROM dr")
def simulate_lc(spark, sf):
    made = library.simulate(spark, _truth(spark), LIBRARY, seed=5)
    return rounded(made.drop("magerr"), "t", "mag")


@query()
def recovery_study(spark, sf):
    """Simulate, fit by the whole library on the production grid, and what leaving half of the library out costs."""
    rss = pipelines.recovery_study(spark, _truth(spark), LIBRARY, blocks=4, pmin=0.4, dphi=0.02, pmax=0.75)
    some = spark.createDataFrame([("t1",), ("t3",), ("t5",), ("t7",)], "template_id string")
    return library.excess(rss, some).join(library.competitive_counts(rss), "trial")


@query()
def pca(spark, sf):
    return rounded(library.principal(_vecs(spark, sf)), "eigenvalue", "fraction", "cumulative")


@query()
def kmedoids(spark, sf):
    return rounded(library.kmedoids(_vecs(spark, sf), [2, 5, 10]), "cost")


@query()
def avg_linkage(spark, sf):
    return rounded(library.average_linkage(_vecs(spark, sf)), "height")


@query()
def rf_classify(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(8)), (F.col("label") % 2).cast("double").alias("label"))
    model, _ = library.classify(v, [f"x{i}" for i in range(8)])
    return model.transform(v).select("vec_id", "prediction")


# ---- further operators of the inventory


@query(f"WITH {EMB}, e AS (SELECT unnest(range(0, len(vec))) AS i, unnest(vec) AS x FROM v), s AS (SELECT var_samp(x) AS s FROM e GROUP BY i) SELECT count(*) AS n, {r6('sum(s)')} AS total, 1.0::DOUBLE AS cumulative FROM s")
def pca_total(spark, sf):
    """The eigenvalues add up to the variances of all coordinates."""
    x = library.principal(_vecs(spark, sf))
    return rounded(x.agg(F.count("*").alias("n"), F.sum("eigenvalue").alias("total"), F.max("cumulative").alias("cumulative")), "total", "cumulative")


FITS = """ft AS (SELECT c_custkey AS object_id, abs(c_acctbal::DOUBLE) / 5000 AS A, 1 - c_nationkey / 30.0::DOUBLE AS rss_depth, (1 + c_custkey % 97) / 97.0::DOUBLE AS rss_frac,
  c_custkey % 7 / 5.0::DOUBLE AS ebv, c_custkey % 11 / 2.0::DOUBLE AS kappa, 0.2::DOUBLE + c_custkey % 80 / 100.0::DOUBLE AS period, c_mktsegment AS kind, 4 + c_custkey % 40 AS n_obs, 1 + abs(c_acctbal::DOUBLE) AS rss FROM customer)"""


def _fits(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    key, money = F.col("c_custkey"), F.abs(F.col("c_acctbal").cast("double"))
    return c.select(
        key.alias("object_id"), (money / 5000).alias("A"), (1 - F.col("c_nationkey") / F.lit(30.0)).alias("rss_depth"), ((1 + key % 97) / F.lit(97.0)).alias("rss_frac"), (key % 7 / F.lit(5.0)).alias("ebv"),
        (key % 11 / F.lit(2.0)).alias("kappa"), (F.lit(0.2) + key % 80 / F.lit(100.0)).alias("period"), F.col("c_mktsegment").alias("kind"), (4 + key % 40).alias("n_obs"), (1 + money).alias("rss"),
    )


FLAGGED = FITS + ", fl AS (SELECT *, NOT (abs(A) BETWEEN 0.3::DOUBLE AND 1.5::DOUBLE) AS flag_amp, rss_depth < 0.5 AS flag_depth FROM ft)"


@query(f"WITH {FLAGGED} SELECT object_id, {r6('A')} AS A FROM fl WHERE NOT flag_amp AND NOT flag_depth")
def clean_set(spark, sf):
    return rounded(features.clean(features.quality_flags(_fits(spark, sf))).select("object_id", "A"), "A")


@query(f"WITH {FLAGGED} SELECT object_id, {r6('rss_frac')} AS rss_frac FROM fl WHERE NOT flag_amp AND NOT flag_depth ORDER BY fl.rss_frac, object_id LIMIT 15")
def clean_head(spark, sf):
    return rounded(features.best_clean(features.quality_flags(_fits(spark, sf))).select("object_id", "rss_frac"), "rss_frac")


@query(f"WITH {FITS} SELECT object_id FROM ft WHERE ebv > 1.0 OR A < 0.3::DOUBLE OR A > 2.0 OR kappa > 5.0")
def documented_rejects(spark, sf):
    return features.rejects(_fits(spark, sf)).select("object_id")


@query(f"WITH {FITS}, c AS (SELECT *, period > 0.4::DOUBLE AND period < 0.9::DOUBLE AS ab, period > 0.25::DOUBLE AND period < 0.45::DOUBLE AS c FROM ft) SELECT object_id, CASE WHEN ab AND c THEN kind WHEN ab THEN 'RRab' WHEN c THEN 'RRc' END AS class FROM c")
def period_class(spark, sf):
    return _fits(spark, sf).select("object_id", features.period_class(F.col("period"), F.col("kind")).alias("class"))


@query(f"WITH {FITS} SELECT object_id, round(rss / greatest(n_obs - 4, 1), 9) + 0.0 AS rss_dof, round(A / (rss / greatest(n_obs - 4, 1)), 9) + 0.0 AS amp_rss FROM ft")
def fit_features(spark, sf):
    x = features.classification_features(_fits(spark, sf)).select("object_id", "rss_dof", "amp_rss")
    return rounded(x, "rss_dof", "amp_rss", to=9)


@query(f"WITH {TRIAL} SELECT object_id, template_id, abs(period - (0.4::DOUBLE + object_id % 50 / 100.0::DOUBLE)) < 0.105::DOUBLE AS correct FROM tr")
def period_correct(spark, sf):
    x = _trials(spark, sf).withColumn("period_true", F.lit(0.4) + F.col("object_id") % 50 / F.lit(100.0))
    return peaks.period_correct(x, 0.105).select("object_id", "template_id", "correct")


@query(f"WITH {LC}, o AS (SELECT object_id, count(*) AS n_good FROM lc GROUP BY 1) SELECT * FROM o ORDER BY n_good DESC, object_id LIMIT 1")
def best_observed(spark, sf):
    return features.best_observed(_lc(spark, sf))


@query(f"WITH {LC}, a AS (SELECT object_id, sqrt(avg(cos({2 * math.pi!r}::DOUBLE * t / 0.7::DOUBLE)) ** 2 + avg(sin({2 * math.pi!r}::DOUBLE * t / 0.7::DOUBLE)) ** 2) AS r FROM lc GROUP BY 1) SELECT object_id, {r6('r')} AS r_bar, {r6('r * (2 - r * r) / (1 - r * r)')} AS kappa FROM a")
def phase_concentration(spark, sf):
    return rounded(features.phase_concentration(_lc(spark, sf), 0.7), "r_bar", "kappa")


@query(f"WITH {LC}, {TPL}, d AS (SELECT band, avg(mag) AS m, c0 + p1 * 0.6::DOUBLE + p2 * 0.6::DOUBLE * 0.6::DOUBLE AS beta FROM lc JOIN tpl USING (band) GROUP BY band, c0, p1, p2), x AS (SELECT max(m) FILTER (band = 'click') - max(m) FILTER (band = 'view') AS o, max(beta) FILTER (band = 'click') - max(beta) FILTER (band = 'view') AS t FROM d) SELECT {r6('o')} AS observed, {r6('t')} AS template, {r6('o - t')} AS excess FROM x")
def color_excess(spark, sf):
    x = features.colour_diagnostics(_lc(spark, sf), templates.frame(spark, [DUSTY]), 0.6)
    return rounded(features.colour_excess(x, "click", "view"), "observed", "template", "excess")


@query(f"WITH {LC}, {SPAN} SELECT object_id, i - 1 AS k, {r6('1 / period')} AS freq, period FROM span, (VALUES (1, 0.4::DOUBLE), (2, 0.55::DOUBLE), (3, 0.7::DOUBLE)) v(i, period)")
def period_grid_explicit(spark, sf):
    return rounded(grid.explicit_grid(grid.spans(_lc(spark, sf)), [0.4, 0.55, 0.7]).select("object_id", "k", "freq", "period"), "freq")


@query(f"WITH {LC}, s AS (SELECT object_id, list_sort(list(DISTINCT band)) AS b FROM lc GROUP BY 1) SELECT object_id, array_to_string(list_filter(b, lambda x: x NOT IN {BANDS3}), ',') AS bands FROM s WHERE len(list_filter(b, lambda x: x NOT IN {BANDS3})) > 0")
def unknown_bands(spark, sf):
    x = templates.unknown_bands(_lc(spark, sf), DUSTY)
    return x.select("object_id", F.array_join(F.sort_array("bands"), ",").alias("bands"))


@query(f"WITH {LIB}, s AS (SELECT template_id AS id, flatten(list(gamma ORDER BY band)) AS vec FROM lib GROUP BY 1) SELECT id, i, {r6('vec[i + 1]')} AS v FROM (SELECT *, unnest(range(0, len(vec))) AS i FROM s)")
def library_vectors(spark, sf):
    x = library.vectors(templates.frame(spark, LIBRARY)).select("id", F.posexplode("vec").alias("i", "v"))
    return rounded(x.withColumn("i", F.col("i").cast("long")), "v")


def _kept(spark, name: str) -> str:
    """A folder for what a round trip writes: under the shared folder of the session where it has one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="starfold-")
    return f"{root.rstrip('/')}/starfold-{name}-{uuid.uuid4().hex}"


@query(f"WITH {LC} SELECT object_id, row_id, {r6('t')} AS t, band, mag, {r6('magerr')} AS magerr FROM lc")
def csv_round_trip(spark, sf):
    path = _kept(spark, "csv")
    sources.write_csv(_lc(spark, sf), path)
    return rounded(spark.read.option("header", True).schema(schema.LIGHT_CURVE).csv(path), "t", "magerr")


@query(f"WITH {LC} SELECT object_id, band, count(*) AS n, {r6('avg(mag)')} AS mean FROM lc GROUP BY 1, 2")
def catalog_round_trip(spark, sf):
    """A catalog partitioned by directory, read back with the columns that are asked for."""
    path = _kept(spark, "catalog")
    _lc(spark, sf).write.partitionBy("band").parquet(path)
    x = sources.read_catalog(spark, path, ["object_id", "band", "mag"])
    return rounded(x.groupBy("object_id", "band").agg(F.count("*").alias("n"), F.avg("mag").alias("mean")), "mean")


CODES = {b: i for i, b in enumerate(("cart", "click", "login", "purchase", "view"))}


@query(f"WITH {LC} SELECT 0::BIGINT AS object_id, {r6('t')} AS t, band, mag, {r6('magerr')} AS magerr FROM lc WHERE band IN {tuple(CODES)}")
def text_round_trip(spark, sf):
    """White-space columns with band codes, as the instrument's files have them."""
    path = _kept(spark, "text")
    code = F.create_map(*(F.lit(x) for p in CODES.items() for x in p))[F.col("band")]
    lines = _lc(spark, sf).where(F.col("band").isin(*CODES)).select(F.concat_ws("  ", "t", "mag", "magerr", code.cast("double")).alias("value"))
    lines.write.text(path)
    return rounded(sources.read_text(spark, path, list(CODES)).drop("row_id"), "t", "magerr")


@query(f"WITH {FITS} SELECT object_id, {r6('rss_frac')} AS rss_frac, {r6('A')} AS A FROM ft")
def candidate_sink(spark, sf):
    path = _kept(spark, "candidates")
    sources.write_candidates(_fits(spark, sf), path)
    return rounded(spark.read.parquet(path).select("object_id", "rss_frac", "A"), "rss_frac", "A")


@query(f"WITH {FITS} SELECT object_id, {r6('period')} AS period FROM ft")
def checkpoint_reuse(spark, sf):
    """The second call reads what the first has written."""
    path = _kept(spark, "checkpoint")
    sources.checkpointed(_fits(spark, sf).select("object_id", "period"), path)
    return rounded(sources.checkpointed(_fits(spark, sf).select("object_id", "period").where("false"), path), "period")


TEXTS = [f"b{i}.txt" for i in range(3)]


def _lines(spark):
    """Three template texts in odd orders of columns and rows, with a short line and a phase past the cycle, made from the library."""
    x = templates.frame(spark, LIBRARY[:3]).select("template_id", "band", F.posexplode("gamma").alias("i", "v"), F.size("gamma").alias("n"))
    rows = x.select("template_id", F.concat_ws(",", F.col("band"), F.col("v"), F.col("i") / F.col("n")).alias("line"), F.xxhash64("band", "i").alias("o"))
    extra = spark.createDataFrame([(t.name, line, o) for t in LIBRARY[:3] for line, o in (("short", 1), ("click,9.0,1.5", 2))], "template_id string, line string, o long")
    place = F.row_number().over(Window.partitionBy("template_id").orderBy("o"))
    heads = spark.createDataFrame([(t.name, 0, "Band, MAG ,phase") for t in LIBRARY[:3]], "template_id string, place int, line string")
    return heads.unionByName(rows.unionByName(extra).select("template_id", place.alias("place"), "line"))


@query(f"WITH lib(template_id, band, bidx, gamma, dust, c0, p1, p2) AS (VALUES {_rows(LIBRARY[:3])}) SELECT template_id, band, i, {r6(interp('gamma', 'i / 20.0::DOUBLE'))} AS g FROM lib, range(0, 20) r(i)")
def template_text(spark, sf):
    good, _ = templates.from_lines(_lines(spark), 20)
    x = good.select("template_id", "band", F.posexplode("gamma").alias("i", "g"))
    return rounded(x.withColumn("i", F.col("i").cast("long")), "g")


@query(f"WITH {TPL} SELECT band, bidx, {r6('dust')} AS dust, {r6('c0')} AS c0, {r6('p1')} AS p1, {r6('p2')} AS p2, gamma[3] AS g FROM tpl")
def template_csv(spark, sf):
    """A template folder of three CSV files, written from a template and loaded back."""
    path = _kept(spark, "rr")
    t = DUSTY
    texts = {
        "templates.csv": [",".join([b, *map(str, t.gamma[i])]) for i, b in enumerate(t.bands)],
        "dust.csv": [f"'{b}', {t.dust[i]}" for i, b in enumerate(t.bands)],
        "betas.csv": [",".join(t.bands), *(",".join(str(t.betas[i, k]) for i in range(len(t.bands))) for k in range(3))],
    }
    for name, lines in texts.items():
        spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(f"{path}/{name}")
    x = templates.load_csv(spark, path).select("band", "bidx", "dust", "c0", "p1", "p2", F.get("gamma", F.lit(2)).alias("g"))
    return rounded(x, "dust", "c0", "p1", "p2")


@query()
def catalog_fit(spark, sf):
    """The catalog call: fluxes to magnitudes, cuts, and one template's fit over the production grid."""
    lc = _lc(spark, sf)
    flux = F.pow(F.lit(10.0), (F.lit(31.4) - F.col("mag")) / 2.5)
    rows = lc.withColumn("flux", flux).withColumn("flux_err", F.col("flux") * F.col("magerr") * (math.log(10) / 2.5)).drop("mag", "magerr")
    return pipelines.catalog_fit(rows, PLAIN, list(BANDS3), pmin=0.44, pmax=0.89).drop("mu_band")
