import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import fit, grid, peaks, periodogram, templates
from starfold.plans import pipelines
from starfold.schema import LIGHT_CURVE


def star(spark, period=0.5016, n=60, bands=("g", "r"), noise=0.02, span=60.0, seed=42, objects=1, curve=None):
    rng = np.random.default_rng(seed)
    rows = []
    for o in range(objects):
        for b in bands:
            t = np.sort(rng.uniform(0, span, n))
            m = 14 + 0.5 * np.sin(2 * np.pi * t / period) if curve is None else curve(b, t)
            rows += [(o, len(rows) + i, float(x), b, float(y), noise) for i, (x, y) in enumerate(zip(t, m + rng.normal(0, noise, n), strict=True))]
    return spark.createDataFrame(rows, LIGHT_CURVE)


def naive_power(t, m, f):
    """Lomb-Scargle by least squares on sine and cosine about the mean (an independent formula)."""
    c = m - m.mean()
    out = []
    for x in f:
        a = np.column_stack([np.cos(2 * np.pi * x * t), np.sin(2 * np.pi * x * t)])
        sol = np.linalg.lstsq(a, c, rcond=None)[0]
        out.append((c @ c - np.square(c - a @ sol).sum()) / (2 * m.var()))
    return np.array(out)


def test_power_matches_least_squares():
    rng = np.random.default_rng(1)
    t, m, f = rng.uniform(0, 10, 40), rng.normal(size=40), np.linspace(0.3, 4, 50)
    assert periodogram.power_of(t, m, f)[0] == pytest.approx(naive_power(t, m, f), rel=1e-8)


def test_theta_by_hand():
    t, m = np.array([0.0, 0.3, 0.6, 1.1]), np.array([1.0, 2.0, 4.0, 1.5])
    # period 1: phases 0, .3, .6, .1 -> order 0, 3, 1, 2
    steps = np.square([0.5, 0.5, 2.0, -3.0]).sum()
    assert periodogram.theta_of(t, m, np.array([1.0]))[0, 0] == pytest.approx(steps / np.square(m - m.mean()).sum())


def test_kernels_agree_and_find_the_period(spark):
    lc = star(spark, objects=3)
    arrow = periodogram.hybrid(lc, 0.4, 0.05, 0.9)
    good, g = periodogram.usable(lc), grid.search_grid(grid.spans(lc), 0.4, 0.05, 0.9)
    rel = periodogram.lomb_scargle(good, g).join(periodogram.lafler_kinman(good, g).select("object_id", "band", "k", "theta"), ["object_id", "band", "k"])
    both = arrow.select("object_id", "band", "k", F.col("power").alias("p"), F.col("theta").alias("q")).join(rel, ["object_id", "band", "k"])
    n, dp, dq = both.agg(F.count("*"), F.max(F.abs(F.col("p") - F.col("power"))), F.max(F.abs(F.col("q") - F.col("theta")))).first()
    assert n == arrow.count() == rel.count() and dp < 1e-8 and dq < 1e-8
    for r in pipelines.period_search(lc, 0.4, 0.05, 0.9, n=3).where("rank = 1").collect():
        assert r["period"] == pytest.approx(0.5016, abs=2e-3) and r["freq"] == pytest.approx(1 / r["period"])


def test_large_curves_go_the_relational_way(spark, monkeypatch):
    lc = star(spark)
    want = periodogram.hybrid(lc, 0.4, 0.2, 0.9).orderBy("band", "k").toPandas()
    monkeypatch.setattr(periodogram, "LARGE", 10)
    got = periodogram.hybrid(lc, 0.4, 0.2, 0.9).orderBy("band", "k").toPandas()
    assert np.allclose(got["psi"], want["psi"])


def test_odd_curves_give_no_rows(spark):
    rows = [(1, 0, 1.0, "g", 20.0, 0.1), (2, 1, 0.0, "g", 20.0, 0.1), (2, 2, 9.0, "g", 20.0, 0.1), (3, 3, 0.0, "g", None, 0.1), (3, 4, 5.0, "g", float("nan"), 0.1)]
    lc = spark.createDataFrame(rows, LIGHT_CURVE)
    assert periodogram.hybrid(lc, 0.5, 0.2).count() == 0
    assert periodogram.threshold(lc, 0.5, 0.2).count() == 0
    assert grid.search_grid(grid.spans(lc), 100.0, 0.2).count() == 0
    assert grid.fit_grid(grid.spans(lc), 100.0, 0.2).count() == 2
    with pytest.raises(ValueError):
        grid.search_grid(grid.spans(lc), 0.5, 0.2, 0.4)


def test_explicit_grid(spark):
    got = grid.explicit_grid(grid.spans(star(spark, n=5)), [0.4, 0.5]).orderBy("k").collect()
    assert [(r["k"], r["period"], r["freq"]) for r in got] == [(0, 0.4, 2.5), (1, 0.5, 2.0)]


def test_peaks(spark):
    rng = np.random.default_rng(0)
    psi = rng.uniform(size=500)
    psi[249:252] = 0.8, 10, 0.9
    p = np.linspace(0.2, 2.0, 500)
    df = spark.createDataFrame([(1, k, float(1 / p[k]), float(p[k]), float(psi[k]), 2.0) for k in range(500)], "object_id long, k long, freq double, period double, psi double, thresh double")
    top = peaks.top_periods(df, 5).orderBy("rank").collect()
    assert top[0]["index"] == 250 and top[0]["period"] == p[250] and top[0]["thresh"] == 2.0 and len(top) == 5
    assert top[0]["period_err"] == pytest.approx(abs(p[250] - p[251]) / 2)
    with pytest.raises(Exception, match="local maxima"):
        peaks.top_periods(df, 400, strict=True).collect()
    tied = df.withColumn("psi", F.lit(1.0))
    assert peaks.best_period(tied).first()["period"] == p[0] and peaks.top_periods(tied).count() == 0


def test_threshold_is_seeded_and_scaled(spark):
    lc = star(spark, n=30)
    a, b, c = (periodogram.threshold(lc, 0.45, 0.2, 0.6, 2, seed).orderBy("band", "k").toPandas() for seed in (1, 1, 2))
    assert a.equals(b) and not np.allclose(a["thresh"], c["thresh"])
    one = periodogram.threshold(lc, 0.45, 0.2, 0.6, 1, 1).toPandas().groupby("band")
    for _, x in one:  # each of the two realisations is rescaled to the real total
        assert x["thresh"].sum() == pytest.approx(2 * x["psi"].sum())
    assert (periodogram.threshold(lc, 0.45, 0.2, 0.6, 0).toPandas()["thresh"] == 0).all()


def test_scramble_permutes(spark):
    lc = star(spark, n=30, objects=2)
    got = periodogram.scrambled(lc, 5).toPandas()
    for _, x in got.groupby(["object_id", "band"]):
        assert sorted(x["mag"]) == sorted(x["mag_scrambled"]) and list(x["mag"]) != list(x["mag_scrambled"])
    boot = periodogram.bootstrapped(lc, 5).toPandas()
    assert len(boot) == 120 and set(boot["mag_bootstrap"]) <= set(got["mag"])


TPL = templates.synthetic("rr", ("g", "r"), 100, 0.15)
FLAT = templates.synthetic("mb", ("g", "r"), 100, 0.15, dusty=False)


def injected(tpl, period, mu=14.0, ebv=0.05, amp=0.7):
    def curve(b, t):
        i = tpl.bands.index(b)
        g = fit.interpolate(tpl.gamma, np.full(len(t), i), t / period)
        if tpl.dust is None:
            return mu + i + amp * g
        return tpl.betas[i] @ [1, period, period**2] + mu + ebv * tpl.dust[i] + amp * g

    return curve


def test_fit_recovers_injected_values(spark):
    lc = star(spark, n=40, curve=injected(TPL, 0.55), noise=0.01)
    r = fit.fit(lc, [TPL], 0.5, 0.01, 0.6).first()
    assert r["period"] == pytest.approx(0.55, rel=0.01) and r["A"] == pytest.approx(0.7, abs=0.05) and r["mu"] == pytest.approx(14.0, abs=0.1)
    assert r["rss"] / r["n_obs"] < 3  # descends to the noise
    m = fit.fit(star(spark, n=40, curve=injected(FLAT, 0.55), noise=0.01), [FLAT], 0.45, 0.1, 0.7).first()
    assert m["period"] == pytest.approx(0.55, rel=0.01) and m["mu"] is None
    assert m["mu_band"]["g"] == pytest.approx(14.0, abs=0.05) and m["mu_band"]["r"] == pytest.approx(15.0, abs=0.05)


def test_phase_step_signs_and_warm_start():
    rng = np.random.default_rng(3)
    t = rng.uniform(0, 60, 80)
    bands = np.array(["g", "r"] * 40)
    m = np.where(bands == "g", injected(TPL, 0.55)("g", t), injected(TPL, 0.55)("r", t)) + rng.normal(0, 0.01, 80)
    freq = fit.frequencies(t, 0.5, 0.05, 0.6)
    args = (t, m, np.full(80, 0.01), bands.tolist(), TPL, freq)
    cold = fit.fitted(*args)[0]
    assert cold.min() <= fit.fitted(*args, phase_step="reference")[0].min()
    warm = fit.fitted(*args, warm=True)
    assert 1 / freq[warm[0].argmin()] == pytest.approx(0.55, rel=0.02)
    with pytest.raises(ValueError, match="not in template bands"):
        fit.fitted(t, m, np.full(80, 0.01), ["z"] * 80, TPL, freq)


def test_relational_step_matches_numpy(spark):
    lc = star(spark, n=30, curve=injected(TPL, 0.55))
    trial = spark.createDataFrame([(0, 0, 1 / 0.55, 0.55, 0.1)], "object_id long, k long, freq double, period double, phi double")
    points = fit.points_at(fit.weighted(lc), templates.frame(spark, [TPL]), trial)
    got = fit.linear_step(points, ["object_id"]).first()
    p = points.toPandas()
    x = np.column_stack([np.ones(len(p)), p["d"], p["g"]]) * np.sqrt(p["w"].to_numpy())[:, None]
    assert [got["mu"], got["ebv"], got["A"]] == pytest.approx(np.linalg.lstsq(x, p["y"] * np.sqrt(p["w"]), rcond=None)[0], rel=1e-5)


def test_interpolation_wraps(spark):
    gamma = np.array([[0.0, 1.0, 2.0, 3.0]])
    phases = [0.0, 0.25, 0.125, 0.875, 1.0, -0.25, 0.9999999]
    want = fit.interpolate(gamma, np.zeros(7, int), np.array(phases))
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], p) for p in phases], "g array<double>, p double")
    got = [r[0] for r in df.select(templates.interpolated(F.col("g"), F.col("p"))).collect()]
    assert got == pytest.approx(list(want)) and want[:6] == pytest.approx([0, 1, 0.5, 1.5, 0, 3])


def test_library_two_stage_and_candidates(spark):
    lib = [templates.synthetic(f"s{i}", ("g", "r"), 50, 0.05 + 0.1 * i, dusty=False) for i in range(4)] + [templates.synthetic("one", ("g", "zz"), 50, 0.1, dusty=False)]
    lc = star(spark, n=40, objects=3, curve=injected(lib[2], 0.55), noise=0.01)
    best = fit.best_template(fit.fit(lc, lib, 0.5, 0.1, 0.6, blocks=3)).collect()
    assert len(best) == 3 and all(r["template_id"] == "s2" for r in best)
    two = pipelines.two_stage(lc, lib[:4], coarse=0.1, fine=0.02, pmin=0.5, pmax=0.6).collect()
    assert len(two) == 3 and all(abs(r["period"] - 0.55) < 1e-3 and r["template_id"] == "s2" for r in two)
    job = pipelines.Job.parse(["a", "b", "--pmin", "0.5", "--pmax", "0.6", "--dphi", "0.1"])
    assert (job.pmin, job.min_obs, job.varfilter) == (0.5, 10, True)
    got = pipelines.candidates(lc, lib, ["g", "r", "i"], job).collect()
    assert len(got) == 3 and got[0].asDict().keys() == dict.fromkeys(pipelines.CANDIDATE).keys()
    assert all(r["mu_i"] is None and r["rss_frac"] < 0.1 and not r["flag_depth"] for r in got)
    still = star(spark, n=40, curve=lambda b, t: 14 + 0 * t)
    assert pipelines.candidates(still, lib, ["g", "r"], job).count() == 0
    assert pipelines.candidates(still, lib, ["g", "r"], pipelines.Job(pmin=0.5, pmax=0.6, dphi=0.1, varfilter=False)).first()["lchi_med"] is None


def test_catalog_fit_skips_thin_objects(spark):
    lc = star(spark, n=20, objects=2, curve=injected(TPL, 0.55)).where("object_id = 0 or row_id % 20 < 2")
    flux = lc.select("object_id", "row_id", "t", "band", F.pow(F.lit(10.0), (31.4 - F.col("mag")) / 2.5).alias("flux")).withColumn("flux_err", F.col("flux") * 0.02)
    got = pipelines.catalog_fit(flux, TPL, ["g", "r", "y"], pmin=0.5, dphi=0.2, pmax=0.6).collect()
    assert [r["object_id"] for r in got] == [0] and math.isfinite(got[0]["rss"])


def test_registered_queries_use_the_production_settings(monkeypatch):
    from starfold.plans import registry

    calls = []

    class Any:
        def __getattr__(self, name):
            return lambda *a, **k: self

    def note(*a, **k):
        calls.append((a[2:], k))
        return Any()

    for module, name in ((registry.fit, "fit"), (registry.pipelines, "two_stage"), (registry.periodogram, "threshold"), (registry.pipelines, "candidates")):
        monkeypatch.setattr(module, name, note)
    for name in ("_sparse", "_lc"):
        monkeypatch.setattr(registry, name, lambda *a: None)
    for name in ("template_fit_rr", "template_fit_warm", "two_stage", "candidate_job"):
        registry.QUERIES[name](None, None)
    (rr, _), (warm, _), two, (job, _) = calls
    assert rr == warm == (0.2, 0.02) and two == ((), {})
    assert (job[1].pmin, job[1].pmax, job[1].dphi) == (0.44, 0.89, 0.02)


def test_fit_in_the_jvm_is_that_of_the_kernels(spark):
    """No Python works on the stars, and every value is that of the NumPy kernels, warm walks and windows too."""
    lc = star(spark, n=20, objects=3, curve=injected(TPL, 0.55)).withColumn("magerr", F.when(F.col("row_id") % 7 == 0, 0.0).otherwise(F.col("magerr") * (1 + F.col("row_id") % 3)))
    own = {o: p.sort_values(["t", "row_id"]) for o, p in lc.toPandas().groupby("object_id")}
    short = templates.synthetic("short", ("g",), 12, 0.1, dusty=False)
    for tpl, how in ((TPL, {}), (FLAT, {}), (short, {"use_errors": False}), (TPL, {"warm": True}), (TPL, {"phase_step": "reference", "starts": 3, "newton": 2})):
        dphi = 10.0 if how.get("warm") else 0.1  # a warm walk of many trials blows up last digits, in NumPy alone too
        df = fit.fit(lc, [tpl], 0.4, dphi, **how)
        assert "Python" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan and "Arrow" not in plan
        got = {r["object_id"]: r for r in df.collect()}
        assert set(got) == set(own)
        for o, p in own.items():
            p = p[p["band"].isin(tpl.bands)]
            t, m, e = (p[c].to_numpy(float) for c in ("t", "mag", "magerr"))
            freq = fit.frequencies(t, 0.4, dphi)
            rss, phi, coef = fit.fitted(t, m, e, p["band"].tolist(), tpl, freq, **how)
            k, r = rss.argmin(), got[o]
            assert [r["period"], r["phi"], r["rss"], r["rss_median"], r["A"], r["n_obs"]] == pytest.approx([1 / freq[k], phi[k], rss[k], np.median(rss), coef[k, -1], len(p)], rel=1e-6)
            if tpl.dust is None:
                assert r["mu"] is None and r["mu_band"] == pytest.approx(dict(zip(tpl.bands, coef[k, :-1])))
            else:
                assert r["mu_band"] is None and [r["mu"], r["ebv"]] == pytest.approx(list(coef[k, :2]), rel=1e-6)


def test_fit_blocks_of_any_shape_are_those_of_the_kernels(spark):
    """Lanes go in blocks: a last block cut short, odd and many starts, one trial, curves that leave room for few lanes."""
    rng = np.random.default_rng(5)
    for n, pmin, dphi, how in ((31, 0.3, 0.5, {"starts": 3}), (20, 0.3, 0.5, {"starts": 1}), (6, 0.5, 0.5, {"starts": 200}), (3000, 0.9, 0.7, {}), (20, 80.0, 0.1, {}), (9, 0.3, 0.5, {"newton": 0})):
        for tpl in (TPL, FLAT):
            t = np.sort(rng.uniform(0, 30, n))
            bands = ["g" if x else "r" for x in rng.integers(0, 2, n)]
            m, e = 14 + np.sin(12.5 * t) + rng.normal(0, 0.1, n), rng.uniform(0.05, 0.2, n)
            lc = spark.createDataFrame([(1, i, float(t[i]), bands[i], float(m[i]), float(e[i])) for i in range(n)], LIGHT_CURVE)
            r = fit.fit(lc, [tpl], pmin, dphi, **how).first()
            freq = fit.frequencies(t, pmin, dphi)
            rss, phi, coef = fit.fitted(t, m, e, bands, tpl, freq, **how)
            k = rss.argmin()
            assert [r["period"], r["phi"], r["rss"], r["rss_median"], r["A"]] == pytest.approx([1 / freq[k], phi[k], rss[k], np.median(rss), coef[k, -1]], rel=1e-6)


def test_a_fit_by_windows_spreads_over_tasks(spark):
    """Stars of the second stage go to as many tasks as the session asks for, though their bytes would fit one."""
    lc = star(spark, n=10, objects=24, curve=injected(FLAT, 0.55))
    windows = lc.select("object_id").distinct().select("object_id", F.lit("mb").alias("template_id"), F.lit(0.5).alias("low"), F.lit(0.6).alias("high"))
    found = fit.fit(lc, [FLAT], dphi=0.1, windows=windows).withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 24 and len({r["task"] for r in found}) == 4


def test_fits_by_templates_of_any_width_are_those_of_the_kernels(spark):
    """Short templates go without a look-up, long ones with it; bands hold one to ten rows, one of them none."""
    rng = np.random.default_rng(8)
    bands = ["g"] * 10 + ["r"] * 7 + ["i"]
    t, m, e = np.sort(rng.uniform(0, 30, 18)), 14 + rng.normal(0, 0.4, 18), rng.uniform(0.05, 0.2, 18)
    bands = [bands[i] for i in rng.permutation(18)]
    lc = spark.createDataFrame([(1, i, float(t[i]), bands[i], float(m[i]), float(e[i])) for i in range(18)], LIGHT_CURVE)
    for wide in (2, 3, 4, 5, 8, 9, 12, 16, 17, 40):
        for dusty in (True, False):
            tpl = templates.synthetic("w", ("g", "r", "z", "i"), wide, 0.1, dusty=dusty)
            r = fit.fit(lc, [tpl], 0.3, 0.5).first()
            freq = fit.frequencies(t, 0.3, 0.5)
            rss, phi, coef = fit.fitted(t, m, e, bands, tpl, freq)
            k = rss.argmin()
            assert [r["period"], r["phi"], r["rss"], r["rss_median"], r["A"]] == pytest.approx([1 / freq[k], phi[k], rss[k], np.median(rss), coef[k, -1]], rel=1e-6)
            if dusty:
                assert [r["mu"], r["ebv"]] == pytest.approx(list(coef[k, :2]), rel=1e-6)
            else:
                assert r["mu_band"] == pytest.approx({b: x for b, x in zip(tpl.bands, coef[k, :-1]) if b != "z"}, rel=1e-6)


def test_a_fit_does_not_depend_on_the_level_of_magnitudes(spark):
    """A step takes differences of sums, so nothing may be lost in them to a large mean."""
    lc = star(spark, n=15, objects=4, curve=injected(TPL, 0.55)).withColumn("mag", F.round(F.col("mag") * 1024) / 1024)
    for tpl in (TPL, FLAT):
        low, high = ({r["object_id"]: r for r in fit.fit(x, [tpl], 0.4, 0.1).collect()} for x in (lc, lc.withColumn("mag", F.col("mag") + 2.0**30)))
        for o, r in low.items():
            assert [high[o][c] for c in ("period", "phi", "rss", "rss_median", "A")] == pytest.approx([r[c] for c in ("period", "phi", "rss", "rss_median", "A")], rel=1e-7)


def test_threshold_holds_the_bands_of_a_trial_period_together(spark):
    """So files hold frequency and period once for all bands, of which one may be null, constant or a single row."""
    lc = star(spark, n=12, objects=2, bands=("g", "r", "i", "z")).withColumn("mag", F.when(F.col("band") == "i", 14.0).otherwise(F.col("mag")))
    lc = lc.where("band != 'z' or row_id % 12 = 0").withColumn("band", F.when(F.col("band") != "r", F.col("band")))
    rows = periodogram.threshold(lc, 0.4, 0.5, runs=2, seed=3).collect()
    by = {o: [(r["k"], r["band"]) for r in rows if r["object_id"] == o] for o in (0, 1)}
    for own in by.values():
        assert own == [(k, b) for k in range(len(own) // 2) for b in ("g", None)] and own
