import math

import pytest
from pyspark.sql import functions as F

from starfold.functions import features, photometry
from starfold.operators import templates
from starfold.schema import LIGHT_CURVE

NAN = float("nan")


def lc(spark, rows):
    """Rows of (object, t, band, mag, magerr)."""
    return spark.createDataFrame([(o, i, float(t), b, m, e) for i, (o, t, b, m, e) in enumerate(rows)], LIGHT_CURVE)


def test_magnitudes_and_back(spark):
    flux = [(10 ** ((31.4 - m) / 2.5), 1.0) for m in (22.0, 23.5, 24.0)] + [(0.0, 1.0), (-5.0, 1.0), (NAN, 1.0), (None, 1.0)]
    got = photometry.with_magnitude(spark.createDataFrame(flux, "flux double, flux_err double")).collect()
    assert [r["mag"] for r in got[:3]] == pytest.approx([22.0, 23.5, 24.0], abs=1e-6)
    assert all(r["mag"] is None and r["magerr"] == 9.99 for r in got[3:])
    assert got[0]["magerr"] == pytest.approx(2.5 / math.log(10) / flux[0][0])


def test_cuts_differ_on_zero_error(spark):
    rows = lc(spark, [(1, 0, "g", 20.0, e) for e in (0.0, 0.2, 0.21, -0.1, NAN, None)] + [(1, 0, "x", 20.0, 0.1)])
    assert photometry.search_cut(rows, ["g"]).count() == 2
    assert photometry.catalog_cut(rows, ["g"]).count() == 1
    assert photometry.with_enough(rows, 7).count() == 7 and photometry.with_enough(rows, 8).count() == 0


def test_corrections(spark):
    base = templates.frame(spark, [templates.synthetic("a", ("g", "r"), 8, 0.1)])
    moved = {r["band"]: (r["c0"], r["p1"]) for r in photometry.corrected(base, colours={}).collect()}
    plain = {r["band"]: (r["c0"], r["p1"]) for r in base.collect()}
    assert moved["g"][0] - plain["g"][0] == pytest.approx(0.01053, abs=1e-9)
    assert moved["r"][0] - plain["r"][0] == pytest.approx(0.06415 - 0.03582 + 0.0, abs=2e-2)
    assert moved["g"][1] == plain["g"][1]
    dustless = templates.frame(spark, [templates.synthetic("b", ("g", "r"), 8, 0.1, dusty=False)])
    assert photometry.corrected(dustless).collect() == dustless.collect()
    with pytest.raises(ValueError, match="unknown"):
        photometry.correction("other")


def test_variability(spark):
    rows = [(1, t, "g", 20 + 0.001 * (t % 2), 0.02) for t in range(20)] + [(2, t, "g", 20 + 0.5 * (t % 2), 0.02) for t in range(20)] + [(3, 0, "g", 20.0, 0.02), (4, 0, "g", None, 0.02), (4, 1, "g", NAN, 0.02)]
    got = {r["object_id"]: (r["lchi_med"], r["sig_max"]) for r in features.variability(lc(spark, rows)).collect()}
    assert got[1][0] < 0 and got[2][0] >= 0.5 and got[2][1] > 0
    assert got[3] == got[4] == (0.0, 0.0)
    assert [r["object_id"] for r in features.variable(features.variability(lc(spark, rows))).collect()] == [2]


def test_colour_cut_cascade(spark):
    h = 1 / 24
    rows = [
        (1, 0, "r", 20.0, 0.1), (1, 0.5 * h, "i", 19.99, 0.1),  # blue pair
        (2, 0, "r", 20.0, 0.1), (2, 0.5 * h, "i", 19.0, 0.1),  # red pair
        (3, 0, "r", 20.0, 0.1), (3, h, "i", 20.5, 0.1), (3, 5, "g", 21.0, 0.1),  # at the limit: no pair; mean g-r red
        (4, 0, "r", 20.0, 0.1), (4, 3, "g", 20.1, 0.1),  # no pair, mean blue
        (5, 0, "i", 20.0, 0.1),  # no colour
    ]
    got = {r["object_id"]: r["passes"] for r in features.colour_cut(lc(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_summary_is_poisoned_by_nan(spark):
    got = {r["k"]: r for r in features.summary(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", NAN)], "k string, x double"), "x", ["k"]).collect()}
    assert (got["a"]["median"], got["a"]["mean"], got["a"]["std"], got["a"]["n_nan"]) == (2.0, 2.0, 1.0, 0)
    assert math.isnan(got["b"]["mean"]) and got["b"]["n_nan"] == 1


def test_flags_and_classes(spark):
    fits = spark.createDataFrame([(0.5, 0.9, 0.1), (-2.0, 0.9, 0.1), (0.5, 0.2, 0.1), (0.5, 0.9, 2.0)], "A double, rss_depth double, ebv double")
    flagged = features.quality_flags(fits)
    assert [(r["flag_amp"], r["flag_depth"]) for r in flagged.collect()] == [(False, False), (True, False), (False, True), (False, False)]
    assert features.clean(flagged).count() == 2 and features.rejects(fits).count() == 2
    p = spark.createDataFrame([(0.42, "RRc"), (0.42, "RRab"), (0.6, "RRc"), (0.3, "RRab"), (1.5, "RRab")], "p double, kind string")
    assert [r[0] for r in p.select(features.period_class(F.col("p"), F.col("kind"))).collect()] == ["RRc", "RRab", "RRab", "RRc", None]


def test_error_rescale_finds_the_quadratic(spark):
    rows = [(1, "g", 18 + 0.1 * k, 10 ** (0.3 + 0.2 * (18 + 0.1 * k) - 0.01 * (18 + 0.1 * k) ** 2)) for k in range(20)] + [(2, "g", 20.0, 1.0)] * 9
    got = features.error_rescale(spark.createDataFrame(rows, "healpix long, band string, mean_mag double, chi2 double")).collect()
    assert len(got) == 1 and [got[0][c] for c in ("a0", "a1", "a2")] == pytest.approx([0.3, 0.2, -0.01], abs=1e-6)
