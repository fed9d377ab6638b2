"""Whole analyses: the period search, catalog fits, the candidate job, and the two-stage search."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.functions import features
from starfold.functions.photometry import catalog_cut, with_enough, with_magnitude
from starfold.operators import fit as fits
from starfold.operators import peaks, periodogram
from starfold.operators.templates import Template

CANDIDATE = ["object_id", "period", "template_id", "mu_g", "mu_r", "mu_i", "A", "phi", "n_good", "lchi_med", "sig_max", "rss_frac", "rss_depth", "flag_amp", "flag_depth"]


@dataclass
class Job:
    """Settings of the candidate job."""

    input: str = ""
    output: str = ""
    pmin: float = 0.44
    pmax: float = 0.89
    dphi: float = 0.02
    min_obs: int = 10
    varfilter: bool = True
    blocks: int = 8

    @classmethod
    def parse(cls, argv: list[str]) -> Job:
        p = argparse.ArgumentParser(description="Fit a template library to alert light curves.")
        p.add_argument("input")
        p.add_argument("output")
        for name, kind in (("pmin", float), ("pmax", float), ("dphi", float), ("min-obs", int), ("blocks", int)):
            p.add_argument(f"--{name}", type=kind, default=getattr(cls, name.replace("-", "_")))
        p.add_argument("--no-varfilter", action="store_true")
        a = p.parse_args(argv)
        return cls(a.input, a.output, a.pmin, a.pmax, a.dphi, a.min_obs, not a.no_varfilter, a.blocks)


def period_search(lc: DataFrame, pmin: float, dphi: float, pmax: float | None = None, runs: int = 0, n: int = 10, seed: int = 0) -> DataFrame:
    """Ranked candidate periods of every object from psi summed over bands; with ``runs`` also their significance level."""
    if not runs:
        return periodogram.search(lc, pmin, dphi, pmax, n)
    return peaks.top_periods(periodogram.combined(periodogram.threshold(lc, pmin, dphi, pmax, runs, seed)), n)


def recovery_study(spark, trials: DataFrame, library: list[Template], n_obs: int = 30, noise: float = 0.05, span: float = 180.0, seed: int = 0, blocks: int = 8, **how) -> DataFrame:
    """``trial, template_id, rss, period, truth_id, period_true``: simulate each trial, then fit it by the whole library.

    ``trials`` has ``trial, template_id, period``; what ``excess``, ``competitive_counts`` and ``loo_union`` work on.
    """
    from starfold.operators.library import simulate

    found = fits.fit(simulate(spark, trials, library, n_obs, noise, span, seed=seed), library, blocks=blocks, **how)
    truth = trials.select("trial", F.col("template_id").alias("truth_id"), F.col("period").alias("period_true"))
    return found.select(F.col("object_id").alias("trial"), "template_id", "rss", "period").join(truth, "trial")


def catalog_fit(flux: DataFrame, template: Template, bands: list[str], least: int = 10, **how) -> DataFrame:
    """Best fit per object of a flux catalog: magnitudes, the catalog cut on bands the template has, at least ``least`` rows, fit."""
    known = [b for b in bands if b in template.bands]
    lc = with_enough(catalog_cut(with_magnitude(flux), known), least)
    return fits.fit(lc, [template], **how)


def prepared(lc: DataFrame, bands: list[str], job: Job) -> tuple[DataFrame, DataFrame]:
    """(light curves to fit, every object's ``n_good, lchi_med, sig_max``): cuts, counts and the variability filter run before any fit."""
    good = catalog_cut(lc, bands)
    per = good.groupBy("object_id").agg(F.count("*").alias("n_good"))
    feats = per.join(features.variability(good), "object_id")
    keep = feats.where(F.col("n_good") >= job.min_obs)
    if job.varfilter:
        keep = features.variable(keep)
    return good.join(keep.select("object_id"), "object_id", "left_semi"), feats


def candidates(lc: DataFrame, library: list[Template], bands: list[str], job: Job, **how) -> DataFrame:
    """The candidate table: every object that passes the filters with its best template of the library, depth and flags.

    Templates sharing fewer than two bands with ``bands`` are not tried; objects that no template fits are left out.
    """
    tried = [t for t in library if len(set(t.bands) & set(bands)) >= 2]
    rows, feats = prepared(lc, bands, job)
    best = fits.best_template(fits.fit(rows, tried, job.pmin, job.dphi, job.pmax, job.blocks, **how))
    out = features.quality_flags(fits.depth(best, features.null_model(rows))).join(feats, "object_id")
    if not job.varfilter:
        out = out.withColumn("lchi_med", F.lit(None).cast("double")).withColumn("sig_max", F.lit(None).cast("double"))
    for b in "gri":
        out = out.withColumn(f"mu_{b}", F.try_element_at("mu_band", F.lit(b)))
    return out.select(*CANDIDATE)


def two_stage(lc: DataFrame, small: list[Template], half_width: float = 0.05, floor: float = 0.15, pmin: float = 0.2, pmax: float = 1.0, coarse: float = 0.05, fine: float = 0.005) -> DataFrame:
    """Coarse fits over a small library, then the winner again on a fine grid around its period."""
    first = fits.best_template(fits.fit(lc, small, pmin, coarse, pmax, blocks=min(8, max(1, len(small))), newton=3, starts=4))
    window = first.select("object_id", "template_id", F.greatest(F.col("period") - half_width, F.lit(floor)).alias("low"), (F.col("period") + half_width).alias("high"))
    return fits.fit(lc, small, dphi=fine, windows=window, newton=5, starts=4)
