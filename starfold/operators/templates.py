"""Light-curve templates: reading, interpolation, alignment, averaging and band sets.

A template row is one band: ``template_id, band, bidx, gamma array<double>, dust, c0, p1, p2``; without dust the template
is fitted with an offset per band.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.schema import TEMPLATE


@dataclass(frozen=True)
class Template:
    """One template on the driver or in a task."""

    name: str
    bands: tuple[str, ...]
    gamma: np.ndarray  # (bands, phases)
    dust: np.ndarray | None = None
    betas: np.ndarray | None = field(default=None)  # (bands, 3): constant, linear and quadratic term in the period

    def slopes(self) -> np.ndarray:
        """Circular central difference by phase."""
        return (np.roll(self.gamma, -1, 1) - np.roll(self.gamma, 1, 1)) * (self.gamma.shape[1] / 2)

    def rows(self) -> list[tuple]:
        d = [None] * len(self.bands) if self.dust is None else [float(x) for x in self.dust]
        b = np.zeros((len(self.bands), 3)) if self.betas is None else self.betas
        return [(self.name, band, i, [float(x) for x in self.gamma[i]], d[i], *map(float, b[i])) for i, band in enumerate(self.bands)]

    def subset(self, bands: list[str]) -> Template:
        """These bands in this order; unknown ones are an error."""
        if missing := sorted(set(bands) - set(self.bands)):
            raise ValueError(f"bands {missing} not in template bands {list(self.bands)}")
        i = [self.bands.index(b) for b in bands]
        return Template(self.name, tuple(bands), self.gamma[i], None if self.dust is None else self.dust[i], None if self.betas is None else self.betas[i])


def frame(spark: SparkSession, templates: list[Template]) -> DataFrame:
    return spark.createDataFrame([r for t in templates for r in t.rows()], TEMPLATE)


def collect(df: DataFrame) -> list[Template]:
    """Templates of a library frame; a library is hundreds of short curves, and this is where it crosses to the driver."""
    by: dict[str, list] = {}
    for r in df.orderBy("template_id", "bidx").collect():
        by.setdefault(r["template_id"], []).append(r)
    out = []
    for name, rows in by.items():
        dust = None if any(r["dust"] is None for r in rows) else np.array([r["dust"] for r in rows])
        out.append(Template(name, tuple(r["band"] for r in rows), np.array([r["gamma"] for r in rows], float), dust, None if dust is None else np.array([[r["c0"], r["p1"], r["p2"]] for r in rows])))
    return out


def load_csv(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """A template from ``templates.csv`` (band, values; no header), ``betas.csv`` (header of bands; three rows) and ``dust.csv`` (band, value).

    Bands without dust get 0, bands without betas 0, 0, 0.
    """
    name = name or folder.rstrip("/").rsplit("/", 1)[-1]
    clean = lambda c: F.regexp_replace(F.trim(c), "[\"']", "")
    line = F.split("value", ",")
    lines = spark.read.text(f"{folder}/templates.csv").where(F.trim("value") != "").withColumn("_o", F.monotonically_increasing_id())
    gamma = lines.select("_o", F.trim(clean(F.get(line, F.lit(0)))).alias("band"), F.transform(F.slice(line, 2, 1 << 30), lambda x: F.trim(x).cast("double")).alias("gamma"))
    dust = spark.read.text(f"{folder}/dust.csv").where(F.trim("value") != "").select(F.trim(clean(F.get(line, F.lit(0)))).alias("band"), F.expr("try_cast(trim(get(split(value, ','), 1)) as double)").alias("_dust"))
    betas = spark.read.option("header", True).csv(f"{folder}/betas.csv").withColumn("_r", F.monotonically_increasing_id())
    cols = [c for c in betas.columns if c != "_r"]
    long = betas.withColumn("_r", F.row_number().over(Window.orderBy("_r"))).unpivot("_r", [F.col(f"`{c}`").cast("double").alias(c) for c in cols], "band", "v").withColumn("band", F.trim(clean(F.col("band"))))
    beta = long.groupBy("band").agg(*(F.max(F.when(F.col("_r") == i + 1, F.col("v"))).alias(c) for i, c in enumerate(("_c0", "_p1", "_p2"))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = gamma.join(dust, "band", "left").join(beta, "band", "left")
    return joined.select(F.lit(name).alias("template_id"), "band", (F.row_number().over(Window.orderBy("_o")) - 1).alias("bidx"), "gamma", zero("_dust").alias("dust"), zero("_c0").alias("c0"), zero("_p1").alias("p1"), zero("_p2").alias("p2"))


def periodic(phase: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Values at k/n by linear interpolation on the circle."""
    return np.interp(np.arange(n) / n, phase, value, period=1.0)


def on_circle(points: Column, n: int) -> Column:
    """Values at k/n of ``points`` (phase, value), sorted: linear between neighbours, the last point standing one turn before the first."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    point = lambda phase, value: F.struct(phase.alias("phase"), value.alias("value"))
    closed = F.concat(F.array(point(last["phase"] - 1, last["value"])), points, F.array(point(first["phase"] + 1, first["value"])))

    def at(k: Column) -> Column:
        x = k / F.lit(float(n))
        low = F.element_at(F.filter(closed, lambda p: p["phase"] <= x), -1)
        high = F.element_at(F.filter(closed, lambda p: p["phase"] > x), 1)
        return low["value"] + (high["value"] - low["value"]) * (x - low["phase"]) / (high["phase"] - low["phase"])

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def from_lines(lines: DataFrame, n_phase: int = 100) -> tuple[DataFrame, DataFrame]:
    """(templates, rejects) of rows ``template_id, place, line``: text with header ``phase, mag, band`` in any order and case.

    Lines with too few fields are skipped, phases from 1 on left out.  A template is a reject if its header lacks a column, a
    number cannot be read, or a band has no point left.
    """
    name = Window.partitionBy("template_id")
    part = F.transform(F.split(F.trim("line"), ","), lambda x: F.trim(x))
    x = lines.where(F.trim("line") != "").withColumn("part", part).withColumn("first", F.min("place").over(name))
    x = x.withColumn("head", F.max(F.when(F.col("place") == F.col("first"), F.transform("part", F.lower))).over(name))
    for c in ("phase", "mag", "band"):
        x = x.withColumn(f"at_{c}", F.array_position("head", c).cast("int"))
    missing = (F.col("at_phase") == 0) | (F.col("at_mag") == 0) | (F.col("at_band") == 0)
    need = F.greatest("at_phase", "at_mag", "at_band")
    rows = x.where((F.col("place") > F.col("first")) & ~missing & (F.size("part") >= need))
    read = lambda c: F.try_element_at("part", F.when(F.col(f"at_{c}") > 0, F.col(f"at_{c}")))
    rows = rows.select("template_id", read("band").alias("band"), F.expr("try_cast(try_element_at(part, at_phase) as double)").alias("phase"), F.expr("try_cast(try_element_at(part, at_mag) as double)").alias("value"))
    points = F.array_sort(F.collect_list(F.when(F.col("phase") < 1, F.struct("phase", "value"))))
    by_band = rows.groupBy("template_id", "band").agg(points.alias("points"), F.max(F.col("phase").isNull() | F.col("value").isNull()).alias("bad"))
    state = by_band.groupBy("template_id").agg(F.max("bad").alias("bad"), F.min(F.size("points")).alias("least"))
    known = x.groupBy("template_id").agg(F.max(missing).alias("missing")).join(state, "template_id", "left")
    why = F.when(F.col("missing"), F.lit("the header lacks a column")).when(F.col("least").isNull(), F.lit("no rows")).when(F.col("bad"), F.lit("a number cannot be read")).when(F.col("least") == 0, F.lit("a band without points"))
    known = known.withColumn("reason", why)
    good = by_band.join(known.where("reason is null").select("template_id"), "template_id")
    place = (F.row_number().over(Window.partitionBy("template_id").orderBy("band")) - 1).alias("bidx")
    flat = [F.lit(None).cast("double").alias("dust"), *(F.lit(0.0).alias(c) for c in ("c0", "p1", "p2"))]
    return good.select("template_id", "band", place, on_circle(F.col("points"), n_phase).alias("gamma"), *flat), known.where("reason is not null").select("template_id", "reason")


def load_zip(spark: SparkSession, path: str, n_phase: int = 100, contains: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(templates, rejects) of the ``.txt`` members of ZIP archives, by name.

    ``contains`` takes the first member whose name holds it (none: ValueError); ``limit`` the first members.  Members
    that cannot be read are counted in ``rejects`` (``template_id, reason``) instead of failing the rest.
    """

    def members(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = sorted(n for n in z.namelist() if n.endswith(".txt"))
                    if contains is not None:
                        names = [n for n in names if contains in n][:1]
                    for n in names[:limit]:
                        text = z.read(n).decode("utf-8", "replace").splitlines()
                        yield pd.DataFrame({"template_id": n, "place": range(len(text)), "line": text}, columns=["template_id", "place", "line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "template_id string, place int, line string")
    good, bad = from_lines(lines, n_phase)
    if contains is not None and not good.take(1):
        raise ValueError(f"no member contains {contains!r}")
    return good, bad


def slopes(gamma: Column) -> Column:
    """``dgamma`` of a gamma array: circular central difference times half the number of phases."""
    n = F.size(gamma)
    at = lambda i: F.get(gamma, F.pmod(i, n))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (at(i + 1) - at(i - 1)) * (n / 2.0))


def interpolated(gamma: Column, phase: Column) -> Column:
    """Linear interpolation of a gamma array at a phase, on the circle."""
    n = F.size(gamma)
    x = F.pmod(phase, F.lit(1.0)) * n
    lo = F.pmod(F.floor(x).cast("int"), n)
    frac = x - F.floor(x)
    return (1 - frac) * F.get(gamma, lo) + frac * F.get(gamma, F.pmod(lo + 1, n))


def resampled(gamma: Column, n_out: int) -> Column:
    """A gamma array on n_out phases."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), lambda i: interpolated(gamma, i / F.lit(float(n_out))))


def aligned(templates: DataFrame, reference: str) -> DataFrame:
    """All bands of a template turned alike, so that the reference band has its (first) minimum at phase 0.  Adds ``shift``."""
    shift = templates.where(F.col("band") == reference).select("template_id", (F.array_position("gamma", F.array_min("gamma")) - 1).cast("int").alias("shift"))
    n = F.size("gamma")
    turned = F.concat(F.slice("gamma", F.col("shift") + 1, n), F.slice("gamma", F.lit(1), F.col("shift")))
    return templates.join(shift, "template_id").withColumn("gamma", turned)


def band_sets(templates: DataFrame) -> DataFrame:
    """``template_id, bands`` (sorted array)."""
    return templates.groupBy("template_id").agg(F.sort_array(F.collect_set("band")).alias("bands"))


def modal_bands(templates: DataFrame) -> DataFrame:
    """The most frequent band set, ``bands, n``; on ties the first by order."""
    return band_sets(templates).groupBy("bands").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bands").limit(1)


def averaged(templates: DataFrame, n_phase: int) -> DataFrame:
    """Mean gamma by band over the templates whose band set is that of the first one (by id), resampled to ``n_phase``."""
    own = band_sets(templates)
    first = own.agg(F.min_by("bands", "template_id").alias("bands"))
    same = templates.join(own.join(F.broadcast(first), "bands", "left_semi"), "template_id", "left_semi")  # one row
    point = same.withColumn("gamma", F.when(F.size("gamma") == n_phase, F.col("gamma")).otherwise(resampled(F.col("gamma"), n_phase))).select("band", F.posexplode("gamma").alias("i", "v"))
    mean = point.groupBy("band", "i").agg(F.avg("v").alias("v"))
    return mean.groupBy("band").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("gamma"))


def sharing(templates: DataFrame, bands: list[str], least: int = 2) -> DataFrame:
    """Templates that have at least ``least`` of these bands."""
    keep = band_sets(templates).where(F.size(F.array_intersect("bands", F.array(*map(F.lit, bands)))) >= least)
    return templates.join(keep, "template_id", "left_semi")


def unknown_bands(lc: DataFrame, template: Template) -> DataFrame:
    """``object_id, bands``: observed bands that the template lacks."""
    seen = lc.groupBy("object_id").agg(F.sort_array(F.collect_set("band")).alias("seen"))
    return seen.withColumn("bands", F.array_except("seen", F.array(*map(F.lit, template.bands)))).where(F.size("bands") > 0).select("object_id", "bands")


def synthetic(name: str, bands: tuple[str, ...], n_phase: int, skew: float, dusty: bool = True) -> Template:
    """A smooth saw-like template from a rule; ``skew`` moves power to the second harmonic, later bands are flatter."""
    x = np.arange(n_phase) / n_phase
    gamma = np.array([[round((1 - 0.15 * b) * (0.5 * math.cos(2 * math.pi * p) + skew * math.sin(4 * math.pi * p + 0.3 * b)), 6) for p in x] for b in range(len(bands))])
    dust = np.array([round(3.3 - 0.7 * b, 3) for b in range(len(bands))]) if dusty else None
    betas = np.array([[round(0.6 - 0.1 * b, 3), round(-1.2 - 0.2 * b, 3), round(0.4 + 0.1 * b, 3)] for b in range(len(bands))]) if dusty else None
    return Template(name, bands, gamma, dust, betas)
