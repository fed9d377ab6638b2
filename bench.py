"""Times headline queries and prints one JSON line.

Besides the queries over the given tables, ``search_default_grid`` searches injected stars of about 370 rows in five bands
over 693 days, on the default grid of 173,150 trial periods: the size for which a time per star is published.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = [
    "variability_features", "color_cut", "lomb_scargle", "lafler_kinman", "psi_multiband", "best_period", "top_periods",
    "period_search", "rss_phase_grid", "template_predict", "template_fit_rr", "two_stage", "candidate_job", "pairwise_l2",
]
STARS, PERIOD, SPAN = 16, 0.5016, 693.0


def injected(spark: SparkSession):
    """Noisy sinusoids of one period at seeded random times."""
    rows = spark.range(STARS * 5 * 74).select(
        (F.col("id") % STARS).alias("object_id"), F.col("id").alias("row_id"),
        (F.rand(1) * SPAN).alias("t"), F.element_at(F.array(*map(F.lit, "ugriz")), (F.col("id") % 5 + 1).cast("int")).alias("band"),
    )
    wave = 14 + 0.5 * F.sin(2 * F.pi() * F.col("t") / PERIOD)
    return rows.select("*", (wave + 0.02 * F.randn(2)).alias("mag"), F.lit(0.02).alias("magerr"))


def main() -> None:
    from starfold.plans.pipelines import period_search
    from starfold.plans.registry import QUERIES

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["time_span"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    began = time.time()
    found = period_search(injected(spark), 0.2, 0.02, n=1).collect()
    took["search_default_grid"] = round(time.time() - began, 3)
    right = sum(abs(r["period"] - PERIOD) < 0.001 for r in found)
    stars = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    print(
        json.dumps(
            {
                "metric": "light-curve headline queries, total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf.rstrip("/")),
                "stars": stars,
                "default_grid": {"stars": STARS, "right": right, "core_sec_per_star": round(took["search_default_grid"] * int(cpus) / STARS, 3)},
            }
        )
    )


if __name__ == "__main__":
    main()
