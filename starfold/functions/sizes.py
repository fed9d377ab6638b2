"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 20_000  # a template library, a subset of it, or coefficients by band have far fewer


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most so many rows; beyond that as it is, for Spark to choose the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
