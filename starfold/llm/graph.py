"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


SALTS = 64  # parts into which the rows of one node are dealt


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v, m``: every edge with the least v of its u.

    The rows of a node are dealt by v into parts; parts tell each other their least, so no task holds all rows of a hub.
    """
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = dealt.groupBy("u", "s").agg(F.min("v").alias("m"))
    told = parts.select("u", "s").join(parts.groupBy("u").agg(F.min("m").alias("m")), "u")
    return dealt.join(told, ["u", "s"]).drop("s")


def _state(edges: DataFrame):
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: every node of the edge table ``u, v`` but the least of each component, with that least node.

    Each round points the larger neighbours of every node, then the smaller ones, at the least; the rounds end when the
    table stays as it is, after about log n of them.  Each round is written to the shared folder.  Null ends and loops
    are left out; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    now, path = shared.written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the larger neighbours of u go to the least of u and its neighbours
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # of the smaller neighbours that u has now, all others go to the least, and so does u
        held = _with_least(large)
        small = held.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after, new_path = shared.written(small, "edges")
        shared.remove(spark, path)
        now, path, state = after, new_path, _state(after)
        if state == seen:
            break
        seen = state
    return now
