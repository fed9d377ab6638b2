"""Document fingerprints with DataFrame functions alone: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range (and, where none is, the smallest hash of the
text, so that no text with words goes without).  Sketches of parts merge by set union, and |A & B| / min(|A|, |B|)
estimates containment between documents of very unequal length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

WORDS = 5
FRACTION = 4  # one hash in so many is kept
LIMIT = -(1 << 63) + (1 << 64) // FRACTION
NO_ID = -(1 << 63)  # stands for a null doc_id where ids are compared


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the sorted sketch (array<long>) of column ``text``; no words: empty.  Texts under five words are one shingle."""
    hashed, shingled = f"_{out}_words", f"_{out}_shingles"
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    df = df.withColumn(hashed, F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(hashed)
    run = lambda x, i: F.xxhash64(x, *(F.get(F.col(hashed), i + k) for k in range(1, WORDS)))
    df = df.withColumn(shingled, F.transform(F.when(n <= WORDS, F.slice(hashed, 1, 1)).otherwise(F.slice(hashed, F.lit(1), F.greatest(n - WORDS + 1, F.lit(1)))), run))
    low = F.filter(shingled, lambda h: h < LIMIT)
    kept = F.when(F.exists(shingled, lambda h: h < LIMIT), F.array_sort(F.array_distinct(low))).when(n > 0, F.array(F.array_min(shingled))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, kept).drop(hashed, shingled)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, equal to that of their union: a least hash that stood in for none goes once there is one below the limit."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: h < LIMIT)
    return F.when(F.size(low) > 0, F.array_sort(low)).otherwise(F.slice(F.array_sort(both), 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger; two empty ones are alike, an empty and another not."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def said(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.hex(h)), " ")


def with_next(docs: DataFrame, columns: list[str], prepare) -> DataFrame:
    """``prepare(docs)`` with, for each of the columns, ``next_<column>`` of the row after it by (doc_id, text); after the last comes the first.

    Rows are dealt into ranges of doc_id by approximate quantiles and sorted there, so no task holds all rows.  A copy of each
    range's first row is put at the end of the range before it, so texts only move with their range; to the driver come the
    least id of each range alone.  Null ids come first; equal rows stand side by side; an empty table gives none.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    range_, extra = "_starfold_range", "_starfold_copy"
    doc_id = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    bounds = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = sorted(set(bounds)) if n > 1 else []
    if len(bounds) <= 16:
        at = sum((F.when(doc_id > b, 1).otherwise(0) for b in bounds), F.lit(0))
    else:
        at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < doc_id))
    ranged = docs.withColumn(range_, at)
    heads = dict(ranged.groupBy(range_).agg(F.min(doc_id)).collect())
    order = [F.asc_nulls_first("doc_id"), F.asc("text")]
    if not heads:
        firsts = ranged.where("false")
    else:
        held = sorted(heads)
        head = F.element_at(F.create_map(*(F.lit(x) for k in held for x in (k, heads[k]))), F.col(range_))
        before = F.element_at(F.create_map(*(F.lit(x) for k, to in zip(held, [held[-1], *held[:-1]], strict=True) for x in (k, to))), F.col(range_))
        firsts = ranged.where(doc_id == head).withColumn(extra, F.row_number().over(Window.partitionBy(range_).orderBy(*order))).where(F.col(extra) == 1)
        firsts = firsts.drop(extra).withColumn(range_, before)
    rows = ranged.withColumn(extra, F.lit(False)).unionByName(firsts.withColumn(extra, F.lit(True)))
    after = F.lead(F.struct(*columns)).over(Window.partitionBy(range_).orderBy(extra, *order))
    rows = prepare(rows).withColumn("_starfold_next", after).where(~F.col(extra))
    return rows.select("*", *(F.col(f"_starfold_next.{c}").alias(f"next_{c}") for c in columns)).drop(range_, extra, "_starfold_next")


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; null and empty texts have the empty fingerprint, equal texts equal ones."""
    return with_sketch(shared.id_text(docs), "text", "sketch").select("doc_id", said(F.col("sketch")).alias("fingerprint"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(shared.id_text(shared.documents(spark, sf_dir)), ["text", "sketch"], lambda df: with_sketch(df, "text", "sketch"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))).drop("next_text", "text")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), said(F.col("sketch")).alias("fingerprint"), said(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
