"""Licence scans with DataFrame functions alone: Dice coefficient over word bigrams, by line, whole text and word window.

Text is normalised to lower-case words; each line, the whole text, and each window of consecutive words, lines ignored,
is a unit.  Of the windows only those that begin and end with a bigram of the template are looked at, as any other gains
when its ends are cut off; so a notice is found where it is wrapped over lines or shares its line with other words.  A
unit is compared to a template only
if their numbers of bigrams allow the threshold (|A| and |B| within a factor of t / (2 - t)), and a document at all only
if it has one of the bigrams that every match must share: with t the threshold, a unit that leaves out a set of bigrams
of the template larger than |B| (1 - t / (2 - t)) cannot reach it, so each template needs only so many probe bigrams.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

THRESHOLD = 0.8

# Notices by licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def probes(threshold: float = THRESHOLD) -> list[str]:
    """Bigrams of which every unit that matches some template has at least one."""
    out = set()
    for _, text in TEMPLATES:
        own = bigrams(text)
        need = len(own) - math.ceil(len(own) * threshold / (2 - threshold) - 1e-9) + 1
        out |= set(sorted(own, key=lambda b: (-len(b), b))[:need])
    return sorted(out)


def _dice(unit: Column, own: list[str]) -> Column:
    shared_ = F.size(F.array_intersect(unit, F.array(*map(F.lit, own))))
    return 2.0 * shared_ / (F.size(unit) + len(own))


def _grams(flat: Column) -> Column:
    """The bigrams of a text in order, repeated ones included."""
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    return F.filter(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())


def _known(grams: Column) -> Column:
    """(place, bigram) of the bigrams that some template has."""
    every = sorted({b for _, text in TEMPLATES for b in bigrams(text)})
    return F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda x: x["g"].isin(every))


def _windows(name: str, own: list[str], threshold: float) -> Column:
    """Of each place where a window that matches the template can begin, the closest window: ``d, i, j, name``, d minus its Dice."""
    low = threshold / (2 - threshold)
    least, most = math.ceil(low * len(own) - 1e-9), math.floor(len(own) / low + 1e-9)
    many = lambda x: F.size(F.array_distinct(F.transform(x, lambda y: y["g"])))

    def starts(at: Column) -> Column:
        every = F.transform(at, lambda x, k: F.filter(F.slice(at, k + 1, most), lambda y: y["i"] < x["i"] + most))
        return F.filter(every, lambda ends: many(ends) >= least)  # a match shares so many, however long it is

    def closest(ends: Column) -> Column:
        i = ends[0]["i"]

        def window(y: Column, k: Column) -> Column:
            total = F.size(F.array_distinct(F.slice(F.col("grams"), i + 1, y["i"] - i + 1)))
            dice = 2.0 * many(F.slice(ends, 1, k + 1)) / (total + len(own))
            return F.when(k + 1 >= least, F.struct((-dice).alias("d"), i.alias("i"), y["i"].alias("j"), F.lit(name).alias("name")))

        return F.array_min(F.filter(F.transform(ends, window), lambda w: w.isNotNull()))

    shared_ = F.filter(F.col("known"), lambda x: x["g"].isin(own))
    found = F.flatten(F.transform(F.array(shared_), lambda at: F.when(F.size(at) >= least, starts(at)).otherwise(F.slice(F.array(at), 2, 1))))
    return F.filter(F.transform(found, closest), lambda w: w["d"] <= -threshold + 1e-12)


def _apart(windows: Column) -> Column:
    """The number of windows that stay, the closest first, if those that overlap a better one go."""
    met = lambda kept, w: F.exists(kept, lambda k: (k["i"] <= w["j"]) & (w["i"] <= k["j"]))
    return F.size(F.aggregate(windows, F.slice(windows, 1, 0), lambda kept, w: F.when(met(kept, w), kept).otherwise(F.concat(kept, F.array(w)))))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, n_notices, licenses, best_license, best_dice, n_places``.

    ``n_notices`` counts lines that match a template or hold a window that does, ``licenses`` lists the licences of lines,
    whole text and windows, sorted and joined by commas; a notice wrapped over lines is in ``licenses`` and in ``n_places``,
    the number of windows apart from each other, but no line holds it; ``best_*`` is the closest (ties: the first name), null and 0 where nothing matches.  Null and empty
    texts match nothing; repeated rows are scanned each for itself; other columns fall away.  A narrow plan.
    """
    low = threshold / (2 - threshold)
    norm = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    hit = F.concat(F.lit(" "), F.translate("norm", "\n", " "), F.lit(" ")).rlike(f" ({'|'.join(probes(threshold))}) ")
    # line ends may stand between the words of a probe in the whole text, so runs of blanks count as one
    rows = shared.id_text(docs).withColumn("norm", norm)
    rows = rows.withColumn("flat", F.regexp_replace("norm", r"\s+", " ")).withColumn("hit", F.concat(F.lit(" "), "flat", F.lit(" ")).rlike(f" ({'|'.join(probes(threshold))}) ") | hit)

    def pairs(text: Column) -> Column:
        words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
        return F.array_distinct(F.transform(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b")), lambda p: p["b"].isNotNull()), lambda p: F.concat(p["a"], F.lit(" "), p["b"])))

    def matches(unit: Column) -> Column:
        found = []
        for name, text in TEMPLATES:
            own = bigrams(text)
            fits = F.size(unit).between(math.ceil(low * len(own) - 1e-9), math.floor(len(own) / low + 1e-9))
            found.append(F.when(fits, F.struct((-_dice(unit, own)).alias("d"), F.lit(name).alias("name"))))
        return F.filter(F.array(*found), lambda m: m.isNotNull() & (m["d"] <= -threshold + 1e-12))

    rows = rows.select("doc_id", *(F.when(F.col("hit"), F.col(c)).alias(c) for c in ("norm", "flat")))  # null elsewhere: nothing below is computed
    rows = rows.withColumn("grams", _grams(F.col("flat"))).withColumn("known", _known(F.col("grams")))
    rows = rows.withColumn("windows", F.array_sort(F.flatten(F.array(*(_windows(name, bigrams(text), threshold) for name, text in TEMPLATES)))))
    rows = rows.withColumn("lines", F.transform(F.split("norm", "\n"), pairs)).withColumn("whole", pairs(F.col("flat")))
    rows = rows.withColumn("lines", F.transform("lines", matches)).withColumn("whole", matches(F.col("whole")))
    sizes = F.transform(F.split("norm", "\n"), lambda line: F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))
    rows = rows.withColumn("ends", F.when(F.size("windows") > 0, ends))  # of lines, in words

    def holds(m: Column, k: Column) -> Column:
        within = lambda w: (F.get("ends", k) <= w["i"]) & (w["j"] + 1 < F.get("ends", k + 1))
        return (F.size(m) > 0) | F.coalesce(F.exists("windows", within) & F.col("ends").isNotNull(), F.lit(False))

    held = F.size(F.filter(F.transform("lines", holds), lambda x: x))
    found = F.transform("windows", lambda w: F.struct(w["d"].alias("d"), w["name"].alias("name")))
    rows = rows.select("doc_id", F.coalesce(held, F.lit(0)).cast("long").alias("n_notices"), F.coalesce(_apart(F.col("windows")), F.lit(0)).cast("long").alias("n_places"), F.array_sort(F.concat(F.flatten("lines"), "whole", found)).alias("all"))
    best = F.get("all", F.lit(0))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda m: m["name"]))), ",")
    return rows.select("doc_id", F.greatest("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce(names, F.lit("")).alias("licenses"), best["name"].alias("best_license"), F.coalesce(-best["d"], F.lit(0.0)).alias("best_dice"), F.greatest("n_places", F.lit(0)).cast("long").alias("n_places"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.documents(spark, sf_dir)).withColumn("best_dice", F.round("best_dice", 6)).drop("n_places")


def _oracle() -> str:
    said = ", ".join("('{}', {})".format(n, "[" + ", ".join(f"'{b}'" for b in bigrams(t)) + "]") for n, t in TEMPLATES)
    return rf"""
WITH template(name, own) AS (VALUES {said}),
norm AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS norm FROM documents),
unit AS (SELECT r, 1 AS line, unnest(string_split(norm, chr(10))) AS u FROM norm UNION ALL SELECT r, 0, regexp_replace(norm, '\s+', ' ', 'g') FROM norm),
numbered AS (SELECT row_number() OVER () AS k, r, line, list_filter(string_split_regex(u, '\s+'), lambda w: w <> '') AS w FROM unit),
pairs AS (SELECT k, r, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM numbered),
hits AS (SELECT k, r, line, name, 2.0 * len(list_intersect(b, own)) / (len(b) + len(own)) AS d FROM pairs, template WHERE 2.0 * len(list_intersect(b, own)) / (len(b) + len(own)) >= {THRESHOLD}),
best AS (SELECT r, count(DISTINCT CASE WHEN line = 1 THEN k END) AS n_notices, array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses, arg_min(name, (-d, name)) AS best_license, max(d) AS best_dice FROM hits GROUP BY r)
SELECT doc_id, coalesce(n_notices, 0) AS n_notices, coalesce(licenses, '') AS licenses, best_license, round(coalesce(best_dice, 0.0)::DOUBLE, 6) AS best_dice FROM norm LEFT JOIN best USING (r)"""


ORACLE_SQL = _oracle()
