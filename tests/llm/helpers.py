"""Odd tables that every operator must take, and brute-force counterparts."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, block int, sig string, bucket int, score double, kept string, n_bytes long, label string"


def table(spark, rows):
    """Documents with extra columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, "y", 2, 0.5, "k", 3, None) for i, t in rows], SCHEMA)


def prose(n, seed=0, words=("alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa", "zeta", "eta")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(100)) for _ in range(n))


LONG = "".join(f"w{i * 7919 % 100003} " for i in range(20000))


def odd(spark):
    """Null and repeated ids, null, empty, wordless, very long, non-Latin and repeated texts."""
    base = prose(60, 1)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "   \n\t "), (None, base), (None, None), (6, LONG), (7, LONG + " tail"), (8, "Привет, мир! 漢字かな é́ 🙂\u0000 "), (9, "a"), (10, "no " * 300), (1 << 60, prose(30, 2)), (-5, prose(30, 2)), (11, "<|endoftext|> x")]
    return table(spark, rows)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
