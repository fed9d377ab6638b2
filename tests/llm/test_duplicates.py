import collections
import hashlib
import random
import re

import numpy as np
import pytest

from starfold.llm import fingerprints, graph, jaccard_join, licenses, shingles, suffix_dedup, suffixes

from .helpers import LONG, empty, odd, prose, table


def kept_by_brute_force(rows):
    """(removed mask by row) for (doc_id, text) rows in the order that the operator defines."""
    seen, out = set(), {}
    for k, (i, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        out[k] = (i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def removed(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicated(df).collect()), key=str)


def repeating(seed=0, n=40):
    rng = np.random.default_rng(seed)
    line = prose(9, 99)[:70]
    passage = prose(40, 98)
    rows = []
    for i in range(n):
        t = prose(int(rng.integers(0, 60)), int(rng.integers(1, 25)))
        if i % 3 == 0:
            t = t[: len(t) // 2] + line + t[len(t) // 2 :]
        if i % 4 == 0:
            t += passage[int(rng.integers(0, 60)) :]
        if i % 9 == 0:
            t += "ab" * int(rng.integers(1, 200))
        rows.append((int(rng.integers(0, 1000)) * 50 + i, t + ("é" if i % 5 else "")))
    return rows


@pytest.mark.parametrize("spread", [20_000, 0])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(suffix_dedup, "SPREAD", spread)  # 0: every k-gram with three contexts in a block is settled there
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 2000)
    for seed in (1, 2):
        rows = repeating(seed)
        assert removed(table(spark, rows)) == kept_by_brute_force(rows)


def test_suffix_dedup_of_odd_rows(spark):
    docs = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert removed(docs) == kept_by_brute_force(rows)
    assert removed(empty(spark)) == []
    cut = suffix_dedup.cut_texts(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert {r["th"] for r in cut.collect()} == {"x"}


def test_anchors_cover_every_window():
    rng = np.random.default_rng(0)
    for data, ends in ((rng.integers(97, 100, 3000).astype(np.uint8), [50, 149, 150, 400, 3000]), (np.full(500, 97, np.uint8), [500]), (np.frombuffer(LONG.encode(), np.uint8), [len(LONG)])):
        ends = np.array(ends)
        place, first, last, h = suffixes.anchors(data, ends)
        starts = [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)]
        begin = np.concatenate([[0], ends[:-1]])
        assert starts == [s for a, e in zip(begin, ends, strict=True) for s in range(a, e - 99)]
        assert ((place - last >= 0) & (place - first < suffixes.SPAN)).all() and len(h) == len(place)


def test_multikey_sorts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 4, (300, 5)).astype(np.uint64)
    order, run = suffixes.multikey(300, [lambda r, j=j: keys[r, j] for j in range(5)])
    rows = [tuple(keys[i]) for i in order]
    assert rows == sorted(map(tuple, keys)) and all(rows[i] == rows[r] and (r == 0 or rows[r - 1] != rows[r]) for i, r in enumerate(run))


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\t-\r \0]+", (t or "").lower())  # ASCII white space alone parts words
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def classes_by_brute_force(rows):
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets = word_sets(texts)
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.Counter()
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    ids = collections.defaultdict(list)
    copies = collections.Counter(t or "" for _, t in rows)
    for i, t in rows:
        ids[root(texts.index(t or ""))].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, least[root(texts.index(t or ""))], links[texts.index(t or "")], copies[t or ""]) for i, t in rows), key=str)


def near_copies(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        base = prose(80, 1000 + g).split()
        for k in range(int(rng.integers(1, 7))):
            w = list(base)
            for _ in range(k):
                w[int(rng.integers(len(w)))] = f"new{rng.integers(1000)}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    hot = prose(100, 5).split()
    for k in range(40):  # one large group
        w = list(hot)
        w[k], w[50 + k] = f"x{k}", f"y{k}"
        rows.append((len(rows) * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # 8: large groups meet in pairs of blocks
    rows = near_copies()
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.classes(table(spark, rows)).collect()), key=str)
    assert got == classes_by_brute_force(rows)


def test_join_of_odd_rows(spark):
    docs = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.classes(docs).collect()), key=str)
    assert got == classes_by_brute_force(rows)
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len({c for _, c, _, _ in got})
    assert jaccard_join.classes(empty(spark)).count() == 0 and jaccard_join.one_of_each(empty(spark)).count() == 0


def test_pruning_table():
    table_ = jaccard_join.least_matches()
    assert [n for n, _ in table_] == [25, 50, 75, 100, 125] and all(m < 0.8 * n for n, m in table_)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (200, jaccard_join.SIZE), np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + np.uint32(1))
    assert jaccard_join.survivors(a, b).all()
    c = np.where(rng.random(a.shape) < 0.4, a, a + np.uint32(1))
    assert not jaccard_join.survivors(a, c).any()


def test_shingles():
    h, n = shingles.shingles(["a b c d e f", "A  b\nc d e", None, "", "x y", "b c d e f", " "])
    assert n.tolist() == [2, 1, 0, 0, 1, 1, 0] and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 7), (20, 20)] + [(k + 101, k + 100) for k in range(30)]
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {5: 1, 4: 1, 3: 1, 2: 1, 9: 7, 8: 7} | {101 + k: 100 for k in range(30)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_hubs(spark):
    """Hubs with more neighbours than the parts a node is dealt into, the least node among a hub's neighbours, and hubs linked by a leaf."""
    rng = np.random.default_rng(4)
    edges = [(500, int(k)) for k in rng.permutation(1000)[:300]] + [(int(k), 2000) for k in range(2001, 2400)] + [(int(k), 5000) for k in range(4000, 4200)]
    edges += [(4100, 2300), *map(tuple, rng.integers(6000, 6400, (250, 2)).tolist())]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in list(parent) if root(x) != x}
    rows = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["u"]: r["v"] for r in rows} == want and len(rows) == len(want)


def test_fingerprints(spark):
    base = prose(400, 3)
    rows = [(3, base), (1, base), (2, base + " " + prose(400, 4)), (4, prose(300, 5)), (5, ""), (6, None), (7, "two words")]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(table(spark, rows)).collect()}
    assert got[1] == got[3] and got[5] == got[6] == "" and got[7]
    a, b = set(got[1].split()), set(got[2].split())
    assert len(a & b) >= 0.95 * len(a) and not a & set(got[4].split())
    assert abs(len(a) / 396 - 1 / fingerprints.FRACTION) < 0.08
    docs = odd(spark)
    assert fingerprints.fingerprint(docs).count() == docs.count() and fingerprints.fingerprint(empty(spark)).count() == 0


def sketch_by_brute_force(spark, text):
    """The shingle hashes below the limit, or the least one: words hashed by xxhash64, five at a time."""
    from pyspark.sql import functions as F

    words = re.findall(r"[^\t-\r ]+", text.lower())
    if not words:
        return set()
    one = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string").orderBy("i").select(F.xxhash64("w")).collect()]
    runs = [one[i : i + 5] for i in range(max(1, len(one) - 4))]
    frame = spark.createDataFrame([tuple(r + [None] * (5 - len(r))) for r in runs], "a long, b long, c long, d long, e long")
    hashes = {r[0] for r in frame.select(F.xxhash64("a", "b", "c", "d", "e")).collect()}
    return {h for h in hashes if h < fingerprints.LIMIT} or {min(hashes)}


def containment(a, b):
    least = min(len(a), len(b))
    return len(a & b) / least if least else float(len(a) == len(b))


def test_fingerprint_query_against_brute_force(spark, tmp_path):
    base = prose(80, 7)
    rows = [(1, base), (2, base + " " + prose(40, 8)), (3, "a b c"), (4, "a b c"), (5, None), (6, prose(30, 9)), (7, base)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()}
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, nxt = texts[k], texts[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, cut, after = (sketch_by_brute_force(spark, x) for x in (t, edited, nxt))
        hexed = lambda s: " ".join(f"{h & (2**64 - 1):X}" for h in sorted(s))
        assert got[i]["fingerprint"] == hexed(own) and got[i]["edited_fingerprint"] == hexed(cut)
        assert got[i]["near_edited"] == pytest.approx(containment(own, cut)) and got[i]["near_next"] == pytest.approx(containment(own, after))


def test_merged_sketches_are_those_of_the_union(spark):
    from pyspark.sql import functions as F

    for a, b in ((prose(60, 1), prose(70, 2)), ("x y", "z"), ("x y", prose(60, 3)), ("", "q"), ("x y", "x y")):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "sa"), "b", "sb")
        got = df.select(fingerprints.merged(F.col("sa"), F.col("sb"))).first()[0]
        p, q = sketch_by_brute_force(spark, a), sketch_by_brute_force(spark, b)
        low = {h for h in p | q if h < fingerprints.LIMIT}
        assert got == sorted(low or ({min(p | q)} if p | q else set()))


def test_queries_over_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    one = suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in one), key=str) == kept_by_brute_force(rows)
    four = jaccard_join.op4_ngram_join(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in four), key=str) == classes_by_brute_force(rows)
    assert fingerprints.op2_fingerprints(spark, str(tmp_path)).count() == len(rows)


def test_fingerprint_query_edits(spark, tmp_path):
    rows = [(10, "abcdefg"), (3, None), (7, "héllo wörld 🙂x"), (12, ""), (40, prose(200, 1)), (41, prose(200, 1))]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 2
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
    assert got[40]["near_next"] == 1.0 and 0.3 < got[40]["near_edited"] <= 1 and got[10]["near_next"] == 0.0
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprints.op2_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_licenses(spark):
    rows = [(1, f"{prose(30)}\nReleased under the MIT License.\nmore"), (2, "licensed under the apache license version 2.0"), (3, "This work was licensed under the GNU General Public License, version 3"), (4, prose(50)), (5, None), (6, "the MIT license is one of many licenses that people talk about"), (7, "Released under\nthe MIT License.")]
    got = {r["doc_id"]: (r["licenses"], r["n_notices"]) for r in licenses.scan(table(spark, rows)).collect()}
    assert got == {1: ("MIT", 1), 2: ("Apache-2.0", 1), 3: ("GPL-3.0", 1), 4: ("", 0), 5: ("", 0), 6: ("", 0), 7: ("MIT", 0)}
    docs = odd(spark)
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty(spark)).count() == 0


def test_probes_lose_no_match():
    """Every set of bigrams of a template that can reach the threshold has a probe."""
    probes = set(licenses.probes())
    for _, text in licenses.TEMPLATES:
        own = set(licenses.bigrams(text))
        least = -(-len(own) * 2 // 3)  # |A & B| >= |B| t / (2 - t) with t = 0.8
        assert len(own - probes) < least


MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os"""


def test_licenses_wrapped_or_within_a_line(spark):
    shared_line = "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0. Docs: Licensed under CC BY-NC 4.0. All rights reserved and more"
    rows = [(1, MIT), (2, GPL), (3, shared_line), (4, "under the terms of it " * 300), (5, "Released under the MIT License.\n" * 2)]
    got = {r["doc_id"]: (r["licenses"], r["n_notices"], r["n_places"]) for r in licenses.scan(table(spark, rows)).collect()}
    assert got == {1: ("MIT", 0, 1), 2: ("GPL-3.0", 0, 1), 3: ("Apache-2.0,CC-BY-NC-4.0", 1, 2), 4: ("", 0, 0), 5: ("MIT", 2, 2)}


def test_license_windows_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        words = [w for _ in range(3) for w in (*prose(rng.randrange(6), rng.random()).split(), *rng.choice(licenses.TEMPLATES)[1].split())]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = "other"
        rows.append((k, " ".join(words)))
    got = {r["doc_id"]: (r["licenses"], round(r["best_dice"], 9)) for r in licenses.scan(table(spark, rows)).collect()}
    for k, text in rows:
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        units = [set(grams), *({*grams[i:j]} for i in range(len(grams)) for j in range(i + 1, min(len(grams), i + 62) + 1))]
        best = {}
        for name, t in licenses.TEMPLATES:
            own = set(licenses.bigrams(t))
            top = max(2 * len(u & own) / (len(u) + len(own)) for u in units)
            best[name] = max(best.get(name, 0), top)
        names = sorted(n for n, d in best.items() if d >= 0.8 - 1e-12)
        assert got[k] == (",".join(names), round(max(best[n] for n in names), 9) if names else 0.0)


def test_near_copies_with_null_ids_are_linked(spark):
    base = prose(80, 5)
    docs = table(spark, [(None, base), (None, base + " one"), (7, base + " two"), (8, prose(80, 6))])
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.classes(docs).collect()]
    assert len(got) == 4 and set(got) == {(8, 8, 0), (7, 7, 2), (None, 7, 2)}
    assert {r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()} == {7, 8}
