import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.llm import language, neighbours, toxicity

from .helpers import empty, odd, table

SYLLABLES = {"en": ["the", "ing", "and", "ou", "sh", "th"], "de": ["der", "sch", "und", "ein", "ß", "ung"], "ru": ["при", "вет", "мир", "она", "что"]}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=90):
    langs = list(SYLLABLES)
    return spark.createDataFrame([(i, text(langs[i % 3], 40, i), langs[i % 3]) for i in range(n)] + [(n, None, "en"), (n + 1, "x", None)], "doc_id long, text string, lang string")


def test_language(spark):
    docs = corpus(spark)
    model = language.fit(docs)
    assert model.languages == ["de", "en", "ru"]
    got = language.predict(docs, model).join(docs, "doc_id").where("text is not null and lang is not null").collect()
    assert all(r["lang_pred"] == r["lang"] and 0.9 < r["score"] <= 1 for r in got)
    mixed = text("en", 20, "m") + " " + text("de", 20, "n")
    lang, score, spans = language.label(model, [mixed, None, "", "12 !?", text("ru", 5, 1)], True)
    assert lang[1:] == ["und", "und", "und", "ru"] and score[1] == 0.0 and 0 <= score[0] <= 1
    assert [s["lang"] for s in spans[0]] == ["en", "de"] and abs(spans[0][1]["start"] - len(text("en", 20, "m")) - 1) < 12
    assert spans[0][0]["start"] == 0 and spans[0][1]["end"] == len(mixed)


def test_more_than_64_languages_are_learned(spark):
    rng = random.Random(8)
    own = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(70)}
    docs = spark.createDataFrame([(100 * k + i, " ".join(rng.choice(words) for _ in range(30)), lang) for k, (lang, words) in enumerate(own.items()) for i in range(8)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == sorted(own)
    assert language.label(model, [" ".join(words) for words in own.values()])[0] == list(own)


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    model = language.fit(corpus(spark))
    assert language.predict(docs, model).count() == docs.count() and language.predict(empty(spark), model).count() == 0
    none = language.fit(empty(spark))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    counts = np.array([5, 0, 1, 7])
    scores = rng.normal(size=(13, 3)).astype(np.float32)
    path = language.viterbi(scores, counts, 1.0)
    at = 0
    for n in counts:
        if n:
            s = scores[at : at + n].astype(float)
            value = lambda p, s=s: sum(s[i, p[i]] for i in range(len(p))) - sum(p[i] != p[i - 1] for i in range(1, len(p)))
            best = max(value(p) for p in np.ndindex(*(3,) * int(n)))
            assert value(path[at : at + n]) == pytest.approx(best, abs=1e-4)
        at += n


INSULTS = ["grobnik", "flarbot", "snizzle"]


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = text("en", 40, i).split()
        toxic = i % 4 == 0
        if toxic:
            for k in range(3):
                words[rng.randrange(40)] = rng.choice(INSULTS)
        rows.append((" ".join(words) + ".", int(toxic)))
    return rows


def test_toxicity_learns_and_tolerates_gaps():
    rows = labelled()
    model = toxicity.learn(rows[:300])
    held = toxicity.score(model, [t for t, _ in rows[300:]])
    truth = np.array([y for _, y in rows[300:]])
    assert held[truth == 1].min() >= 0.7 > held[truth == 0].max()
    clean = text("en", 30, "c")
    for bad in ("g r o b n i k and f.l.a.r.b.o.t", "grobbnik then flarxbot", "GROB-NIK flar*bot snizzle"):
        assert toxicity.score(model, [f"{clean} {bad} {clean}"])[0] > 0.5
    assert toxicity.score(model, [clean, "", None]).max() < 0.1


def test_toxicity_learns_many_rare_insults():
    """160 insults, none in more than three training texts."""
    rng = random.Random(4)
    some = ["grob", "flar", "snizz", "zomp", "krux", "wugg", "blif", "vok"]
    insults = sorted({a + b for a in some for b in some} | {a + b + c for a, b, c in zip(some * 16, some[3:] * 30, some[5:] * 50, strict=False)})[:160]
    use = [w for w in insults for _ in range(3)]
    rng.shuffle(use)
    rows = [(text("en", 30, f"r{i}"), 0) for i in range(500)]
    for i in range(0, len(use), 2):
        rows.append((f"{text('en', 15, f's{i}')} {use[i]} {text('en', 10, f't{i}')} {use[i + 1]}.", 1))
    model = toxicity.learn(rows)
    bad = toxicity.score(model, [f"{text('en', 20, f'u{i}')} {w} {insults[i - 9]}" for i, w in enumerate(insults)])
    good = toxicity.score(model, [text("en", 30, f"v{i}") for i in range(160)])
    assert (bad >= 0.7).mean() > 0.95 and (good >= 0.7).mean() < 0.05


def test_toxicity_within_long_runs():
    model = toxicity.learn(labelled())
    words = [w for w in text("en", 60, "q").split() if len(w) > 2]
    clean, run = ",".join(words), "".join(words[:40])
    for at in range(50, 70):
        insults = "".join(w + run[i : i + 9] for w, i in zip(INSULTS, (3, 14, 25), strict=True))
        assert toxicity.score(model, [run[:at] + insults + run[at:]])[0] >= 0.7
    bad = [",".join([*words[:20], *INSULTS, *words[20:]]), "/".join([*words[:3], *INSULTS])]
    assert toxicity.score(model, bad).min() >= 0.7 > toxicity.score(model, [clean, run]).max()


def test_windows_are_scored_as_words():
    rng = np.random.default_rng(5)
    table = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    run = "".join(chr(97 + c) for c in rng.integers(0, 26, 40))
    value, owner = toxicity.windows_of(*toxicity.words_of(["a b", f"x {run} y"])[:3], table)
    all_ = [max(float(toxicity.kernel_sum([run[i : i + k]], table)[0]) for k in toxicity.WINDOWS if i + k <= 40) for i in range(39)]
    want = [v for i, v in enumerate(all_) if v == max(all_[max(0, i - toxicity.APART) : i + toxicity.APART + 1])]
    assert set(owner.tolist()) == {1} and value.tolist() == pytest.approx(want, abs=1e-4)


def kernel_by_brute_force(a, b):
    """Sums over common subsequences of three and four symbols, bounds included, each occurrence weighted by its stretch."""

    def counts(word):
        out = {}
        x = f"<{word}<"
        for n in (3, 4):
            for at in itertools.combinations(range(len(x)), n):
                if at[-1] - at[0] <= toxicity.STRETCH:
                    key = "".join(x[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] - 1)
        occurrences = sum(toxicity.DECAY ** (2 * (at[-1] - at[0] - 1)) for n in (3, 4) for at in itertools.combinations(range(len(x)), n) if at[-1] - at[0] <= toxicity.STRETCH)
        return out, occurrences**0.5

    (p, n), (q, m) = counts(a), counts(b)
    return sum(v * q.get(k, 0) for k, v in p.items()) / (n * m)


def test_kernel_against_brute_force():
    rng = random.Random(6)
    words = ["idiot", "idxiot", "table", "a", "tabletop", "x" * 30, *("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 16))) for _ in range(30))]
    k = toxicity.kernel(words, words)
    want = np.array([[kernel_by_brute_force(a, b) for b in words] for a in words])
    assert np.abs(k - want).max() < 0.05 and (np.abs(k - want) > 1e-4).mean() < 0.03  # subsequences that share a table row
    assert np.allclose(k, k.T, atol=1e-4) and np.linalg.eigvalsh(k.astype(float)).min() > -1e-3
    assert k[0, 1] > 0.4 > k[0, 2]


def test_long_words_are_compared_whole():
    rng = np.random.default_rng(1)
    word = "".join(chr(97 + c) for c in rng.integers(0, 26, 200))
    codes, bounds, text_, _ = toxicity.words_of([word, "c" * 65 + " i d i o t", ""])
    assert (np.diff(bounds) - 1).max() == 200 and text_.tolist() == [0, 1, 1]
    assert toxicity.kernel([word], [word])[0, 0] == pytest.approx(1, abs=0.3)  # some subsequences occur twice


def test_sentences():
    assert toxicity.sentences("Ab cd. Ef g.h\nxy, zz i d i o t! qq") == [("ab", "cd"), ("ef", "gh"), ("xy", "zz", "idiot"), ("qq",)]
    assert toxicity.sentences("a1 b2 c3 dd ee ff gg hh") == [("abc", "dd", "ee"), ("ff", "gg", "hh")] and toxicity.sentences("12 !") == []


def test_landmarks_explain_the_kernel():
    """The Nystroem map gives the kernel between landmarks back, and the machine's table the machine's margins."""
    words = ["idiot", "table", "chair", "moron", "grobnik"]
    marks = toxicity.Landmarks(words)
    x = marks.features([(w,) for w in words])
    assert np.allclose(x @ x.T, toxicity.kernel(words, words), atol=0.01)
    theta = np.arange(5.0) - 2
    some = [("idiot", "tables"), ("chair",), ("morxon", "xyz", "a")]
    whole = [toxicity.kernel_sum(list(s), marks.table(theta)).sum() for s in some]
    assert np.allclose(marks.features(some) @ theta, whole, atol=1e-3)
    assert set(toxicity.landmarks_of({w: 1.0 for w in words}, 3)) <= set(words)


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    sign = np.where(x[:, 0] - 2 * x[:, 3] > 0.5, 1.0, -1.0)
    w, bias = toxicity.machine(x, sign, np.ones(400))
    assert ((x @ w + bias > 0) == (sign > 0)).mean() > 0.98


def test_toxicity_query(spark, tmp_path):
    rows = labelled(300)
    table(spark, [*((i, t) for i, (t, _) in enumerate(rows)), (None, "x"), (900, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 302 and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    held = [(rows[r["doc_id"]][1], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] < 300]
    hit = sum(p for y, p in held if y)
    assert hit >= 0.9 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.02 * len(held)


def test_toxicity_of_odd_rows(spark):
    docs = table(spark, [(i, t) for i, (t, _) in enumerate(labelled(60))])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(labelled(60))] + [(1, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.predict(odd(spark), model).collect()
    assert len(got) == odd(spark).count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.predict(empty(spark), model).count() == 0
    flat = toxicity.fit(empty(spark), labels)
    assert toxicity.predict(odd(spark), flat).count() == odd(spark).count()


def test_language_query(spark, tmp_path):
    corpus(spark, 240).withColumn("source", F.lit("s")).unionByName(spark.createDataFrame([(None, text("de", 30, 5), "de", "s"), (7000, None, "de", "s")], "doc_id long, text string, lang string, source string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op9_language(spark, str(tmp_path)).collect()
    assert len(got) == 244 and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert all(r["lang_pred"] == list(SYLLABLES)[r["doc_id"] % 3] for r in held) and {r["lang_pred"] for r in got if r["doc_id"] == 7000} == {"und"}


def test_scripts_cut_words_and_name_strangers(spark):
    model = language.fit(corpus(spark))
    codes, _, starts, ends, *_ = language.words_of(["abcмир漢字かなabc " + "漢" * 10 + " " + "x" * 30])
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(starts, ends, strict=True)] == ["abc", "мир", "漢字", "かな", "abc", "漢漢漢漢", "漢漢漢漢", "漢漢", "x" * 24, "x" * 6]
    assert language.familiar(model, [text("en", 5, 1), "漢字かな", "", None, "12", "漢" + text("ru", 5, 2)]) == [True, False, False, False, False, True]


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8))
    rows = [(i, x[i].tolist()) for i in range(120)]
    df = spark.createDataFrame([*rows, *rows[:60], *rows[:7]], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, g in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        assert g["vec_id"].tolist() == np.argsort(-s)[:5].tolist() and g["rank"].tolist() == [1, 2, 3, 4, 5]


def test_int8_products_are_exact():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-127, 128, (5, 2500), np.int8), rng.integers(-127, 128, (7, 2500), np.int8)
    assert (neighbours.products(a, b) == a.astype(int) @ b.astype(int).T).all()


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 64)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:150] = x[50]  # ties
    x[200] *= 1e30
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    bad = [(300, None), (350, [0.0] * 16), (400, [1.0, None] + [0.0] * 14), (450, [float("nan")] * 16), (500, []), (None, [1.0] * 16), (550, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).withColumn("dim", F.lit("z"))
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    v = x.astype(float)
    v /= np.abs(v).max(1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert sorted(set(got["query_id"])) == [0, 50, 100, 150, 200, 250]
    for q, g in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -9
        want = sorted(range(300), key=lambda i: (-round(s[i], 12), i))[:5]
        assert g["vec_id"].tolist() == want and g["score"].tolist() == pytest.approx(s[want]) and g["rank"].tolist() == [1, 2, 3, 4, 5]
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id in (0, 7)"), F.col("vec_id") % 50 == 0).count() == 1
