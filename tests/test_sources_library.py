import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import fit, library, templates
from starfold.sources import lightcurves as src


def test_text_reader(spark, tmp_path):
    (tmp_path / "a.tab").write_text("  1.5  20.1 0.01 0.00\n\n2.5\t19.9 0.30 4.0\nbroken line\n3 4 5 x\n3 20 0.1 9\n")
    rows = src.read_text(spark, str(tmp_path / "a.tab")).orderBy("t").collect()
    assert [(r["t"], r["band"], r["mag"], r["magerr"]) for r in rows] == [(1.5, "u", 20.1, 0.01), (2.5, "z", 19.9, 0.3)]


def test_nest_and_unnest(spark):
    obj = spark.createDataFrame([(1, 0), (2, 0)], "object_id long, extendedness int")
    s = spark.createDataFrame([(1, 2.0, "g"), (1, 1.0, "r")], "object_id long, t double, band string")
    nested = src.nest(obj, s)
    got = {r["object_id"]: r["sources"] for r in nested.collect()}
    assert [x["band"] for x in got[1]] == ["r", "g"] and got[2] == []
    assert src.unnest(nested).count() == 2 and src.unnest(nested, outer=True).count() == 3


def test_alerts_and_classes(spark):
    alerts = spark.createDataFrame([(7, [(1.0, 100.0, 1.0, "g"), (2.0, -1.0, 1.0, "g")], ("RRAB/x",)), (8, [], None)], "diaObjectId long, prvDiaSources array<struct<midpointMjdTai:double,scienceFlux:double,scienceFluxErr:double,band:string>>, xm struct<vsx_Type:string>")
    rows = src.unnest_alerts(alerts).orderBy("t").collect()
    assert len(rows) == 2 and rows[0]["mag"] == pytest.approx(31.4 - 5) and rows[1]["mag"] is None
    assert [r["diaObjectId"] for r in src.of_class(alerts).collect()] == [7]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, 1.0 / i) for i in range(1, 6)], "object_id long, rss_frac double")
    src.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 5
    src.write_candidates(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 5
    first = src.checkpointed(df, f"{tmp_path}/k")
    again = src.checkpointed(df.limit(1), f"{tmp_path}/k")
    assert first.count() == again.count() == 5 and src.checkpointed(df.limit(1), f"{tmp_path}/k", reuse=False).count() == 1
    assert src.markdown(df).startswith("| object_id | rss_frac |")
    assert src.read_catalog(spark, f"{tmp_path}/p", ["object_id"]).columns == ["object_id"]


def test_csv_template(spark, tmp_path):
    (tmp_path / "templates.csv").write_text('"g",0.0,1.0,0.5\n"r",0.1,0.9,0.4\n')
    (tmp_path / "betas.csv").write_text("g,i\n1.0,9\n2.0,9\n3.0,9\n")
    (tmp_path / "dust.csv").write_text("g,3.3\nz,1.0\n")
    rows = {r["band"]: r for r in templates.load_csv(spark, str(tmp_path)).collect()}
    assert rows["g"]["gamma"] == [0.0, 1.0, 0.5] and (rows["g"]["dust"], rows["g"]["c0"], rows["g"]["p2"]) == (3.3, 1.0, 3.0)
    assert (rows["r"]["dust"], rows["r"]["c0"], rows["r"]["p1"], rows["r"]["bidx"]) == (0.0, 0.0, 0.0, 1)
    assert rows["g"]["template_id"] == tmp_path.name


def test_zip_templates(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("b.txt", "Phase,Mag,Band\n0.5,1.0,r\n0.0,0.0,r\n1.2,9,r\nshort\n0.25,2.0,g\n")
        z.writestr("a.txt", "mag,phase,band\n1.0,0.0,g\n")
        z.writestr("c.txt", "nothing here")
    good, bad = templates.load_zip(spark, str(tmp_path / "t.zip"), n_phase=4)
    by = {(r["template_id"], r["band"]): r["gamma"] for r in good.collect()}
    assert by["b.txt", "r"] == [0.0, 0.5, 1.0, 0.5] and by["b.txt", "g"] == [2.0] * 4 and by["a.txt", "g"] == [1.0] * 4
    assert [r["template_id"] for r in bad.collect()] == ["c.txt"]
    assert {r["template_id"] for r in templates.load_zip(spark, str(tmp_path / "t.zip"), contains="b")[0].collect()} == {"b.txt"}
    with pytest.raises(ValueError):
        templates.load_zip(spark, str(tmp_path / "t.zip"), contains="nope")


def test_template_algebra(spark):
    a, b, c = (templates.synthetic(n, bands, p, s) for n, bands, p, s in (("a", ("g", "r"), 8, 0.1), ("b", ("g", "r"), 16, 0.2), ("c", ("g", "z"), 8, 0.3)))
    df = templates.frame(spark, [a, b, c])
    mean = {r["band"]: r["gamma"] for r in templates.averaged(df, 8).collect()}
    want = (a.gamma + np.array([templates.periodic(np.arange(16) / 16, g, 8) for g in b.gamma])) / 2
    assert mean["g"] == pytest.approx(list(want[0])) and set(mean) == {"g", "r"}
    turned = {(r["template_id"], r["band"]): r["gamma"] for r in templates.aligned(df, "g").collect()}
    assert turned["a", "g"][0] == min(turned["a", "g"]) and turned["a", "r"] == list(np.roll(a.gamma[1], -a.gamma[0].argmin()))
    assert templates.modal_bands(df).first()["bands"] == ["g", "r"]
    assert {r["template_id"] for r in templates.sharing(df, ["r", "g"]).collect()} == {"a", "b"}
    slopes = df.where("template_id = 'a' and band = 'g'").select(templates.slopes(F.col("gamma"))).first()[0]
    assert slopes == pytest.approx(list(a.slopes()[0]))
    assert [t.name for t in templates.collect(df)] == ["a", "b", "c"] and a.subset(["r"]).bands == ("r",)
    with pytest.raises(ValueError):
        a.subset(["q"])
    lc = spark.createDataFrame([(1, "g"), (1, "q")], "object_id long, band string")
    assert templates.unknown_bands(lc, a).first()["bands"] == ["q"]


def test_distances_and_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 5)) * [5, 2, 1, 0.1, 0.1]
    df = spark.createDataFrame([(f"{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, vec array<double>")
    d = library.pairwise_l2(df).toPandas()
    assert len(d) == 435 and all(r.dist == pytest.approx(np.linalg.norm(x[int(r.id)] - x[int(r.id2)])) for r in d.itertuples())
    p = library.pearson_distance(df).toPandas()
    assert all(r.dist == pytest.approx(1 - np.corrcoef(x[int(r.id)], x[int(r.id2)])[0, 1], abs=1e-9) for r in p.itertuples())
    spectrum = library.principal(df).orderBy("component")
    eig = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 29
    assert [r["eigenvalue"] for r in spectrum.collect()] == pytest.approx(list(eig))
    assert library.components_for(spectrum, 0.95).first()[0] == int(np.searchsorted(np.cumsum(eig) / eig.sum(), 0.95)) + 1


def test_clusters(spark):
    x = np.concatenate([np.arange(5) * 0.1, 10 + np.arange(5) * 0.1])
    df = spark.createDataFrame([(f"{i}", [float(v)]) for i, v in enumerate(x)], "id string, vec array<double>")
    pairs = library.pairwise_l2(df)
    got = library.kmedoids(pairs, [2]).toPandas()
    assert set(got["medoid"]) == {"2", "7"} and got["cost"].iloc[0] == pytest.approx(1.2)
    merges = library.average_linkage(pairs).orderBy("step").collect()
    assert len(merges) == 9 and merges[-1]["height"] == pytest.approx(10.0) and merges[-1]["size"] == 10
    order = library.leaf_order([(r["step"], r["left"], r["right"]) for r in merges], 10)
    assert sorted(order) == list(range(10)) and ({*order[:5]} in ({*range(5)}, {*range(5, 10)}))


def test_simulation_and_recovery(spark):
    lib = [templates.synthetic(f"t{i}", ("g", "r", "i", "z"), 50, 0.05 + 0.12 * i, dusty=False) for i in range(3)]
    trials = spark.createDataFrame([(k, f"t{k % 3}", 0.5 + 0.02 * k) for k in range(4)], "trial long, template_id string, period double")
    lc = library.simulate(spark, trials, lib, n_obs=30, noise=0.01, span=60.0)
    n = lc.where("object_id = 0").groupBy("band").count().toPandas().set_index("band")["count"]
    assert n.to_dict() == {"g": 8, "r": 8, "i": 7, "z": 7} and lc.orderBy("object_id", "t").collect() == library.simulate(spark, trials, lib, n_obs=30, noise=0.01, span=60.0).orderBy("object_id", "t").collect()
    fits = fit.fit(lc, lib, 0.45, 0.1, 0.62)
    rss = fits.select(F.col("object_id").alias("trial"), "template_id", "rss", "period").join(trials.select("trial", F.col("template_id").alias("truth_id"), F.col("period").alias("period_true")), "trial")
    best = rss.toPandas().sort_values("rss").groupby("trial").first()
    assert (abs(best["period"] - best["period_true"]) < 0.01).all()
    x = library.excess(rss, spark.createDataFrame([("t0",)], "template_id string")).toPandas()
    assert (x["excess"] >= 0).all() and x.set_index("trial")["truth_in"].to_dict() == {0: True, 1: False, 2: False, 3: True}
    assert library.competitive_counts(rss).count() == 4 and library.excess_quantiles(library.excess(rss, rss.select("template_id"))).first()["max"] == 0


def test_classifier(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), int(a + b > 0)) for a, b in rng.normal(size=(200, 2))]
    model, auc = library.classify(spark.createDataFrame(rows, "a double, b double, label int"), ["a", "b"], trees=10, folds=2)
    assert auc > 0.8


def test_streaming_prefilter(spark, tmp_path):
    from starfold.streaming.prefilter import running_variability

    rows = [(1, "g", f"2024-01-0{1 + k % 5} 00:00:00", 20 + 0.5 * (k % 2), 0.02) for k in range(10)]
    spark.createDataFrame(rows, "object_id long, band string, ts string, mag double, magerr double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("object_id long, band string, ts timestamp, mag double, magerr double").parquet(f"{tmp_path}/in")
    q = running_variability(stream).writeStream.outputMode("update").format("memory").queryName("variability").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("variability").collect()
    assert sum(r["n"] for r in got) == 10 and all(r["chi2"] > 50 for r in got)


def test_pairs_of_blocks(spark, monkeypatch):
    """Many small blocks, copies, odd vectors: each pair once, from few shuffled rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 6)), np.full((9, 6), 0.3)]) + 100
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (100, [1.0, 2.0]), (101, [1.0, None]), (102, None), (None, rows[0][1]), (0, rows[1][1])], "id long, vec array<double>").repartition(5)
    monkeypatch.setattr(library, "BLOCK", 8)
    monkeypatch.setattr(library, "CELLS", 40)
    got = library.pairwise_l2(df, to=6).toPandas()
    assert len(got) == len(got.query("id < id2")) == 73 * 72 // 2 - 1
    assert got.query("id2 >= 100")["dist"].isna().all()
    own = got.query("id > 0 and id2 < 100")
    assert len(own) == 68 * 67 // 2 and all(r.dist == round(float(np.linalg.norm(x[r.id] - x[r.id2])), 6) for r in own.itertuples())
    assert (own.query("id >= 60")["dist"] == 0).all()  # copies cancel to nothing at all
    p = library.pearson_distance(df.where("id > 0 and id < 100"), to=6).toPandas()
    corr = np.corrcoef(x[:60])
    assert len(p) == 68 * 67 // 2 and all(abs(r.dist - (1 - corr[r.id, r.id2])) < 1e-6 for r in p.query("id2 < 60").itertuples())
    plan = library.pairwise_l2(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan  # no row-by-row arrays


def test_rounds_as_sql(spark):
    x = np.array([0.5, 1.5, -0.5, -0.2, 2.4999999])
    assert list(library._rounded(x, 0)) == [1.0, 2.0, -1.0, 0.0, 2.0] and not np.signbit(library._rounded(x, 0)[3])


def test_summary_finds_the_median_by_counts(spark, monkeypatch):
    """No single task or driver holds the distances: with few cells and few held values the median is still exact."""
    monkeypatch.setattr(library, "CUTS", 3)
    monkeypatch.setattr(library, "HELD", 2)
    rng = np.random.default_rng(6)
    for values in ([*rng.exponential(size=401)], [*rng.exponential(size=300)], [0.0, 0.0, 0.0, 1.0], [2.0], [1.0, 2.0, float("inf")], [1.0, None, 3.0]):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "dist double")
        known = [v for v in values if v is not None]
        r = library.distance_summary(df).first()
        assert (r["n"], r["max"], r["median"]) == (len(values), max(known), pytest.approx(float(np.median(known)), rel=1e-12))
        assert r["min_positive"] == min(v for v in known if v > 0)
    assert library.distance_summary(df.where("false")).first()["median"] is None


def test_clusters_of_vectors_are_those_of_pairs(spark, monkeypatch):
    """More vectors than a task may hold, with copies: the same medoids and merges as from the whole distance matrix."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(60, 4)) + 4 * rng.integers(0, 3, (60, 1)), np.full((5, 4), 0.5)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").repartition(3)
    pairs = library.pairwise_l2(df)
    monkeypatch.setattr(library, "PASS", 300)
    want = library.average_linkage(pairs).toPandas().sort_values("step")
    for held in (1000, 12, 1):
        monkeypatch.setattr(library, "HELD_CLUSTERS", held)
        got = library.average_linkage(df).toPandas().sort_values("step")
        assert np.allclose(got["height"], want["height"]) and list(got["size"]) == list(want["size"])
        assert got.iloc[4:][["left", "right"]].to_numpy().tolist() == want.iloc[4:][["left", "right"]].to_numpy().tolist()
    ks = [1, 2, 5]
    a, b = (library.kmedoids(f, ks).toPandas().sort_values(["k", "id"]).reset_index(drop=True) for f in (df, pairs.withColumn("id", F.col("id").cast("long"))))
    assert np.allclose(a.pop("cost"), b.pop("cost")) and a.equals(b)
    monkeypatch.setattr(library, "MOST", 10)  # the bound on pairs does not bind vectors
    assert library.kmedoids(df, [2]).count() == 65 and library.average_linkage(df).count() == 64
    assert library.kmedoids(df.where("false"), ks).count() == library.average_linkage(df.where("id = 1")).count() == 0


def test_linkage_passes_ask_for_few_rows(spark, monkeypatch):
    """Only clusters that are new or whose lists have run out are looked at again; large ones add up what is known of them."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(150, 5)), rng.normal(size=(50, 5)) * 0.2, np.full((3, 5), 0.25)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    want = library.average_linkage(library.pairwise_l2(df)).toPandas().sort_values("step")
    asked, passed = [], library._passed
    monkeypatch.setattr(library, "_passed", lambda x, copies, starts, rows: asked.append(rows) or passed(x, copies, starts, rows))
    for nearest, large, held in ((16, 128, 3), (2, 4, 3), (16, 8, 40)):
        asked.clear()
        monkeypatch.setattr(library, "NEAREST", nearest)
        monkeypatch.setattr(library, "LARGE_CLUSTER", large)
        monkeypatch.setattr(library, "HELD_CLUSTERS", held)
        got = library.average_linkage(df).toPandas().sort_values("step")
        assert np.allclose(got["height"], want["height"]) and list(got["size"]) == list(want["size"])
        assert sum(r[:, 1].sum() for r in asked) < 0.5 * len(asked) * 201  # not all rows in every pass


def test_pairs_take_little_room(spark, monkeypatch):
    """No vector is shuffled, and rounded distances of a pair of blocks leave in order; the way with a shuffle gives the same rows."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    odd = df.unionByName(spark.createDataFrame([(95, [1e300] * 8), (96, None), (97, [1.0, None]), (7, rows[3][1])], df.schema))
    named = odd.withColumn("id", F.format_string("n%03d", "id"))
    for block in (4096, 16):
        monkeypatch.setattr(library, "BLOCK", block)
        monkeypatch.setattr(library, "SENT", 1 << 25)
        for f in (library.pairwise_l2, library.pearson_distance):
            assert "Exchange" not in f(df, to=6)._jdf.queryExecution().executedPlan().toString()
            d = f(df, to=6).coalesce(1).toPandas()
            assert len(d) == 90 * 89 // 2 and (np.diff(d["dist"]) < 0).sum() < 80
        sets = []
        for sent in (1 << 25, 0):
            monkeypatch.setattr(library, "SENT", sent)
            sets.append([sorted(map(str, library.pairwise_l2(g, to=6).collect())) for g in (df, odd, named)])
        assert sets[0] == sets[1] and len(sets[0][1]) == 94 * 93 // 2 - 1
    assert library.pairwise_l2(df.where("false"), to=6).count() == 0
