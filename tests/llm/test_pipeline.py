import os

import duckdb
import pytest

import corpus_pipeline
from starfold.llm import jaccard_join, packing, queries, suffix_dedup

from .helpers import SCHEMA, empty, prose, table
from .test_models import labelled

SF = "/root/testdata/sf0.001"


def folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(labelled(240))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, tmp_path):
    texts = [t for t, _ in labelled(240)]
    near = prose(90, 1)
    rows = list(enumerate(texts)) + [(300, near), (301, near), (302, near + " more"), (303, None), (304, "123 456"), (305, prose(60, 2) + " " + near[:300]), (306, ""), (307, "漢字かな交じり文 " * 9)]
    docs = table(spark, rows)
    sf = folder(spark, tmp_path, docs)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == before.columns
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    first, clean, one, cut = seen.values()
    assert set(first) == {i for i, _ in rows} - {303, 304, 306, 307}
    assert set(clean) == set(first) - {i for i, (_, y) in enumerate(labelled(240)) if y}
    assert {300, 305} <= set(one) and not {301, 302} & set(one)
    assert set(cut) == set(one) and cut[305] == rows[-3][1][: len(prose(60, 2)) + 1].rstrip() + cut[305][len(prose(60, 2)) :] and len(cut[305]) < len(one[305])
    assert {r["doc_id"] for r in docs.collect()} == set(cut)
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, empty(spark))).count() == 0


def test_no_language_is_learned(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = table(spark, [*enumerate(t for t, _ in labelled(20)), (50, "12"), (51, None)]).withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert {r["doc_id"] for r in got} == set(range(20)) and {r["lang"] for r in got} == {None}
    mixed = docs.withColumn("lang", F.when(F.col("doc_id") > 3, F.lit("en")))
    assert {r["lang"] for r in corpus_pipeline.identify_language(spark, mixed, "").collect()} == {"en"}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11)) and SCHEMA and jaccard_join and packing and suffix_dedup


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    got, want = (x[sorted(x.columns)].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert got.fillna("").equals(want.fillna(""))
