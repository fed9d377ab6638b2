"""From raw documents to packed sequences: five stages, each an operator of ``starfold.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``.  Nulls in other columns stay as they are, extra columns are carried along (to the last stage),
repeated rows are copies, and an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm import jaccard_join, language, packing, shared, suffix_dedup, toxicity
from starfold.llm.codec import vocabulary

TOXIC = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents in which no language can be told, and writes the language found where ``lang`` is null.

    Rejected are null texts, texts without a letter, and texts of which more than half the letters are in scripts that no
    learned language uses.  Where no language was learned, texts with letters stay and ``lang`` stays null.
    """
    told = spark.sparkContext.broadcast(language.fit(docs))

    @F.pandas_udf("string")
    def found(texts):
        import pandas as pd

        some = texts.tolist()
        names, known = language.label(told.value, some)[0], language.familiar(told.value, some)
        shared.trim()
        return pd.Series([n if k else None for n, k in zip(names, known, strict=True)], dtype=object)

    shared.small_batches(spark, rows=1000, bytes_="8m")
    own = "_starfold_lang"
    once = found.asNondeterministic()  # or the filter and the column would each label every text
    kept = docs.withColumn(own, once(F.coalesce("text", F.lit("")))).where(F.col(own).isNotNull())
    name = F.coalesce("lang", F.when(F.col(own) != "und", F.col(own)))
    return kept.withColumn("lang", name).drop(own)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose toxicity score is 0.7 or more; null texts are scored as empty."""
    told = spark.sparkContext.broadcast(toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        scores = pd.Series(toxicity.score(told.value, texts.tolist()).astype(float))
        shared.trim()
        return scores

    shared.small_batches(spark, rows=500, bytes_="4m")
    return docs.where(score(F.coalesce("text", F.lit(""))) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: of those with the least doc_id (nulls: of all without one) one."""
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the bytes that repeat earlier text from every document; ``n_chars`` counts what is left.  No document goes."""
    return suffix_dedup.cut_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids by power-of-two decomposition, equal lengths side by side; null texts hold the end id."""
    return packing.bucketed(packing.pack(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs, before = shared.documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = shared.written(docs, "stage")
            if before:  # the table before it is read no more
                shared.remove(spark, before)
            before = path
    return docs
