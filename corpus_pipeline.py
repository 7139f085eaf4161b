"""A training-data pipeline: language, toxicity, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept, with the columns of documents; the last returns the packed
pieces. Rows that a stage rejects are gone for all that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontaminate, language, near_dups, packing, toxicity
from ledgerlens.llm.common import shared_dir, table

#: Languages that stay, and the least score of a text's language. On the given tables the lowest score of a text is 0.39.
LANGUAGES, LEAST_SCORE = ["de", "en", "es", "fr"], 0.3


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose predicted language isn't wanted, or stands out too little, go.

    So do texts without any letter, empty and null ones. Repeated rows are
    judged alike; null ids and langs don't matter; an empty table stays empty.
    """
    return language.keep_known(docs, language.fit(docs), LANGUAGES, LEAST_SCORE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier calls toxic go.

    Null and empty texts have the score of no features. Without labels of both
    classes, all texts are judged as that class, and stay if there are none.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least id.

    Equal texts, also empty ones, are a class, and of repeated rows one stays;
    null texts all stay; a null id stays only where no other has the class.
    """
    return near_dups.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a window of ten words of a benchmark item go; null, empty and wordless ones stay."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece; null and empty texts are the end id alone, repeated rows are packed each by themselves."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack),
]

#: SQL has no trained classifiers, weighted samples or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
