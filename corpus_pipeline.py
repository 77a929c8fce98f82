"""Corpus pipeline: language, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import folioflow
from folioflow.llm import bpe, decontam, langid, pii, simhash
from folioflow.llm.queries import table, vocabulary
from folioflow.session import new_path

cloudpickle.register_pickle_by_value(folioflow)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language (``und``: no text, no letter) go; a NULL ``lang`` becomes the one predicted."""
    prototypes = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    known = langid.predict(docs, prototypes).where(F.col("lang_pred") != langid.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    return simhash.keep_one(docs, words=3, radius=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every confirmed span is replaced by its kind; ``n_chars`` follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near-duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal data", private_data),
    ("tokens", tokens),
]

#: Language vectors, bit planes, alignments and merges have no SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
