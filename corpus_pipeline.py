"""Corpus preparation in five stages, each an operator of ``windfold.llm``.

Quality classifier, exact dedup, near-duplicate join, source mixing, packing.
A stage's rows are written as Parquet below the shared folder and read again as
the documents of the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from windfold.llm import common, exact_dedup, jaccard_join, mixing, packing, quality_model
from windfold.session import checkpoint_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labelled rows of the corpus that are not held out."""
    net = quality_model.fitted(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, net)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, the one with the largest identifier."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles connect at a similarity of 0.8 or more, the one with the smallest identifier."""
    return jaccard_join.one_of_each(docs, n=5, similarity=(80, 100))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights, none passed more than twice and no document left out."""
    return mixing.remix(docs, max_repetition=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("exact", without_copies), ("near", without_near_copies), ("mix", mixed_sources), ("pack", packed)]

#: The classifier, the near-duplicate join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = common.read(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
