"""documents to packed training sequences: toxicity, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame, is written as Parquet, and is read again as the next one's docs.
Stages treat nulls, empty and very long texts, repeated rows and empty tables as their operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from corpusmill.llm.storage import BATCH_BYTES, shared_dir

#: What goes to Python at once while a stage is written, by bytes, so that long texts don't add up in an executor's memory.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def small_batches(stage):
    """The stage, with small batches from then on: its rows are computed when its caller writes them. `run` puts the setting back."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(*BATCH)
        return stage(spark, docs, sf_dir)

    return run


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group connected by a Jaccard similarity of 0.8 or more."""
    return ngram_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by the raked probabilities."""
    return mixing.mix_documents(docs).where("sampled").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", small_batches(clean)), ("exact_dedup", unique), ("ngram_jaccard", dissimilar), ("mixing", mixed), ("packing", packed)]

#: The trained classifier of the first stage can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH[0])
    try:
        for name, stage in STAGES:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH[0], before)
    return docs
