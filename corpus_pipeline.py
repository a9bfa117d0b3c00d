"""The training-text pipeline: stages over ``documents``, each read from the last one's files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from peakloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from peakloom.llm.common import delete, shared_dir
from peakloom.llm.queries import vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go; it is fitted on all labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram links connect, the document with the smallest id stays."""
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked source, language and topic weights."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the packed sequences."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing", mix),
    ("packing", pack),
]
#: SQL can express neither the model nor the raking, so the stages are tested apart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing each one's result to the shared folder.

    A stage's documents are deleted when the next one's are written, so that one
    copy is left besides the result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            delete(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(path)
    return docs
