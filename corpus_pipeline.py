"""A training corpus from raw documents: five stages, each over all that the one before kept.

``run`` writes each stage's result as Parquet into the shared folder and reads it back, so that a lost executor
costs the running stage's tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.llm import bpe, decontamination, near_dedup, suffix_dedup, toxicity
from rasterflow.llm.common import fresh_dir, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model passes; it learns from the labels that op5 learns from."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id")))))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a smaller doc_id has."""
    return suffix_dedup.drop_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of ids and decoded texts."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", one_of_each),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: Trained scores and byte-pair merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
