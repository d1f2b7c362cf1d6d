"""A corpus in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of documents. Each stage states its edge cases in the
docstring of the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from advisium.llm import decontam, near_copies, pii, quality_cnn, sentencepiece_ac
from advisium.llm.common import documents, remove, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on this corpus' labels, rejects go."""
    return quality_cnn.accepted(docs, quality_cnn.train(docs, documents(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 0.8 or more of their five-word shingles alike."""
    return near_copies.deduplicate(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked."""
    return pii.redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and the text that they give back."""
    return sentencepiece_ac.encode(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", clean_of_benchmark),
    ("pii", private_data),
    ("sentencepiece", pieces),
]

#: Training, SimHash and alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again; what a stage has read is then removed."""
    docs = documents(spark, sf_dir)
    top, last = scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if last:
            remove(f"{top}/{last}")
        last = name
    return docs
