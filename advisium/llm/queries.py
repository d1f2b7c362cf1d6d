"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from advisium.llm import decontam, pii, quality_cnn, quality_rules, sentencepiece_ac, simhash, token_files, token_scan, url_graph, warc
from advisium.llm.common import documents, scratch


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op3_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.count(documents(spark, sf_dir), scratch(spark, "op3"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_cnn.score(docs, quality_cnn.train(docs, documents(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "op6")
    token_files.write(documents(spark, sf_dir), folder)
    return token_files.read(spark, folder)


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op8_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(documents(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ac.round_trip(documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(documents(spark, sf_dir, "pages"), scratch(spark, "op10"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_token_scan": op3_token_scan,
    "op4_quality_cnn": op4_quality_cnn,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_decontam": op7_decontam,
    "op8_url_graph": op8_url_graph,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_warc": op10_warc,
}

SQL: dict[str, str] = {"op5_quality_rules": quality_rules.sql(), "op8_url_graph": url_graph.sql()}
