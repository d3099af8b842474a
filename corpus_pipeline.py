"""From raw documents to a training mix: five stages, each of which works on all that the one before has kept.

Every stage but the last returns the columns of documents. The last adds what the mix takes of each document (size, source_size,
target, taken, copies) and keeps the documents of which it takes something.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import decontaminate, mixing, near_dup, pii, quality
from shelfscope.llm.shared import delete_folder, shared_folder, table

#: Documents that score below it are rejected.
LEAST_QUALITY = 0.3


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents that are not held out; documents that score below LEAST_QUALITY go."""
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, net, score_col="__quality")
    return scored.where(F.col("__quality") >= LEAST_QUALITY).drop("__quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_dup.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; n_chars follows the text."""
    names = docs.columns
    clean = pii.find_personal_data(docs, spans_col="__spans", redacted_col="text")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their weights; documents that the mix doesn't take go."""
    return mixing.mix_to_targets(docs).where(F.col("copies") > 0)


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written and read again; what a stage has read is deleted once it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
