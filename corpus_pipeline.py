"""A corpus pipeline: each stage works on what the one before it kept, written as Parquet in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import bpe, chosen_path, decontam, line_dedup, quality_fm
from assaykit.llm.queries import vocabulary
from assaykit.llm.tables import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are deleted; a document of which nothing is left goes."""
    return line_dedup.remove_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return chosen_path.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left."""
    return bpe.encode(docs, vocabulary(), ("n_tokens", "token_ids"), keep=["doc_id", "lang", "source"], hold=False)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: Fitted weights and the tokenizer have no SQL; tests/llm/test_pipeline.py holds each stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
