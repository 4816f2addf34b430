"""The corpus pipeline: documents in, a deduplicated, decontaminated mix out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents; the last returns the mix, one row per
block that an output shard takes, with the ids of the documents in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackroom.llm import decontaminate, line_dedup, mixing, simhash_pivots, toxicity_crf
from stackroom.session import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity_crf.mild_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; every document stays. Copies are left to the next stage: here they
    count once, or the lines of a large group of copies would go from all of them."""
    return line_dedup.drop_boilerplate(docs, "source", copies_once=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_pivots.distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of the mix: (shard, sid, source, slot, block, n_words, doc_ids, text)."""
    return mixing.Mix(docs, keep_text=True).blocks()


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination), ("mixing", mix)]

#: Trained scores and random draws have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
