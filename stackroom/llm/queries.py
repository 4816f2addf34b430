"""Queries of the training-text operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Query
from . import (chunk_dedup, class_lm, decontaminate, language_id, line_dedup, mixing, quality, simhash_pivots,
               suffix_dedup, token_alignment, toxicity_crf, url_rules, whitening)

QUERIES: dict[str, Query] = {}


def op(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = Query(fn, sql)
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@op("op1_mix_sources")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.Mix(_table(spark, folder, "documents")).taken()


@op("op4_simhash_pivots")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_pivots.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@op("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"))


@op("op3_quality_divergence")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents")).drop("n_chars")


@op("op5_decontaminate")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@op("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.predict(_table(spark, folder, "documents"))


@op("op10_toxicity_crf")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_crf.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@op("op8_line_dedup", line_dedup.SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    cut = line_dedup.drop_boilerplate(docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")),
                                      "source", dropped="n_dropped")
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@op("op9_url_rules", url_rules.SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(_table(spark, folder, "pages"))


@op("op6_chunk_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.remove_repeats(_table(spark, folder, "documents"))


@op("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings projected on the leading components of their covariance, a row for each vector and component."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


@op("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Token groups and links of two tokenizers, digested for each document."""
    aligned = token_alignment.align(_table(spark, folder, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return token_alignment.score(aligned.withColumn("groups_sha256", digest).drop("groups")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@op("op12_class_lm")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a class bigram model learned from six in seven of them."""
    docs = _table(spark, folder, "documents")
    return class_lm.score(docs, class_lm.fit(docs))
