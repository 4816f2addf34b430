"""How the entities of the index are bound to stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, kb_id, connector_id, title, text); the knowledge base is the language."""
    return table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("kb_id"), F.col("source").alias("connector_id"),
        first_line(F.col("text")).alias("title"), "text")


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """The query table: (query_id, text)."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk vectors: (chunk_id, doc_id, kb_id, vec); ten consecutive vectors form a document."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        (F.col("vec_id") / 10).cast("long").alias("doc_id"),
        F.col("label").alias("kb_id"),
        F.col("embedding").cast("array<double>").alias("vec"))


STATUS_OF_EVENT = {"signup": "pending", "view": "running", "click": "indexed",
                   "error": "failed", "purchase": "deleted"}


def event_status(event_type: Column) -> Column:
    pairs = [F.lit(x) for kv in STATUS_OF_EVENT.items() for x in kv]
    return F.element_at(F.create_map(*pairs), event_type)


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, doc_id, ts, status, value, props)."""
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("doc_id"), "ts",
        event_status(F.col("event_type")).alias("status"), "value", "props")


def crawl(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")
