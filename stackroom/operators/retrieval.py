"""Search over many knowledge bases: fan-out, shaping of responses, orphan filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_out(requests: DataFrame, knowledge_bases: DataFrame) -> DataFrame:
    """One row per request and wanted knowledge base, flagged when it does not exist.

    requests (query_id, kb_ids); a missing or empty list asks every knowledge base.
    """
    all_kbs = knowledge_bases.agg(F.array_sort(F.collect_set("kb_id")).alias("every"))
    wanted = requests.join(F.broadcast(all_kbs)).select(
        "query_id", F.posexplode(F.when(F.coalesce(F.size("kb_ids"), F.lit(0)) > 0, F.col("kb_ids"))
                                 .otherwise(F.col("every"))).alias("list_no", "kb_id"), "every")
    return wanted.select("query_id", "list_no", "kb_id", F.array_contains("every", F.col("kb_id")).alias("valid"))


def drop_orphans(hits: DataFrame, documents: DataFrame) -> DataFrame:
    return hits.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def response_meta(hits: DataFrame, requests: DataFrame, returned: DataFrame, defaults: dict) -> DataFrame:
    """One row of meta data per request; a request option wins over the setting.

    requests (query_id, mode, min_score, rerank_enabled): null options take the default. Requests that aren't reranked
    get their whole merged list.
    """
    total = hits.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
    shown = returned.groupBy("query_id").agg(
        F.count("*").alias("returned"), F.coalesce(F.bool_or("fallback"), F.lit(False)).alias("rerank_fallback"))
    resolved = requests.select(
        "query_id",
        F.coalesce("mode", F.lit(defaults["mode"])).alias("search_mode"),
        F.coalesce("min_score", F.lit(defaults["min_score"])).alias("score_threshold"),
        (F.coalesce("rerank_enabled", F.lit(True)) & F.lit(defaults["rerank_enabled"])).alias("want"))
    joined = resolved.join(total, "query_id", "left").join(shown, "query_id", "left")
    fallback = F.coalesce("rerank_fallback", F.lit(False))
    return joined.select(
        "query_id", F.coalesce("total_candidates", F.lit(0)).alias("total_candidates"),
        F.when(F.col("want"), F.coalesce("returned", F.lit(0))).otherwise(
            F.coalesce("total_candidates", F.lit(0))).alias("returned"), "search_mode", "score_threshold",
        (F.col("want") & ~fallback).alias("reranked"), fallback.alias("rerank_fallback"),
        F.lit("miss" if defaults["cache_enabled"] else "disabled").alias("cache_status"))


def tool_result(hits: DataFrame) -> DataFrame:
    """Shape for tool callers: rounded score, and a source only where it says more than the title."""
    source = F.coalesce("download_url", F.when(F.col("source") != F.col("title"), F.nullif("source", F.lit(""))))
    return hits.withColumn("score", F.round("score", 6)).withColumn("source", source).drop("download_url")
