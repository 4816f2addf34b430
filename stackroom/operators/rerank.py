"""Second-stage ordering of a merged list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens

TOP_N = 3


def term_coverage(query: Column, text: Column) -> Column:
    """Share of the distinct query words that occur in the text."""
    wanted = F.array_distinct(word_tokens(query))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(wanted, word_tokens(text))) / F.size(wanted))


def rerank(hits: DataFrame, top_n: int = TOP_N, scorer: Callable[[DataFrame], DataFrame] | None = None,
           enabled: bool = True) -> DataFrame:
    """Order each query's hits by relevance and keep ``top_n``.

    hits (query_id, query, text, score, rank, ...). ``scorer`` adds ``relevance``; a null relevance
    stands for a failed scorer, and then the whole list falls back to the order of scores.
    """
    if not enabled:
        return hits.filter(F.col("rank") <= top_n).select(
            "*", F.lit(None).cast("double").alias("rerank_score"), F.col("rank").alias("position"),
            F.lit(False).alias("fallback"))
    scored = scorer(hits) if scorer else hits.withColumn("relevance", term_coverage(F.col("query"), F.col("text")))
    failed = F.max(F.col("relevance").isNull().cast("int")).over(Window.partitionBy("query_id")) == 1
    flagged = scored.withColumn("fallback", failed)
    by = F.when(F.col("fallback"), F.round("score", 9)).otherwise(F.round("relevance", 9))
    order = Window.partitionBy("query_id").orderBy(by.desc(), F.asc("rank"))
    out = flagged.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top_n)
    return out.withColumn("rerank_score", F.when(~F.col("fallback"), F.round("relevance", 6))).drop("relevance")
