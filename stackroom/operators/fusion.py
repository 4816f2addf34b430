"""Combining ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topk import ranked

RRF_K = 60
ALPHA = 0.5


def min_max(score: Column, keys: tuple[str, ...]) -> Column:
    """Scale a list to 0..1; a list with one distinct score becomes 1."""
    over = Window.partitionBy(*keys)
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def hybrid_rsf(dense: DataFrame, sparse: DataFrame, k: int, alpha: float = ALPHA) -> DataFrame:
    """Relative score fusion of a dense and a sparse list per (query, kb); a missing side counts 0."""
    keys = ("query_id", "kb_id")
    d = dense.select(*keys, "chunk_id", min_max(F.col("score"), keys).alias("dense"))
    s = sparse.select(*keys, "chunk_id", min_max(F.col("score"), keys).alias("sparse"))
    both = d.join(s, [*keys, "chunk_id"], "full_outer")
    score = F.round(alpha * F.coalesce("dense", F.lit(0.0)) + (1 - alpha) * F.coalesce("sparse", F.lit(0.0)), 9)
    return ranked(both.select(*keys, "chunk_id", score.alias("score")), k)


def rrf_merge(lists: DataFrame, k: int | None = None, rrf_k: int = RRF_K, payload: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of the lists of a query.

    lists (query_id, list_no, rank, chunk_id, payload...) -> (query_id, chunk_id, score, rank, payload...).
    A chunk in several lists adds up and keeps the payload of the last list; ties keep the order in
    which chunks were first seen.
    """
    agg = [F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("raw"),
           F.min(F.struct("list_no", "rank")).alias("first")]
    if payload:
        agg.append(F.max_by(F.struct(*payload), F.col("list_no")).alias("payload"))
    fused = lists.groupBy("query_id", "chunk_id").agg(*agg)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 12)), F.asc("first"))
    out = fused.withColumn("rank", F.row_number().over(order))
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    return out.select("query_id", "chunk_id", F.round("raw", 6).alias("score"), "rank",
                      *[F.col(f"payload.{p}").alias(p) for p in payload])


def similarity_merge(hits: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """One list per query from all its knowledge bases by score; low scores leave first."""
    return ranked(hits.filter(F.col("score") >= min_score).drop("rank"), k, ("query_id",))
