"""Replace child hits by their parent chunk when enough siblings were hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("query_id", "kb_id")


def auto_merge(hits: DataFrame, parents: DataFrame, levels: int, threshold: float = 0.5) -> DataFrame:
    """Merge upwards through ``levels`` ancestor levels.

    hits (query_id, kb_id, chunk_id, parent_chunk_id, score, rank, text),
    parents (parent_chunk_id, grandparent_id, child_count, parent_text).
    Hits whose parent is unknown settle and come first; then what stayed active, group by group in
    the order of each group's first hit.
    """
    active = hits.select(*KEYS, "chunk_id", "parent_chunk_id", "score", "text",
                         F.lit(False).alias("merged"), F.array(F.col("rank").cast("long")).alias("pos"))
    settled = None
    for level in range(levels):
        known = active.join(parents, "parent_chunk_id", "left")
        passed = known.filter(F.col("child_count").isNull()).select(
            *active.columns, F.lit(level).alias("stage"))
        settled = passed if settled is None else settled.unionByName(passed)
        group = Window.partitionBy(*KEYS, "parent_chunk_id")
        grouped = known.filter(F.col("child_count").isNotNull()).select(
            "*", F.count("*").over(group).alias("n"), F.min("pos").over(group).alias("head"))
        enough = F.col("n") / F.col("child_count") >= threshold
        up = grouped.filter(enough).groupBy(*KEYS, "parent_chunk_id", "grandparent_id", "parent_text", "head").agg(
            F.avg("score").alias("score")).select(
            *KEYS, F.col("parent_chunk_id").alias("chunk_id"), F.col("grandparent_id").alias("parent_chunk_id"),
            "score", F.col("parent_text").alias("text"), F.lit(True).alias("merged"), F.col("head").alias("pos"))
        stay = grouped.filter(~enough).select(*[
            F.concat("head", "pos").alias("pos") if c == "pos" else F.col(c) for c in active.columns])
        active = up.unionByName(stay)
    rest = active.withColumn("stage", F.lit(levels))
    out = rest if settled is None else settled.unionByName(rest)
    order = Window.partitionBy(*KEYS).orderBy("stage", "pos")
    return out.select("*", F.row_number().over(order).alias("position")).drop("pos", "stage")
