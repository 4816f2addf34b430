"""Equi-joins on bucket keys that survive hot buckets.

Copies are collapsed before a join (one row per distinct sketch with the number of its documents), so
a group of copies is one row whatever its size. A bucket that is still large becomes a grid: both sides
are dealt into blocks by hash and repeated along the other side's blocks, so every pair meets exactly
once and a task compares two blocks, never a whole hot bucket. Pairs are tested inside the join and
reduced to one row per left side by the partial aggregation of the same stage; they are never written
or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Rows of one block of a bucket.
BLOCK_ROWS = 10_000


def _blocks(side: DataFrame, keys: list[str], name: str, block_rows: int) -> DataFrame:
    return side.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > block_rows).select(
        *keys, F.ceil(F.col("_n") / block_rows).cast("int").alias(name))


def bucket_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
                condition: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inner join on ``keys`` and ``condition`` (on columns of both sides, which must differ in name).

    The table of hot buckets has at most rows / block_rows entries; whether it is broadcast is left to
    the size check of the optimizer.
    """
    hot = staged(_blocks(left, keys, "_lb", block_rows).join(_blocks(right, keys, "_rb", block_rows), keys, "full_outer"))
    if hot.isEmpty():
        return left.join(right, keys).filter(condition)

    def dealt(side: DataFrame, ident: str, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        marked = side.join(hot, keys, "left")
        return marked.withColumn(own_block, F.pmod(F.xxhash64(ident), F.coalesce(own, F.lit(1))).cast("int")).withColumn(
            other_block, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_lb", "_rb")

    a = dealt(left, left_id, "_lb", "_rb", "_i", "_j")
    b = dealt(right, right_id, "_rb", "_lb", "_j", "_i")
    return a.join(b, [*keys, "_i", "_j"]).filter(condition).drop("_i", "_j")


def collapse(docs: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """One row per distinct key: (keys..., n_docs, first_doc, carried columns that are equal within a key)."""
    return docs.groupBy(*keys).agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), *[F.any_value(c).alias(c) for c in carry])


def copy_partner(docs: DataFrame, groups: DataFrame, sketch: list[str]) -> DataFrame:
    """docs plus ``n_docs`` and ``copy_of``: the smallest other document with the same sketch."""
    joined = docs.join(groups, sketch)
    second = joined.filter(F.col("doc_id") != F.col("first_doc")).groupBy(F.col("first_doc").alias("_head")).agg(
        F.min("doc_id").alias("_second"))
    return joined.join(second, F.col("doc_id") == F.col("_head"), "left").withColumn(
        "copy_of", F.when(F.col("doc_id") == F.col("first_doc"), F.col("_second")).otherwise(F.col("first_doc"))).drop(
        "first_doc", "_head", "_second")
