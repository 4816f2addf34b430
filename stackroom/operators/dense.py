"""Cosine top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, unit
from .topk import column, ranked, running_best

#: Most query vectors broadcast at once (8192 x 1024 doubles are 64 MB).
SLAB = 8192


def result_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("kb_id", chunks.schema["kb_id"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType())])


def slabs_of(queries: DataFrame, slab: int) -> list[DataFrame]:
    """Split a query table into parts of about ``slab`` rows by a hash of the id."""
    n = queries.count()
    parts = max(1, -(-n // slab))
    if parts == 1:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, slab: int = SLAB) -> DataFrame:
    """Best k chunks of every knowledge base for every query.

    queries (query_id, vec), chunks (kb_id, chunk_id, vec) -> (query_id, kb_id, chunk_id, score, rank)
    """
    spark = chunks.sparkSession
    schema = result_schema(queries, chunks)
    chunks = chunks.select("kb_id", "chunk_id", "vec")

    def one(part: DataFrame) -> DataFrame:
        rows = part.select("query_id", "vec").toPandas()
        ids = rows["query_id"].to_numpy()
        matrix = _unit_rows(np.array(rows["vec"].tolist(), dtype="float64")) if len(ids) else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((ids, matrix))

        def score(batch: pa.RecordBatch):
            flat = column(batch, "vec").flatten().to_numpy(zero_copy_only=False)
            return shared.value[1] @ _unit_rows(flat.reshape(batch.num_rows, -1)).T, None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(shared.value[0]):
                yield from running_best(batches, k, shared.value[0], score)

        return chunks.mapInArrow(run, schema)

    hits = reduce(DataFrame.unionByName, [one(p) for p in slabs_of(queries, slab)])
    return ranked(hits, k)


def dense_topk_in_doc(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Best k chunks inside one named document.

    queries (query_id, doc_id, vec), chunks (kb_id, doc_id, chunk_id, vec). The vectors of a document
    are packed into one row and joined once per query, so no pair of chunk and query is shuffled.
    """
    packed = chunks.groupBy("doc_id").agg(
        F.collect_list(F.struct("chunk_id", unit(F.col("vec")).alias("vec"))).alias("members"))
    scored = queries.select("query_id", "doc_id", unit(F.col("vec")).alias("q")).join(packed, "doc_id").select(
        "query_id", "doc_id",
        F.slice(F.array_sort(F.transform("members", lambda m: F.struct(
            (-F.round(dot(F.col("q"), m["vec"]), 9)).alias("neg"), m["chunk_id"].alias("chunk_id")))), 1, k).alias("best"))
    return scored.select("query_id", "doc_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", "doc_id", F.col("b.chunk_id").alias("chunk_id"), (-F.col("b.neg")).alias("score"),
        (F.col("pos") + 1).alias("rank"))
