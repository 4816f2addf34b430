"""Sparse term-frequency vectors and IDF-weighted top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import token_counts, word_tokens
from ..session import staged
from .batches import pieces
from .dense import result_schema, slabs_of
from .topk import column, ranked, running_best

#: Most queries whose terms are sent to the tasks at once.
SLAB = 1024


def token_id(token: Column) -> Column:
    return F.crc32(F.encode(token, "utf-8")).bitwiseAND(F.lit(0x7FFFFFFF))


def sparse_tf(df: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """Postings (ids..., token, token_id, tf), counted inside each row."""
    return df.select(*ids, F.explode(token_counts(word_tokens(F.col(text)))).alias("t")).select(
        *ids, F.col("t.token").alias("token"), token_id(F.col("t.token")).alias("token_id"),
        F.col("t.tf").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(n / df) + F.lit(1.0)


def known_tokens(chunks: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(kb_id, chunk_id, ids, tfs): the sparse vectors of chunks (kb_id, chunk_id, tokens) in the tokens of ``vocabulary``, by their
    places there."""
    names = pa.array(vocabulary, pa.string())
    schema = T.StructType([chunks.schema["kb_id"], chunks.schema["chunk_id"], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "tokens")):
            tokens = column(batch, "tokens")
            ids = pc.index_in(tokens.flatten(), value_set=names)
            keep = ids.is_valid()
            rows = pc.list_parent_indices(tokens).filter(keep).to_numpy().astype(np.int64)
            found, tfs = np.unique(rows * max(1, len(names)) + ids.filter(keep).to_numpy(), return_counts=True)
            rows, ids = np.divmod(found, max(1, len(names)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "kb_id"), column(batch, "chunk_id"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=["kb_id", "chunk_id", "ids", "tfs"])

    return chunks.mapInArrow(run, schema)


def _slab_hits(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, kb_id, chunk_id, score): what can be among the best k chunks, for the queries of a slab."""
    spark, schema = chunks.sparkSession, result_schema(queries, chunks)
    terms = sparse_tf(queries, "query_id").select("query_id", "token", "tf").toPandas()
    token, vocabulary = pd.factorize(terms["token"])
    query, query_ids = pd.factorize(terms["query_id"])
    query_ids = np.asarray(query_ids)
    located = staged(known_tokens(chunks, list(vocabulary)))
    held = located.select("kb_id", F.explode("ids").alias("id")).groupBy("kb_id", "id").agg(F.count("*").alias("df"))
    size = located.groupBy("kb_id").agg(F.count("*").alias("n"))
    rare = held.join(size, "kb_id").select("kb_id", "id", idf(F.col("n"), F.col("df")).alias("idf")).toPandas()
    kb_of, kbs = pd.factorize(rare["kb_id"])
    weight = np.zeros((max(1, len(kbs)), max(1, len(vocabulary))))
    weight[kb_of, rare["id"].to_numpy()] = rare["idf"].to_numpy()
    by_token = np.argsort(token, kind="stable")
    begins = np.searchsorted(token[by_token], np.arange(len(vocabulary) + 1))
    shared = spark.sparkContext.broadcast((query_ids, {kb: i for i, kb in enumerate(kbs)}, weight, begins, query[by_token],
                                           terms["tf"].to_numpy(dtype="float64")[by_token]))

    def score(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        asked, place, weight, begins, of, times = shared.value
        n, ids = batch.num_rows, column(batch, "ids").flatten().to_numpy()
        chunk = pc.list_parent_indices(column(batch, "ids")).to_numpy()
        kb = np.array([place.get(x, 0) for x in column(batch, "kb_id").to_pylist()])
        gain = weight[kb[chunk], ids] * column(batch, "tfs").flatten().to_numpy()
        # Each posting of the chunks meets the queries that hold its token.
        many = begins[ids + 1] - begins[ids]
        at = np.repeat(begins[ids] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cells = of[at] * n + np.repeat(chunk, many)
        scores = np.bincount(cells, times[at] * np.repeat(gain, many), len(asked) * n).reshape(len(asked), n)
        return scores, scores > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(shared.value[0]):
            yield from running_best(batches, k, shared.value[0], score)

    return located.where(F.size("ids") > 0).mapInArrow(run, schema)


def sparse_topk(queries: DataFrame, chunks: DataFrame, k: int, slab: int = SLAB) -> DataFrame:
    """Best k chunks per (query, kb) by the sum of weight x term frequency over shared tokens.

    queries (query_id, text), chunks (kb_id, chunk_id, text)

    Works like :func:`dense_topk`: each task scores its chunks in batches against a slab of queries and keeps the best k per query
    and knowledge base, so no row is made for a query and a chunk, or a block of them, that share a token. A slab and its IDF
    (a number for each of its tokens and knowledge base) are sent to the tasks; more queries make further passes.
    """
    parts = slabs_of(queries, slab)
    split = chunks.where("kb_id IS NOT NULL").select("kb_id", "chunk_id", word_tokens(F.col("text")).alias("tokens"))
    split = staged(split) if len(parts) > 1 else split
    return ranked(reduce(DataFrame.unionByName, [_slab_hits(p, split, k) for p in parts]), k)
