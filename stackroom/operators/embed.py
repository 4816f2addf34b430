"""Dense embedding of a text column through a pluggable batch function."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import pieces

Embedder = Callable[[list[str]], np.ndarray]

DIM = 64
#: Tokens whose hashes a task remembers, and texts that are embedded by one call (or those of one row).
REMEMBERED, EMBEDDED = 200_000, 512


def hash_embedder(dim: int = DIM) -> Embedder:
    """Signed feature hashing of word tokens, scaled to length 1. Needs no model.

    A batch's tokens are counted as one array; each different token is hashed once, and a bounded number of them is remembered.
    """
    word, known = re.compile(r"\w+"), {}

    def embed(texts: list[str]) -> np.ndarray:
        tokens = [word.findall((t or "").lower()) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
        coded = pa.array(chain.from_iterable(tokens), pa.string()).dictionary_encode()
        if len(known) > REMEMBERED:
            known.clear()
        begins = []
        for token in coded.dictionary.to_pylist():
            begin = known.get(token)
            if begin is None:
                begin = known[token] = hashlib.md5(token.encode()).digest()[:2]
            begins.append(begin)
        first = np.frombuffer(b"".join(begins), np.uint8).reshape(-1, 2)
        at = coded.indices.to_numpy()
        bucket, sign = first[:, 0].astype(np.int64) % dim, np.where(first[:, 1] < 0x80, 1.0, -1.0)
        out = np.bincount(row * dim + bucket[at], sign[at], len(texts) * dim).reshape(len(texts), dim)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return embed


def dense_embed(df: DataFrame, text: str = "text", out: str = "vec", fn: Embedder | None = None,
                batch_size: int = 32, keep_text: bool = True) -> DataFrame:
    """Append ``out`` = fn(text), called with at most ``batch_size`` texts at a time."""
    fn = fn or hash_embedder()
    keep = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, text)):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            parts = [np.asarray(fn(texts[i:i + batch_size]), dtype="float64")
                     for i in range(0, len(texts), batch_size)]
            matrix = np.vstack(parts) if parts else np.zeros((0, 1))
            width = matrix.shape[1]
            values = pa.array(matrix.ravel(), type=pa.float64())
            offsets = pa.array(np.arange(len(texts) + 1) * width, type=pa.int32())
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.ListArray.from_arrays(offsets, values)], names=keep + [out])

    return df.mapInArrow(run, schema)


def dimension_violations(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector is missing or has another length than the index."""
    return df.filter(F.col(vec).isNull() | (F.size(vec) != dim))


def embed_arrays(df: DataFrame, texts: str, out: str, fn: Embedder | None = None) -> DataFrame:
    """Replace an array of texts by the array of their vectors. The texts of several rows are embedded by one call."""
    fn = fn or hash_embedder()
    keep = [c for c in df.columns if c != texts]
    schema = T.StructType([*[df.schema[c] for c in keep],
                           T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, texts, EMBEDDED)):
            lists = batch.column(batch.schema.get_field_index(texts))
            flat = lists.flatten().to_pylist()
            matrix = np.asarray(fn(flat), dtype="float64") if flat else np.zeros((0, 1))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))
            ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), vectors)], names=[*keep, out])

    return df.mapInArrow(run, schema)
