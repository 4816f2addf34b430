"""Exact top-k of many queries over a partitioned chunk table.

The chunk table is never shuffled or multiplied by the queries. Each task scores its chunks in
Arrow batches against a slab of queries, keeps only the best k per (query, knowledge base) while it
runs, and sends those few rows on. A window then merges the short lists. The slab is the only thing
broadcast, its size is checked, and more queries than fit into one slab make further passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores closer than this many digits count as ties, broken by chunk id.
TIE_DIGITS = 9
#: Scores computed at a time: a block of all queries of a slab and some chunks.
BLOCK_CELLS = 100_000


def best_rows(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = rows.sort_values(["query_id", "kb_id", "score", "chunk_id"],
                               ascending=[True, True, False, True])
    return ordered[ordered.groupby(["query_id", "kb_id"], sort=False).cumcount() < k]


def block_best(scores: np.ndarray, hit: np.ndarray | None, kb: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, chunk) of a score block that can still be in a top k, ties included."""
    qs, cs = [], []
    for value in pd.unique(kb):
        columns = np.flatnonzero(kb == value)
        sub = scores[:, columns]
        if hit is not None:
            sub = np.where(hit[:, columns], sub, -np.inf)
        if len(columns) > k:
            floor = np.partition(sub, len(columns) - k, axis=1)[:, len(columns) - k]
        else:
            floor = np.full(sub.shape[0], -np.inf)
        keep = (sub >= floor[:, None]) & (sub > -np.inf)
        q, c = np.nonzero(keep)
        qs.append(q)
        cs.append(columns[c])
    return np.concatenate(qs), np.concatenate(cs)


def running_best(
    batches: Iterator[pa.RecordBatch], k: int, query_ids: np.ndarray,
    score: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]],
) -> Iterator[pa.RecordBatch]:
    """Best k rows per (query, kb) over all batches of one task."""
    kept: pd.DataFrame | None = None
    step = max(16, BLOCK_CELLS // max(1, len(query_ids)))
    for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
        scores, hit = score(batch)
        scores = np.round(scores, TIE_DIGITS)
        kb, chunk_ids = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("kb_id", "chunk_id"))
        q, c = block_best(scores, hit, kb, k)
        rows = pd.DataFrame({"query_id": query_ids[q], "kb_id": kb[c], "chunk_id": chunk_ids[c], "score": scores[q, c]})
        kept = best_rows(rows if kept is None else pd.concat([kept, rows]), k)
    if kept is not None:
        yield pa.RecordBatch.from_pandas(kept, preserve_index=False)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ranked(hits: DataFrame, k: int, keys: tuple[str, ...] = ("query_id", "kb_id")) -> DataFrame:
    """Add ``rank`` by score, then chunk id, within the keys and keep the first k."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
