"""Search cache as a table: keys, lookup, eviction, invalidation.

Entries: (bucket_hash, query_hash, query, kb_ids array, response, embedding array, created_at).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TTL_SECONDS = 3600
MAX_ENTRIES = 1000
SEMANTIC_THRESHOLD = 0.95
#: Cosines computed at a time.
CELLS = 1 << 19


def bucket_hash(kb_ids: Column, options: Column) -> Column:
    """Hash of the sorted knowledge bases and the effective options (a JSON text with sorted keys)."""
    return F.sha2(F.concat(F.to_json(F.array_sort(kb_ids)), F.lit("|"), options), 256)


def query_hash(bucket: Column, query: Column) -> Column:
    return F.sha2(F.concat(bucket, F.lit("|"), query), 256)


def usable(requests: DataFrame, enabled: bool = True, gate: Callable[[Column], Column] | None = None) -> DataFrame:
    """Requests that may use the cache: the switch, then the gate on the knowledge bases."""
    kept = requests.filter(F.lit(enabled))
    return kept.filter(gate(F.col("kb_ids"))) if gate else kept


def live(entries: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    return entries.filter(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl)) > now)


def exact_lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests plus ``response`` where bucket and query text are equal."""
    return requests.join(entries.select("bucket_hash", "query_hash", "response"), ["bucket_hash", "query_hash"], "left")


def _closest_entries(asked: pa.RecordBatch, names: np.ndarray, vectors: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """(request_id, score, query_hash) of requests whose best entry reaches the threshold, some requests at a time."""
    lengths, step = np.linalg.norm(vectors, axis=1), max(1, CELLS // max(vectors.shape))
    for part in (asked.slice(low, step) for low in range(0, asked.num_rows, step)):
        a = _matrix(part)
        length = np.outer(np.linalg.norm(a, axis=1), lengths)
        cos = np.divide(a @ vectors.T, length, out=np.zeros(length.shape), where=length > 0).round(9)
        at = cos.argmax(axis=1)
        value = cos[np.arange(len(a)), at]
        keep = np.flatnonzero((value >= threshold) & (value > 0))
        ids = part.column(part.schema.get_field_index("request_id")).take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([ids, pa.array(value[keep]), pa.array(names[at[keep]], pa.string())],
                                         names=["request_id", "score", "query_hash"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("embedding")).flatten()
    return flat.to_numpy(zero_copy_only=False).astype("float64").reshape(batch.num_rows, -1)


def semantic_lookup(requests: DataFrame, entries: DataFrame, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    """Best cached response per request by cosine within the bucket.

    requests (request_id, bucket_hash, embedding). Entries of a bucket are bounded by the size of the
    cache, but requests are not: they are cut into salted parts of a bucket, each meeting all entries
    of it. The entries come first in a part and are kept; its requests pass by in batches, so a task holds
    the entries of one bucket and a batch, however many requests there are.
    """
    schema = T.StructType([requests.schema["request_id"], T.StructField("score", T.DoubleType()),
                           T.StructField("query_hash", T.StringType())])
    id_type = requests.schema["request_id"].dataType
    parts = max(1, requests.sparkSession.sparkContext.defaultParallelism)
    asked = requests.filter(F.col("embedding").isNotNull() & F.col("bucket_hash").isNotNull()).select(
        "bucket_hash", F.pmod(F.xxhash64("request_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("side"),
        "request_id", F.lit(None).cast("string").alias("query_hash"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = entries.filter(F.col("embedding").isNotNull() & F.col("bucket_hash").isNotNull()).select(
        "bucket_hash", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side"),
        F.lit(None).cast(id_type).alias("request_id"), "query_hash", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, rows = None, [], []
        for batch in batches:
            key = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket_hash", "part", "side"))))
            starts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]]
            for low, high in zip(starts, [*starts[1:], len(key)]):
                own, side = batch.slice(low, high - low), key[low][2]
                if key[low][:2] != now:
                    now, names, rows = key[low][:2], [], []
                if side == 0:
                    names += own.column(own.schema.get_field_index("query_hash")).to_pylist()
                    rows.append(_matrix(own))
                elif rows:
                    rows = [np.concatenate(rows)]
                    yield from _closest_entries(own, np.array(names, object), rows[0], threshold)

    # A null name comes last, as it did among sorted entries.
    met = [F.col(c) for c in ("bucket_hash", "part")]
    return asked.unionByName(kept).repartition(*met).sortWithinPartitions(
        *met, "side", F.asc_nulls_last("query_hash")).mapInArrow(run, schema)


def evict(entries: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Keep the newest ``max_entries`` (first in, first out)."""
    return entries.orderBy(F.desc("created_at"), F.desc("query_hash")).limit(max_entries)


def invalidate(entries: DataFrame, kb_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept entries, count of cleared entries) after clearing one knowledge base or everything."""
    hit = F.lit(True) if kb_id is None else F.array_contains("kb_ids", kb_id)
    return entries.filter(~hit), entries.filter(hit).agg(F.count("*").alias("cleared_count"))
