"""Substring dedup with content-defined chunks.

A gear rolling hash (every byte has a random number; the hash shifts left and adds the number of the next byte) ends a
chunk wherever five of its bits are zero. Those bits depend on the last 16 bytes only, so an insertion moves the
ends near it and no others, and equal passages are cut alike wherever they stand. Chunks average 32 bytes.

Each chunk is known by its digest. The first row of a digest keeps it (rows in order of reading, the first of
equal chunks within a row); every other chunk of that digest is a repeat. Short chunks repeat by chance, so repeats are
removed only where neighbouring ones add up to ``min_span`` bytes.

Rows keep their digests in one array. Digests meet as (digest, row) pairs, once per row, aggregated before the
shuffle; only digests found in several rows go back to their rows.

Defined results: null and empty texts have no chunks; repeats never cross rows; repeated rows are copies of each
other, all but the first lose their chunks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .textarrays import slices, text_bytes

#: Bytes that decide about a chunk's end, and the bits looked at: the highest that they fill.
REACH = 16
END_BITS = np.uint32(0b11111 << 11)
MIN_SPAN = 64
GEAR = np.random.default_rng(16).integers(0, 1 << 32, 256, np.uint32)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks, in bytes of the whole array; every row ends its last chunk."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # Rows are set apart by REACH zeros: nothing of the row before enters a hash.
    place = np.arange(len(data)) + REACH * (row + 1)
    h = np.zeros(len(data) + REACH * (len(sizes) + 1), np.uint32)
    h[place] = GEAR[data]
    done = 1
    while done < REACH:
        shifted = np.zeros_like(h)
        shifted[done:] = h[:-done] << np.uint32(done)
        h += shifted
        done *= 2
    last = (h[place] & END_BITS) == 0
    last[offsets[1:][sizes > 0] - 1] = True
    return np.flatnonzero(last) + 1


def chunked(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(row_id, doc_id, digests, sizes[, text]) of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                ends = chunk_ends(data, offsets)
                begins = np.append(0, ends[:-1]) if len(ends) else ends
                view, digest = memoryview(data.tobytes()), xxhash.xxh3_64_intdigest
                digests = np.fromiter((digest(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist())),
                                      np.uint64, len(ends))
                edges = pa.array(np.searchsorted(ends, offsets, "right").astype(np.int32))
                n = part.num_rows
                columns = [pa.array(np.arange(row_id, row_id + n)), part.column("doc_id"),
                           pa.ListArray.from_arrays(edges, pa.array(digests.view(np.int64))),
                           pa.ListArray.from_arrays(edges, pa.array((ends - begins).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns + ([part.column("text")] if keep_text else []),
                                                 names=["row_id", "doc_id", "digests", "sizes"] + ["text"] * keep_text)
                row_id += n

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"row_id long, doc_id {id_type}, digests array<long>, sizes array<int>" + ", text string" * keep_text)


def remove_repeats(docs: DataFrame, min_span: int = MIN_SPAN, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_repeats, n_removed, n_spans, spans[, kept]): spans are [start, end) in bytes, kept
    the bytes that remain."""
    rows = staged(chunked(docs, keep_text))
    pairs = rows.select("row_id", F.explode(F.array_distinct("digests")).alias("digest"))
    firsts = pairs.groupBy(F.col("digest").alias("known")).agg(
        F.min("row_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = pairs.join(firsts, (F.col("digest") == F.col("known")) & (F.col("row_id") > F.col("first"))).groupBy(
        F.col("row_id").alias("of")).agg(F.collect_list("digest").alias("repeated"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_chunks", "n_repeats", "n_removed", "n_spans", "spans"] + ["kept"] * keep_text

    def judge(digests: np.ndarray, sizes: np.ndarray, repeated: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        again = np.isin(digests, repeated)
        _, first = np.unique(digests, return_index=True)
        own = np.ones(len(digests), bool)
        own[first] = False
        again |= own
        at = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
        start, end = at[np.flatnonzero(edge == 1)], at[np.flatnonzero(edge == -1)]
        wide = end - start >= min_span
        return int(again.sum()), start[wide], end[wide]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, starts, ends, counts, kept = [], [], [], [0], []
            for row in range(batch.num_rows):
                digests, sizes = (batch.column(c)[row].values.to_numpy() for c in ("digests", "sizes"))
                known = batch.column("repeated")[row]
                n, start, end = judge(digests, sizes, known.values.to_numpy() if known.is_valid else digests[:0])
                out.append((int(sizes.sum()), len(sizes), n, int((end - start).sum()), len(start)))
                starts.append(start)
                ends.append(end)
                counts.append(counts[-1] + len(start))
                if keep_text:
                    text = (batch.column("text")[row].as_py() or "").encode()
                    edge = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2])))
            if not out:
                continue
            span = pa.StructArray.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in (starts, ends)],
                                              ["start", "end"])
            columns = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*out)],
                       pa.ListArray.from_arrays(pa.array(counts, pa.int32()), span)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_text else []), names=names)

    return rows.join(later, F.col("row_id") == F.col("of"), "left").drop("row_id", "of").mapInArrow(
        cut, f"doc_id {id_type}, n_bytes long, n_chunks long, n_repeats long, n_removed long, n_spans long, "
             "spans array<struct<start: long, end: long>>" + ", kept binary" * keep_text)
