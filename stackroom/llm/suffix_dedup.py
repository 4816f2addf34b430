"""Removal of long repeated strings with a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. The steps:

1. Suffixes. Every window of ``length`` bytes has an anchor: the place of its smallest hash among all runs of ``GRAM``
   bytes in it. Equal windows have their anchors at equal places, so only the suffixes that begin at anchors (about
   one byte in eighty) are sorted; each stands for the windows around it and carries the bytes to its left.
2. Distinguishing prefixes. A suffix whose first ``GRAM`` bytes occur once in the corpus can't be in a repeat and is not
   exchanged. Hashes of these prefixes are counted in buckets of bounded size.
3. Runs. A segment (a few megabytes of text) sorts its remaining suffixes, folds equal ones into one entry with
   a list of places, front-codes the sorted run (length of the prefix shared with the entry before, then the rest) and
   sends each range of it to that range's task. A passage that a third of all documents share is one entry per segment.
4. Merge. A range's task merges its runs with a loser tree that keeps, for every run's head, the length of the prefix it
   shares with the last winner: heads with different lengths are ordered without looking at a byte, and equal
   ones are compared from that length on. The merge yields the sorted suffixes with their common-prefix lengths.
5. Windows. The window that begins d bytes left of an anchor repeats if another entry shares ``length - d`` bytes to
   the right (no smaller common-prefix length between them in suffix order) and d bytes to the left (likewise in the
   order of reversed left parts). The windows of one anchor all cover it, so their union is one span.

Segments are stored compressed; each of the two later passes over the texts moves them in this form.

Defined results: a null text counts as empty; a text shorter than ``length`` loses nothing; matches never cross rows;
repeated rows are repeats of each other and lose all bytes if long enough; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .textarrays import prefix_sums, slices, span_hashes, text_bytes

LENGTH = 200
GRAM = 40
SEGMENT_BYTES = 2 << 20
#: Prefix hashes counted by one task, and bytes of suffixes merged by one task.
BUCKET_HASHES = 1 << 20
RANGE_ENTRIES = 40_000
_ZSTD = "zstd"


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec=_ZSTD, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec=_ZSTD, asbytes=True) if size else b""


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of values[i:i + width] for every i where that fits."""
    done = 1
    while done * 2 <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    return best(values[:len(values) - (width - done)], values[width - done:]) if width > done else values


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows, and the hashes of the ``gram`` bytes there."""
    width = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(len(data) - gram + 1)
    hashes = span_hashes(prefix_sums(data), start, start + gram) | np.uint64(1)
    low = _slide(hashes, width, np.minimum)
    fits = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    fits[offsets[long]] += 1
    fits[offsets[long + 1] - length + 1] -= 1
    low = np.where(np.cumsum(fits)[:n] > 0, low, np.uint64(0))
    # A place is an anchor if its hash is the smallest of some window over it, that is, the largest of those minima.
    reach = np.zeros(n + 2 * (width - 1), np.uint64)
    reach[width - 1:width - 1 + n] = low
    at = np.flatnonzero(_slide(reach, width, np.maximum) == hashes)
    return at, hashes[at]


def cut_segments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(segment, ids, sizes, text, places, hashes, keys): the texts of a few megabytes of rows and their anchors."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                data, offsets = text_bytes(part.column("text"))
                at, hashes = anchors(data, offsets, length, gram)
                key = np.zeros(len(at), np.uint64)
                for k in range(8):
                    key = key << np.uint64(8) | data[at + k].astype(np.uint64)

                def one(values: pa.Array) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment]), one(part.column("doc_id")), one(pa.array(np.diff(offsets))),
                     pa.array([_packed(data.tobytes())], pa.binary()), one(pa.array(at.astype(np.int32))),
                     one(pa.array(hashes.view(np.int64))),
                     one(pa.array(np.sort(key >> np.uint64(1))[::64].view(np.int64)))],
                    names=["segment", "ids", "sizes", "text", "places", "hashes", "keys"])
                segment += 1

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"segment long, ids array<{id_type}>, sizes array<long>, text binary, places array<int>, "
              "hashes array<long>, keys array<long>")


def repeated_prefixes(segments: DataFrame) -> DataFrame:
    """(segment, repeated): per segment the prefix hashes that occur more than once in the corpus."""
    total = segments.agg(F.sum(F.size("hashes")).alias("n")).first()["n"] or 0
    n_buckets = total // BUCKET_HASHES + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, hashes in zip(batch.column("segment").to_pylist(), batch.column("hashes")):
                value, times = np.unique(hashes.values.to_numpy().view(np.uint64), return_counts=True)
                bucket = (value >> np.uint64(20)) % np.uint64(n_buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, value, times = bucket[order], value[order], times[order]
                begins = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
                edges = pa.array(np.append(begins, len(value)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begins].astype(np.int64)), pa.array(np.full(len(begins), segment)),
                     pa.ListArray.from_arrays(edges, pa.array(value.view(np.int64))),
                     pa.ListArray.from_arrays(edges, pa.array(times > 1))],
                    names=["bucket", "segment", "hashes", "again"])

    def count(table: pa.Table) -> pa.Table:
        hashes = table["hashes"].combine_chunks()
        again = table["again"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        lengths = hashes.value_lengths().to_numpy()
        values = hashes.flatten().to_numpy()
        _, at, times = np.unique(values, return_inverse=True, return_counts=True)
        twice = np.bincount(at, again, len(times)) + times > 1
        keep = twice[at]
        row = np.repeat(np.arange(len(lengths)), lengths)[keep]
        edges = pa.array(np.searchsorted(row, np.arange(len(lengths) + 1)).astype(np.int32))
        return pa.table({"segment": table["segment"],
                         "hashes": pa.ListArray.from_arrays(edges, pa.array(values[keep]))})

    dealt = segments.select("segment", "hashes").mapInArrow(
        deal, "bucket long, segment long, hashes array<long>, again array<boolean>")
    return dealt.groupBy("bucket").applyInArrow(count, "segment long, hashes array<long>").groupBy(
        F.col("segment").alias("of")).agg(F.flatten(F.collect_list("hashes")).alias("repeated"))


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, ``known`` bytes of which are known to be equal."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 8
    while a[low:low + step] == b[low:low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_coded(run: list[tuple[bytes, bytes, list[int]]]) -> bytes:
    """A sorted run of (right, left, places): shared lengths, lengths, rests and places, compressed."""
    shared, rests, last = bytearray(), [], b""
    for right, _, _ in run:
        n = _common(last, right, 0)
        shared.append(n)
        rests.append(right[n:])
        last = right
    counts = np.array([len(p) for _, _, p in run], np.uint32)
    places = np.fromiter(chain.from_iterable(p for _, _, p in run), np.uint32, int(counts.sum()))
    return _packed(b"".join([len(run).to_bytes(4, "little"), bytes(shared), bytes(map(len, rests)),
                             bytes(len(left) for _, left, _ in run), counts.tobytes(), places.tobytes(),
                             *rests, *[left for _, left, _ in run]]))


def decoded(blob: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray, np.ndarray]:
    """Rights, shared lengths, lefts, place counts and places of a front-coded run."""
    data = _unpacked(blob)
    n = int.from_bytes(data[:4], "little")
    shared, rest, left = data[4:4 + n], data[4 + n:4 + 2 * n], data[4 + 2 * n:4 + 3 * n]
    at = 4 + 3 * n
    counts = np.frombuffer(data, np.uint32, n, at).astype(np.int64)
    at += 4 * n
    places = np.frombuffer(data, np.uint32, int(counts.sum()), at).astype(np.int64)
    at += 4 * len(places)
    rights, lefts, last = [], [], b""
    for keep, size in zip(shared, rest):
        last = last[:keep] + data[at:at + size]
        rights.append(last)
        at += size
    for size in left:
        lefts.append(data[at:at + size])
        at += size
    return rights, list(shared), lefts, counts, places


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Loser-tree merge of sorted runs whose entries know the prefix they share with the entry before them.

    Gives the run and the index of each entry in merged order, and the prefix it shares with the entry before it.
    """
    k = len(runs)
    position = [0] * k
    # Per run: its head, and the length of the prefix the head shares with the last entry put out.
    head = [r[0] if r else None for r in runs]
    known = [0] * k
    size = 1
    while size < k:
        size *= 2
    head += [None] * (size - k)
    known += [0] * (size - k)
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = _common(x, y, known[a])
        if x[n:n + 1] <= y[n:n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        fresh = []
        for i in range(0, level, 2):
            w, l = play(winners[i], winners[i + 1])
            losers[(level + i) // 2] = l
            fresh.append(w)
        winners, level = fresh, level // 2
    best = winners[0]
    of_run, of_index, lengths = [], [], []
    while head[best] is not None:
        i = position[best]
        of_run.append(best)
        of_index.append(i)
        lengths.append(known[best])
        position[best] = i = i + 1
        if i < len(runs[best]):
            head[best], known[best] = runs[best][i], shared[best][i]
        else:
            head[best] = None
        node = (best + size) // 2
        while node:
            w, l = play(best, losers[node])
            best, losers[node] = w, l
            node //= 2
    return of_run, of_index, lengths


def repeated_windows(right_common: np.ndarray, lefts: list[bytes], right_sizes: np.ndarray, weight: np.ndarray,
                     length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest d for which the window beginning d bytes left of an entry repeats; -1 for none.

    ``right_common``: the prefix shared with the entry before, in suffix order. ``weight``: places of an entry.
    """
    n = len(lefts)
    backward = [left[::-1] for left in lefts]
    order = sorted(range(n), key=backward.__getitem__)
    left_common = np.zeros(n, np.int64)
    for i in range(1, n):
        left_common[i] = _common(backward[order[i - 1]], backward[order[i]], 0)
    order = np.array(order, np.int64)
    left_sizes = np.array([len(x) for x in lefts], np.int64)
    low, high = np.full(n, -1), np.full(n, -1)
    left_class = np.empty(n, np.int64)
    for d in range(length - gram + 1):
        fits = np.flatnonzero((left_sizes >= d) & (right_sizes >= length - d))
        left_class[order] = np.cumsum(left_common < d)
        cell = np.cumsum(right_common < length - d)[fits] * (n + 1) + left_class[fits]
        _, at = np.unique(cell, return_inverse=True)
        found = fits[np.bincount(at, weight[fits])[at] > 1] if len(fits) else fits
        low[found[low[found] < 0]] = d
        high[found] = d
    return low, high


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The stored segments, and (segment, begins, ends): spans of repeated bytes, in bytes of the segment."""
    if length > 255 or not 8 <= gram <= length:
        raise ValueError("lengths are kept in one byte, and the range key takes eight bytes")
    segments = staged(cut_segments(docs, length, gram))
    repeated = repeated_prefixes(segments)
    n_keys = segments.agg(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    n_ranges = min(n_keys // RANGE_ENTRIES + 1, 10_000)
    cuts = segments.select(F.explode("keys").alias("key")).agg(F.percentile_approx(
        "key", [i / n_ranges for i in range(1, n_ranges)] or [0.5], 10 * n_ranges).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(cuts or [], np.int64))
    far = length - gram

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = _unpacked(batch.column("text")[row].as_py())
                data = np.frombuffer(text, np.uint8)
                places = batch.column("places")[row].values.to_numpy().astype(np.int64)
                mine = batch.column("repeated")[row].values.to_numpy().view(np.uint64)
                own = span_hashes(prefix_sums(data), places, places + gram) | np.uint64(1)
                places = places[np.isin(own, mine)]
                offsets = np.concatenate([[0], np.cumsum(batch.column("sizes")[row].values.to_numpy())])
                doc = np.searchsorted(offsets, places, "right") - 1
                low = np.maximum(places - far, offsets[doc])
                high = np.minimum(places + length, offsets[doc + 1])
                entries: dict[tuple[bytes, bytes], list[int]] = {}
                for a, l, h in zip(places.tolist(), low.tolist(), high.tolist()):
                    entries.setdefault((text[a:h], text[l:a]), []).append(a)
                run = [(right, left, entries[right, left]) for right, left in sorted(entries)]
                key = np.array([int.from_bytes(r[0][:8], "big") >> 1 for r in run], np.int64)
                bounds = [0, *np.searchsorted(key, cuts, "left").tolist(), len(run)]
                segment = batch.column("segment")[row].as_py()
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    if a < b:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k]), pa.array([segment]), pa.array([front_coded(run[a:b])], pa.binary())],
                            names=["range", "segment", "run"])

    def solve(table: pa.Table) -> pa.Table:
        parts = [decoded(blob) for blob in table["run"].to_pylist()]
        of_run, of_index, common = merge([p[0] for p in parts], [p[1] for p in parts])
        common = np.array(common, np.int64)
        weight = np.array([parts[r][3][i] for r, i in zip(of_run, of_index)], np.int64)
        # An entry alone with its prefix, at one place, is met by no other.
        following = np.append(common[1:], 0)
        met = np.flatnonzero((np.maximum(common, following) >= gram) | (weight > 1))
        # Entries left out have no prefix in common with those kept, so the lengths between those stay right.
        lefts = [parts[of_run[i]][2][of_index[i]] for i in met.tolist()]
        sizes = np.array([len(parts[of_run[i]][0][of_index[i]]) for i in met.tolist()], np.int64)
        low, high = repeated_windows(np.where(common[met] >= gram, common[met], 0), lefts, sizes, weight[met], length, gram)
        bounds = [np.full((len(p[0]), 2), -1) for p in parts]
        for i, a, b in zip(met.tolist(), low.tolist(), high.tolist()):
            bounds[of_run[i]][of_index[i]] = a, b
        begins, ends = [], []
        for part, bound in zip(parts, bounds):
            each = np.repeat(bound, part[3], axis=0)
            hit = each[:, 0] >= 0
            begins.append(part[4][hit] - each[hit, 1])
            ends.append(part[4][hit] - each[hit, 0] + length)
        edges = pa.array(np.cumsum([0, *map(len, begins)]).astype(np.int32))
        return pa.table({"segment": table["segment"],
                         "begins": pa.ListArray.from_arrays(edges, pa.array(np.concatenate(begins).astype(np.int32))),
                         "ends": pa.ListArray.from_arrays(edges, pa.array(np.concatenate(ends).astype(np.int32)))})

    sent = segments.select("segment", "sizes", "text", "places").join(
        repeated, F.col("segment") == F.col("of")).select("segment", "sizes", "text", "places", "repeated").mapInArrow(
        runs, "range long, segment long, run binary")
    spans = sent.groupBy("range").applyInArrow(solve, "segment long, begins array<int>, ends array<int>")
    return segments, staged(spans.where(F.size("begins") > 0).groupBy(F.col("segment").alias("of")).agg(
        F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with ``keep`` also kept (the remaining bytes)."""
    segments, spans = repeat_spans(docs, length, gram)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(_unpacked(batch.column("text")[row].as_py()), np.uint8)
                sizes = batch.column("sizes")[row].values.to_numpy()
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                change = np.zeros(len(data) + 1, np.int32)
                if batch.column("begins")[row].is_valid:
                    np.add.at(change, batch.column("begins")[row].values.to_numpy(), 1)
                    np.add.at(change, batch.column("ends")[row].values.to_numpy(), -1)
                gone = np.cumsum(change)[:-1] > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < len(data)]
                first[inner] = gone[inner]
                removed = np.concatenate([[0], np.cumsum(gone)])
                n_spans = np.concatenate([[0], np.cumsum(first)])
                left = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                columns = [batch.column("ids")[row].values, pa.array(sizes), pa.array(np.diff(removed[offsets])),
                           pa.array(np.diff(n_spans[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(left, pa.binary())] if keep else []), names=names)

    return segments.select("segment", "ids", "sizes", "text").join(spans, F.col("segment") == F.col("of"), "left").select(
        "ids", "sizes", "text", "begins", "ends").mapInArrow(
        cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
