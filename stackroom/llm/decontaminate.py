"""Benchmark decontamination over a distributed positional inverted index.

The index is built by segments (a few megabytes of text each): for every token the ascending list of its positions
in the segment. Positions of different documents are parted by a gap, so no phrase crosses documents. Index rows
are written out once; frequencies come from the list lengths.

A test window becomes its terms ordered from the rarest. Index rows of a window's rarest term name the segments where
it can occur; there, the position lists of its terms, each shifted by the term's offset, are intersected in that
order until nothing is left or all terms agree. ``slop`` 0 gives exact phrases, more gives proximity matches (each
term at most that far from its place).

Tokens that no benchmark item holds aren't indexed. They are recognised by a bitmap of fixed size (2^20 bits),
which a larger benchmark fills until it passes everything: the index grows, the result stays the same.

Defined results: null and empty texts have no words and no hits; items without words have no window; a repeated item
counts once, an item without id marks words but isn't listed; repeated documents are rows of their own; empty
documents give no rows, an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .textarrays import NOT_ALNUM, lowered, prefix_sums, slices, span_hashes, spans, text_bytes

WINDOW = 13
SEGMENT_BYTES = 2 << 20
FILTER_BITS = 20


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, counts = spans(~NOT_ALNUM[data], offsets)
    return span_hashes(prefix_sums(data), starts, ends), counts


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def test_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, terms array<long>): every window of every item; a shorter item is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = _tokens(part.column("text"))
                n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
                row = np.repeat(np.arange(len(counts)), n)
                first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(counts) - counts)[row]
                width = np.minimum(counts, size)[row]
                edges = np.zeros(len(row) + 1, np.int32)
                np.cumsum(width, out=edges[1:])
                at = np.repeat(first, width) + np.arange(edges[-1]) - np.repeat(edges[:-1], width)
                terms = pa.ListArray.from_arrays(pa.array(edges), pa.array(hashes[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), terms],
                                                 names=["item_id", "terms"])

    id_type = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(cut, f"item_id {id_type}, terms array<long>")


def build_index(docs: DataFrame, slots: list[int], gap: int = WINDOW) -> DataFrame:
    """Rows of two kinds. Token rows: (segment, token, places). Document rows (token null): (segment, row, doc_id,
    n_words, places = [first position]). ``slots`` are the set bits of the token filter."""
    passes = np.zeros(1 << FILTER_BITS, bool)
    passes[slots] = True
    id_type = docs.schema["doc_id"].dataType
    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                hashes, counts = _tokens(part.column("text"))
                n = len(counts)
                first = np.cumsum(counts) - counts + gap * np.arange(n)
                place = np.arange(len(hashes)) + gap * np.repeat(np.arange(n), counts)
                known = passes[_slot(hashes)]
                token, place = hashes[known], place[known]
                order = np.argsort(token, kind="stable")
                token, place = token[order], place[order]
                begins = np.flatnonzero(np.diff(token, prepend=~token[:1]))
                edges = np.concatenate([np.arange(n), n + begins, [n + len(place)]]).astype(np.int32)
                names = pa.array(token[begins].view(np.int64))
                m = len(begins)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n + m, segment)),
                     pa.concat_arrays([pa.nulls(n, pa.int64()), names]),
                     pa.concat_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.nulls(m, pa.int32())]),
                     pa.concat_arrays([part.column("doc_id"), pa.nulls(m, id_arrow)]),
                     pa.concat_arrays([pa.array(counts.astype(np.int64)), pa.nulls(m, pa.int64())]),
                     pa.ListArray.from_arrays(pa.array(edges),
                                              pa.array(np.concatenate([first, place]).astype(np.int32)))],
                    names=["segment", "token", "row", "doc_id", "n_words", "places"])
                segment += 1

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"segment long, token long, row int, doc_id {id_type.simpleString()}, n_words long, places array<int>")


def _intersect(lists: dict[int, np.ndarray], terms: list[dict], slop: int) -> np.ndarray:
    """Starts at which all terms agree, beginning with the rarest."""
    starts = None
    for term in terms:
        places = lists.get(term["token"])
        if places is None:
            return np.zeros(0, np.int64)
        shifted = places - term["offset"]
        if starts is None:
            starts = shifted
            continue
        at = np.searchsorted(shifted, starts - slop)
        inside = at < len(shifted)
        starts, at = starts[inside], at[inside]
        starts = starts[shifted[at] <= starts + slop]
        if not len(starts):
            break
    return starts


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document: (segment, row, doc_id, n_words, n_hit, items array<string>, matches array<struct<window, start>>).

    n_hit counts the words inside any occurrence of a window; a match's start is the word it begins at.
    """
    found = staged(test_windows(benchmark, size).withColumn("window", F.xxhash64("terms")))
    slots = found.select(F.explode("terms").alias("t")).select(
        F.shiftrightunsigned("t", 64 - FILTER_BITS).cast("int").alias("slot")).distinct().toArrow()["slot"].to_pylist()
    index = staged(build_index(docs, slots, max(size, 1) + slop))
    frequency = index.where("token IS NOT NULL").groupBy("token").agg(
        F.sum(F.size("places")).alias("df"))
    terms = found.dropDuplicates(["window"]).select("window", F.posexplode("terms").alias("offset", "token"))
    # A window with a term that no document has is dropped: its count of known terms falls short.
    ordered = terms.join(frequency, "token").groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct("df", "offset", "token"))).alias("terms")).join(
        found.dropDuplicates(["window"]).select("window", F.size("terms").alias("width")), "window").where(
        F.size("terms") == F.col("width"))
    rarest = ordered.select("window", "terms", F.col("terms")[0]["token"].alias("token"))
    asked = index.where("token IS NOT NULL").select("segment", "token").join(rarest, "token").select(
        F.col("segment").alias("asked"), "window", F.transform("terms", lambda t: F.struct(
            t["offset"].alias("offset"), t["token"].alias("token"))).alias("terms"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        token_row = left["token"].is_valid()
        words = left.filter(token_row)
        own = left.filter(left["token"].is_null()).sort_by("row")
        places = words["places"].combine_chunks()
        values, edges = places.values.to_numpy(), places.offsets.to_numpy()
        lists = {t: values[a:b] for t, a, b in zip(words["token"].to_pylist(), edges[:-1].tolist(), edges[1:].tolist())}
        first = own["places"].combine_chunks().flatten().to_numpy()
        n = len(first)
        n_words = own["n_words"].to_numpy()
        span = int(first[-1] + n_words[-1] + size + slop + 1) if n else 1
        change = np.zeros(span + 1, np.int32)
        rows, wins, starts = [], [], []
        for window, terms_ in zip(right["window"].to_pylist(), right["terms"].to_pylist()):
            at = _intersect(lists, terms_, slop)
            if len(at):
                np.add.at(change, np.maximum(at, 0), 1)
                np.add.at(change, np.minimum(at + len(terms_), span), -1)
                rows.append(np.searchsorted(first, at + slop, "right") - 1)
                wins.append(np.full(len(at), window))
                starts.append(at)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
        n_hit = covered[first + n_words] - covered[first]
        if rows:
            row, win, start = np.concatenate(rows), np.concatenate(wins), np.concatenate(starts)
            start = start - first[row]
            order = np.lexsort((start, row))
            row, win, start = row[order], win[order], start[order]
        else:
            row = win = start = np.zeros(0, np.int64)
        edge = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        match = pa.StructArray.from_arrays([pa.array(win), pa.array(start.astype(np.int64))], ["window", "start"])
        return pa.table({"segment": own["segment"], "row": own["row"], "doc_id": own["doc_id"],
                         "n_words": own["n_words"], "n_hit": pa.array(n_hit.astype(np.int64)),
                         "matches": pa.ListArray.from_arrays(edge, match)})

    hits = staged(index.groupBy("segment").cogroup(asked.groupBy("asked")).applyInArrow(
        answer, f"segment long, row int, doc_id {id_type}, n_words long, n_hit long, "
                "matches array<struct<window: long, start: long>>"))
    of_window = found.where("item_id IS NOT NULL").select(
        "window", F.col("item_id").cast("string").alias("item")).distinct()
    items = (hits.where("n_hit > 0").select("segment", "row", F.explode(F.array_distinct(F.transform(
        "matches", lambda m: m["window"]))).alias("window")).join(of_window, "window")
        .groupBy("segment", "row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    return hits.join(items, ["segment", "row"], "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<string>")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, matches, contaminated): hit at all, and in at least a twentieth of the words."""
    return find(docs, benchmark, size).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("segment", "row")


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated. Rows that share an id share the verdict of the worst of them; rows
    without an id are kept, as a verdict can't name them."""
    bad = contamination(docs, benchmark, size).where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
