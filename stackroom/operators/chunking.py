"""Splitting documents into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, strip, words
from .batches import pieces
from .embed import Embedder, hash_embedder

CHUNK_SIZE = 1024
CHUNK_OVERLAP = 128
MIN_CHUNK_CHARS = 30
CODE_MAX_CHARS = 1500
#: Sentences embedded by one call, or those of one document: tokens that they share are hashed once.
EMBEDDED = 4096

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]))


def word_windows(ws: Column, size: int, overlap: int) -> Column:
    """Array of texts: windows of ``size`` words, each starting ``size - overlap`` after the last."""
    step = size - overlap
    n = F.size(ws)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(ws, i * step + 1, F.lit(size)), " "))


def chunk_fixed(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """(other columns..., pos, text): fixed word windows."""
    keep = [c for c in docs.columns if c != text]
    windows = let(words(F.col(text)), lambda ws: word_windows(ws, size, overlap))
    return docs.select(*keep, F.posexplode(windows).alias("pos", text))


def finalize(chunks: DataFrame, order: list[str], min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Drop short chunks, number the rest from 0 within the document and add the total.

    The chunks of one document are gathered into one array row, numbered there and released again;
    a document's chunks are no larger than its text.
    """
    payload = [c for c in chunks.columns if c != "doc_id" and c not in order]
    kept = chunks.filter(F.length(strip(F.col("text"))) >= min_chars)
    rows = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, *payload))).alias("all"))
    return rows.select("doc_id", F.size("all").alias("total_chunks"),
                       F.posexplode("all").alias("chunk_index", "c")).select(
        "doc_id", *[F.col(f"c.{c}").alias(c) for c in (*order, *payload)], "chunk_index", "total_chunks")


def fixed_chunks(docs: DataFrame, size: int, overlap: int, min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Windows, short ones dropped and the rest renumbered, all inside the document's row."""
    keep = [c for c in docs.columns if c != "text"]
    kept = let(words(F.col("text")), lambda ws: F.filter(
        word_windows(ws, size, overlap), lambda t: F.length(t) >= min_chars))
    rows = docs.select(*keep, kept.alias("all"))
    return rows.select(*keep, F.size("all").alias("total_chunks"), F.posexplode("all").alias("chunk_index", "text"))


# ---- sentences -----------------------------------------------------------------------------------

# What ends a sentence.
SENTENCE_END = r"([.!?。])\s+"


def sentences(text: Column) -> Column:
    """Sentences of a text: a line end, or an end mark followed by white space, closes one."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1\n")
    return F.filter(F.transform(F.split(marked, "\n+"), strip), lambda s: s != "")


def sentence_units(text: Column, size: int) -> Column:
    """Sentences as arrays of words, cut where a single sentence is longer than a chunk."""
    return F.flatten(F.transform(sentences(text), lambda s: let(words(s), lambda ws: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(ws) / F.lit(size)).cast("int") - 1),
        lambda i: F.slice(ws, i * size + 1, F.lit(size))))))


@F.pandas_udf(SPANS)
def _pack_units(lengths: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    """Greedy packing of unit lengths; a chunk starts with the trailing units that fit the overlap."""
    def pack(units, limit, shared):
        spans, start = [], 0
        while start < len(units):
            end, used = start, 0
            while end < len(units) and (end == start or used + units[end] <= limit):
                used += units[end]
                end += 1
            spans.append({"start": start + 1, "n": end - start})
            if end == len(units):
                break
            back, kept = end, 0
            while back - 1 > start and kept + units[back - 1] <= shared and (
                    kept + units[back - 1] + units[end] <= limit):
                back -= 1
                kept += units[back]
            start = back
        return spans

    return pd.Series([pack(u, s, o) for u, s, o in zip(lengths, size, overlap)])


def chunk_recursive(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(other columns..., pos, text): sentences packed up to ``size`` words.

    Only the sentence lengths go to Python; the texts are cut and joined in the JVM.
    """
    keep = [c for c in docs.columns if c != "text"]
    units = docs.select(*keep, sentence_units(F.col("text"), size).alias("units"))
    spans = units.withColumn("spans", _pack_units(F.transform("units", F.size), F.lit(size), F.lit(overlap)))
    texts = F.transform("spans", lambda s: F.array_join(F.flatten(F.slice("units", s["start"], s["n"])), " "))
    return spans.select(*keep, F.posexplode(texts).alias("pos", "text"))


def _adjacent_distances(df: DataFrame, column: str, out: str, fn: Embedder) -> DataFrame:
    """Append the cosine distances of neighbouring texts in an array column."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, column, EMBEDDED)):
            lists = batch.column(batch.schema.get_field_index(column))
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = lists.flatten().to_pylist()
            v = fn(texts) if texts else np.zeros((0, 1))
            row = np.repeat(np.arange(len(counts)), counts)
            # Neighbours in the piece that belong to one row.
            own = row[1:] == row[:-1]
            near = (1.0 - (v[:-1] * v[1:]).sum(axis=1)).round(9)[own]
            ends = np.concatenate(([0], np.cumsum(np.maximum(counts - 1, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(near, pa.float64()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def percentile_of(values: Column, p: float) -> Column:
    """Linearly interpolated percentile of an array."""
    def pick(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(p)
        low = F.floor(at).cast("int")
        a = F.element_at(s, low + 1)
        b = F.element_at(s, F.least(low + 2, F.size(s)))
        return a + (b - a) * (at - low)

    return let(F.array_sort(values), pick)


def chunk_semantic(docs: DataFrame, threshold: float = 0.8, fn: Embedder | None = None) -> DataFrame:
    """(other columns..., pos, text): break where neighbouring sentences differ most.

    Each sentence is embedded together with its neighbours (buffer 1); a break comes after every
    sentence whose distance to the next exceeds the document's percentile. Nothing is shuffled: the
    sentences of a document stay in its row.
    """
    keep = [c for c in docs.columns if c != "text"]
    s = docs.select(*keep, sentences(F.col("text")).alias("sents"))
    s = s.withColumn("around", F.transform("sents", lambda t, i: F.array_join(
        F.slice("sents", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " ")))
    d = _adjacent_distances(s, "around", "dist", fn or hash_embedder()).drop("around")
    limit = F.round(F.when(F.size("dist") > 0, percentile_of(F.col("dist"), threshold)), 9)
    ends = let(limit, lambda most: F.when(F.size("sents") > 0, F.filter(
        F.sequence(F.lit(1), F.size("sents")),
        lambda i: (i == F.size("sents")) | (F.get("dist", i - 1) > most))).otherwise(F.array().cast("array<int>")))
    texts = let(ends, lambda es: F.transform(es, lambda e, k: let(
        F.when(k == 0, F.lit(0)).otherwise(F.get(es, k - 1)),
        lambda b: F.array_join(F.slice("sents", b + 1, e - b), " "))))
    return d.select(*keep, F.posexplode(texts).alias("pos", "text"))


# ---- code ----------------------------------------------------------------------------------------

@F.pandas_udf(SPANS)
def _pack_lines(lines: pd.Series, limit: pd.Series) -> pd.Series:
    """Line packing by characters; ``lines`` holds (length, opens a block) per line."""
    def pack(rows, most):
        spans, start, n = [], 0, len(rows)
        while start < n:
            end, used = start, 0
            while end < n and (end == start or used + rows[end]["n"] + 1 <= most):
                used += rows[end]["n"] + (1 if end > start else 0)
                end += 1
            if end < n:
                better = [i for i in range(start + 1, end + 1) if rows[i]["top"]]
                end = better[-1] if better else end
            spans.append({"start": start + 1, "n": end - start})
            start = end
        return spans

    return pd.Series([pack(r, m) for r, m in zip(lines, limit)])


def chunk_code(docs: DataFrame, max_chars: int = CODE_MAX_CHARS) -> DataFrame:
    """(other columns..., pos, text): whole lines up to ``max_chars``, cut before an unindented line
    where one is at hand. A single longer line is cut by characters."""
    keep = [c for c in docs.columns if c != "text"]
    pieces = F.flatten(F.transform(F.split("text", "\n"), lambda line: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / F.lit(max_chars)).cast("int") - 1, F.lit(0))),
        lambda i: F.struct(F.substring(line, i * max_chars + 1, F.lit(max_chars)).alias("s"), i.alias("part")))))
    d = docs.select(*keep, pieces.alias("lines"))
    shape = F.transform("lines", lambda r: F.struct(
        F.length(r["s"]).alias("n"), ((r["part"] == 0) & ~r["s"].rlike(r"^\s|^$")).alias("top")))
    d = d.withColumn("spans", _pack_lines(shape, F.lit(max_chars)))
    texts = F.transform("spans", lambda s: F.array_join(
        F.transform(F.slice("lines", s["start"], s["n"]), lambda r: r["s"]), "\n"))
    return d.select(*keep, F.posexplode(texts).alias("pos", "text"))


# ---- hierarchy -----------------------------------------------------------------------------------

NODES = "array<struct<level:int,parent:int,text:string>>"


def _children(level: int, size: int, overlap: int, base: Column):
    """Nodes one level below a node; ``base`` is the number of the first node of its level."""
    def split(n: Column, i: Column) -> Column:
        return F.transform(
            let(words(n["text"]), lambda ws: word_windows(ws, size, overlap)),
            lambda t: F.struct(F.lit(level).alias("level"), (base + i).alias("parent"), t.alias("text")))

    return split


def node_tree(text: Column, sizes: list[int], overlap: int) -> Column:
    """All nodes of a text in the order of their numbers, built level by level inside the row."""
    def grow(levels: list[Column]) -> Column:
        k = len(levels)
        if k == len(sizes):
            return F.concat(*levels)
        base = sum((F.size(done) for done in levels[:-1]), F.lit(0))
        below = F.flatten(F.transform(
            levels[-1], _children(k, sizes[k], overlap if k == len(sizes) - 1 else 0, base)))
        return let(below.cast(NODES), lambda nodes: grow([*levels, nodes]))

    roots = F.transform(
        let(words(text), lambda ws: word_windows(ws, sizes[0], 0)),
        lambda t: F.struct(F.lit(0).alias("level"), F.lit(None).cast("int").alias("parent"), t.alias("text")))
    return let(roots.cast(NODES), lambda nodes: grow([nodes]))


def chunk_hierarchical(docs: DataFrame, sizes: list[int], overlap: int) -> DataFrame:
    """(doc_id, other columns..., level, chunk_id, parent_id, node_no, text) of nested word windows.

    Every level splits the texts of the level above, only the last one overlaps, and one counter per
    document numbers the nodes level by level.
    """
    keep = [c for c in docs.columns if c != "text"]
    flat = docs.select(*keep, F.posexplode(node_tree(F.col("text"), sizes, overlap)).alias("i", "n"))
    return flat.select(
        *keep, F.col("n.level").alias("level"), F.concat_ws(":", "doc_id", "i").alias("chunk_id"),
        F.when(F.col("n.parent").isNotNull(), F.concat_ws(":", "doc_id", "n.parent")).alias("parent_id"),
        F.col("i").alias("node_no"), F.col("n.text").alias("text"))


def parent_rows(tree: DataFrame, leaf_level: int, min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Ancestors that still have children: (doc_id, chunk_id, level, parent_id, chunk_index, child_count, text).

    Counted children are leaves that survive the length filter and all ancestors.
    """
    ancestors = tree.filter(F.col("level") < leaf_level)
    kept = tree.filter((F.col("level") < leaf_level) | (F.length(strip(F.col("text"))) >= min_chars))
    counts = kept.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(
        F.count("*").cast("int").alias("child_count"))
    joined = ancestors.join(counts.withColumnRenamed("parent_id", "chunk_id"), "chunk_id")
    per_level = Window.partitionBy("doc_id", "level").orderBy("node_no")
    return joined.withColumn("chunk_index", F.row_number().over(per_level) - 1)


def is_atomic(content_type: Column) -> Column:
    # Content that is one retrieval unit by itself.
    return content_type.isin("table", "image_caption")


def config_violations(configs: DataFrame) -> DataFrame:
    """Bad chunking configurations with a reason: (..., sizes array<int>, overlap) -> plus ``reason``."""
    low, high = F.lit(64), F.lit(8192)
    descending = F.forall(F.sequence(F.lit(1), F.size("sizes") - 1), lambda i: F.coalesce(
        F.get("sizes", i - 1) > F.get("sizes", i), F.lit(False)))
    reason = F.when((F.size("sizes") > 1) & ~descending, "not strictly descending").when(
        F.exists("sizes", lambda s: (s < low) | (s > high)), "size out of range").when(
        (F.col("overlap") < 0) | (F.col("overlap") > F.array_min("sizes") * 0.15), "overlap above 15%")
    return configs.withColumn("reason", reason).filter(F.col("reason").isNotNull())
