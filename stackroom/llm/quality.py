"""Quality verdicts by distance from language references.

Every document gets two histograms: classes of characters, and common words (with one bin for all others). A language
reference is the sum of these histograms over all documents of that language. A document that is far (Jensen-
Shannon distance) from every reference in either histogram is dropped; histograms of short texts are too
noisy to judge by, so each has a minimum length.

Common words are those with at least ``share`` of a language's words. A word that common has ``share / 2`` of the
words of some slices, and those slices hold all but ``share / 2`` of its own count; so slices report only what has
``share / 2`` there, and words whose reports sum to less than ``share / 2`` are dropped. The at most ``2 / share``
candidates a language that survive, all its common words among them, are counted exactly in a second pass, so the result
does not depend on how the rows are cut into slices. A language has a reference from
``least_words`` words on, whatever its share of the corpus. References are sent to the tasks and each document is compared
with all of them, so the work grows with the number of languages.

Defined results: null and empty texts have no words and fail the base rule (fewer than 50 words); a document whose
language has no reference is judged by the base rule alone; a null language adds to no reference and is judged by all
there are; a corpus without any reference judges by the base rule alone;
repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .textarrays import (BLANK, byte_class, lowered, prefix_sums, slices, span_hashes, spans, sums_by_row, text_bytes,
                         windows)

SHARE = 0.004
#: Words that make a reference: a word with ``share`` of them then occurs 20 times.
LEAST_REFERENCE = 5_000
#: Farthest distance of a good text: a base plus the noise of a histogram of n counts, which falls as 1 / sqrt(n).
MAX_CLASS_DISTANCE = (0.15, 2.0)
MAX_WORD_DISTANCE = (0.20, 1.4)
#: Characters and words below which a histogram isn't judged.
MIN_CHARS = 200
MIN_WORDS = 50
LEAST_WORDS = 50

SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Class of each byte: lower, upper, digit, blank, stops, further ASCII, first byte of another character, its rest.
CLASSES = 7
CLASS = np.full(256, 5, np.int64)
CLASS[byte_class((0x61, 0x7A))] = 0
CLASS[byte_class((0x41, 0x5A))] = 1
CLASS[byte_class((0x30, 0x39))] = 2
CLASS[BLANK] = 3
CLASS[np.frombuffer(b".,;:'\"-", np.uint8)] = 4
CLASS[0xC0:] = 6
CLASS[0x80:0xC0] = 7


def _row_counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[offsets])


def _repeated(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the (row, hash) pair occurs more than once."""
    order = np.lexsort((hashes, rows))
    same = np.zeros(len(order), bool)
    if len(order):
        equal = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        same[1:] = equal
        same[:-1] |= equal
    out = np.zeros(len(order), bool)
    out[order] = same
    return out


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes in each of n rows."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=n)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of each row."""
    n = len(offsets) - 1
    in_word = ~BLANK[data]
    starts, ends, counts = spans(in_word, offsets)
    hashes = span_hashes(sums := prefix_sums(data), starts, ends)
    shingle, at = windows(hashes, counts, 3)
    word_row = np.repeat(np.arange(n), counts)
    at = at[_repeated(word_row[at], shingle)]
    hit = np.zeros(len(starts), bool)
    for k in range(3):
        hit[at + k] = True
    lows, highs, per_row = spans(data != 0x0A, offsets)
    worded = np.searchsorted(starts, highs) > np.searchsorted(starts, lows)
    line_row = np.repeat(np.arange(n), per_row)[worded]
    lines = span_hashes(sums, lows[worded], highs[worded])
    return {"n_words": counts, "word_chars": _row_counts(in_word & ((data & 0xC0) != 0x80), offsets),
            "n_symbols": _row_counts(SYMBOL[data], offsets),
            "n_dup_lines": np.bincount(line_row, minlength=n) - _distinct(line_row, lines, n),
            "n_repeat_words": sums_by_row(hit, counts)}


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = lowered(data)
    starts, ends, counts = spans(~BLANK[low], offsets)
    return span_hashes(prefix_sums(low), starts, ends), starts, ends, counts


def common_words(docs: DataFrame, share: float = SHARE, least_words: int = LEAST_REFERENCE) -> DataFrame:
    """(lang, word hash): the at most 1 / share common words of each language that has ``least_words`` words."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                hashes, _, _, counts = _words(data, offsets)
                langs = part.column("lang").dictionary_encode()
                code = langs.indices.fill_null(-1).to_numpy()
                code = np.repeat(code, counts)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    word, times = np.unique(hashes[code == k], return_counts=True)
                    total = int(times.sum())
                    if not total:
                        continue
                    often = times >= share / 2 * total
                    n = int(often.sum()) + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n, pa.string()),
                         pa.array([None, *word[often].view(np.int64).tolist()], pa.int64()),
                         pa.array([total, *times[often].tolist()], pa.int64())], names=["lang", "word", "times"])

    reports = docs.select("lang", "text").where("lang IS NOT NULL").mapInArrow(
        report, "lang string, word long, times long").groupBy("lang", "word").agg(F.sum("times").alias("times"))
    # A language's own row has no word. Languages are few, and each reports few words.
    total = F.max(F.when(F.col("word").isNull(), F.col("times"))).over(Window.partitionBy("lang"))
    sized = staged(reports.withColumn("total", total))
    candidates = sized.where(F.col("word").isNotNull() & (F.col("times") >= share / 2 * F.col("total")) &
                             (F.col("total") >= least_words)).select("lang", "word", "total").toArrow()
    asked: dict[str, np.ndarray] = {}
    for lang in candidates["lang"].unique().to_pylist():
        asked[lang] = np.sort(candidates.filter(pc.equal(candidates["lang"], lang))["word"].to_numpy().view(np.uint64))
    if not asked:
        return sized.select("lang", "word").limit(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(len(words), np.int64) for lang, words in asked.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                hashes, _, _, counts = _words(data, offsets)
                langs = part.column("lang").dictionary_encode()
                code = np.repeat(langs.indices.to_numpy(), counts)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    own, words = hashes[code == k], asked[lang]
                    at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                    sums[lang] += np.bincount(at[words[at] == own], minlength=len(words))
        for lang, words in asked.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.view(np.int64)),
                                              pa.array(sums[lang])], names=["lang", "word", "n"])

    exact = docs.select("lang", "text").where(F.col("lang").isin(list(asked))).mapInArrow(
        count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = sized.where("word IS NULL").select(F.col("lang").alias("of"), "total")
    return exact.join(F.broadcast(totals), F.col("lang") == F.col("of")).where(
        F.col("n") >= share * F.col("total")).select("lang", "word")


def features(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Base columns and the two histograms of every row; ``vocabulary`` is sorted and bounded."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                n = part.num_rows
                base = base_counts(data, offsets)
                row = np.repeat(np.arange(n), np.diff(offsets))
                classes = np.bincount(row * 8 + CLASS[data], minlength=8 * n).reshape(n, 8)[:, :CLASSES]
                hashes, _, _, counts = _words(data, offsets)
                if len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    known = vocabulary[at] == hashes
                    cell, times = np.unique(np.repeat(np.arange(n), counts)[known] * len(vocabulary) + at[known],
                                            return_counts=True)
                    cell_row, cell_word = np.divmod(cell, len(vocabulary))
                else:
                    times = cell_row = cell_word = np.zeros(0, np.int64)
                edges = pa.array(np.searchsorted(cell_row, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), *[pa.array(v.astype(np.int64)) for v in base.values()],
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CLASSES),
                                              pa.array(classes.ravel().astype(np.int32))),
                     pa.ListArray.from_arrays(edges, pa.array(cell_word.astype(np.int32))),
                     pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32)))],
                    names=["doc_id", "lang", *base, "classes", "words", "times"])

    return docs.select("doc_id", "lang", "text").mapInArrow(
        scan, f"doc_id {id_type}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, classes array<int>, words array<int>, times array<int>")


def _dense(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of class counts and of word counts; the last word bin counts all other words."""
    n = batch.num_rows
    classes = batch.column("classes").flatten().to_numpy().reshape(n, CLASSES).astype(np.float64)
    words = np.zeros((n, width + 1))
    lengths = batch.column("words").value_lengths().to_numpy()
    row = np.repeat(np.arange(n), lengths)
    words[row, batch.column("words").flatten().to_numpy()] = batch.column("times").flatten().to_numpy()
    words[:, width] = batch.column("n_words").to_numpy() - words.sum(axis=1)
    return classes, words


def _pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def references(rows: DataFrame, langs: list[str], width: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms summed over all rows of each listed language (both lists have a bounded length)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), CLASSES + width + 1))
        for batch in batches:
            for part in _pieces(batch):
                classes, words = _dense(part, width)
                lang = np.array(part.column("lang").to_pylist(), object)
                for k, name in enumerate(langs):
                    own = lang == name
                    total[k, :CLASSES] += classes[own].sum(axis=0)
                    total[k, CLASSES:] += words[own].sum(axis=0)
        k, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bin_), pa.array(total[k, bin_])],
                                         names=["lang", "bin", "n"])

    sums = rows.where(F.col("lang").isin(langs)).select("lang", "n_words", "classes", "words", "times").mapInArrow(
        add, "lang long, bin long, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(langs), CLASSES + width + 1))
    table[sums["lang"].to_numpy(), sums["bin"].to_numpy()] = sums["n"].to_numpy()
    return {name: (table[k, :CLASSES], table[k, CLASSES:]) for k, name in enumerate(langs)}


def js_distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts from one row of counts."""
    p = rows / np.maximum(rows.sum(axis=1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def judge(docs: DataFrame, share: float = SHARE, least_words: int = LEAST_REFERENCE,
          max_class: tuple[float, float] = MAX_CLASS_DISTANCE,
          max_word: tuple[float, float] = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS,
          min_words: int = MIN_WORDS) -> DataFrame:
    """Base columns, class_distance, word_distance (to the nearest reference of all), base_failed and kept."""
    vocabulary_rows = common_words(docs, share, least_words).toArrow()
    langs = sorted(set(vocabulary_rows["lang"].to_pylist()))
    vocabulary = np.unique(vocabulary_rows["word"].to_numpy()).view(np.uint64)
    vocabulary.sort()
    rows = staged(features(docs, vocabulary))
    known = references(rows, langs, len(vocabulary)) if langs else {}

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                classes, words = _dense(part, len(vocabulary))
                by_class, by_word = np.zeros(part.num_rows), np.zeros(part.num_rows)
                if known:
                    by_class = np.min([js_distance(classes, c) for c, _ in known.values()], axis=0)
                    by_word = np.min([js_distance(words, w) for _, w in known.values()], axis=0)
                comparable = [lang is None or lang in known for lang in part.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in base] + [pa.array(by_class), pa.array(by_word),
                                                      pa.array(classes.sum(axis=1).astype(np.int64)),
                                                      pa.array(comparable, pa.bool_())],
                    names=[*base, "class_distance", "word_distance", "n_chars", "comparable"])

    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(distances, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in base[1:]) +
                             ", class_distance double, word_distance double, n_chars long, comparable boolean")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def far(column: str, limit: tuple[float, float], n: str, least: int) -> Column:
        return (F.col(n) >= least) & (F.col(column) > limit[0] + limit[1] / F.sqrt(F.greatest(n, F.lit(1))))

    fits = ~far("class_distance", max_class, "n_chars", min_chars) & ~far("word_distance", max_word, "n_words", min_words)
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (fits | ~F.col("comparable"))).drop("comparable")
