"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters becomes one vector: the letters' vectors,
rotated by their place in the run, multiplied (binding). The vectors of all runs of a text are added (bundling);
the vectors of all texts of a language add up to its prototype. A text gets the language whose prototype
has the highest cosine with the text's own vector.

A run that occurs often is bound once and weighted by its count, which gives the same sum. Prototypes are sums
over all learning rows, made per task and then added; each has ``dimensions`` numbers. Their number is that of the
labels in ``lang``; above ``max_languages`` the job stops with an error instead of sending a table of unknown size.

Runs are taken from lower-cased words, with a blank at either end; digits and signs are left out.

Defined results: ``und`` with score 0 for a null text, a text without letters, and any text if nothing could
be learned; rows with a null ``lang`` are not learned from; ties go to the first language in code point
order; repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import slices

DIMENSIONS = 1024
MAX_LANGUAGES = 512
RUN = 3
SEED = 7
#: Bytes of text and rows taken apart at once: four bytes a character, and a row of counts for each text.
PART_BYTES = 1 << 19
PART_ROWS = 512


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, dimensions, np.int8) * 2 - 1


class Profiles:
    """Vectors of texts; letters met before are kept, bounded by the code points of the text."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.letters: dict[int, list[np.ndarray]] = {}

    def _rotated(self, codes: np.ndarray, place: int) -> np.ndarray:
        values, at = np.unique(codes, return_inverse=True)
        rows = []
        for code in values.tolist():
            if code not in self.letters:
                own = letter_vector(code, self.dimensions)
                self.letters[code] = [np.roll(own, RUN - 1 - k) for k in range(RUN)]
            rows.append(self.letters[code][place])
        return np.array(rows, np.int8).reshape(-1, self.dimensions)[at]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each text, and whether it has a letter."""
        n = len(texts)
        vectors, lettered = np.zeros((n, self.dimensions), np.float32), np.zeros(n, bool)
        words = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")),
                                           r"[^\p{L}\p{M}]+", " ")
        points = np.frombuffer("\0".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        # Texts are parted by 0; every text begins and ends with a blank for its outer words.
        points = np.concatenate([[0], points, [0]])
        text = np.cumsum(points == 0) - 1
        points = np.where(points == 0, 0x20, points)
        a, b, c = points[:-2], points[1:-1], points[2:]
        whole = b != 0x20
        run, row = (a << 42 | b << 21 | c)[whole], text[1:-1][whole]
        lettered[np.unique(row)] = True
        kinds, at = np.unique(run, return_inverse=True)
        for low in range(0, len(kinds), 4096):
            part = kinds[low:low + 4096]
            bound = (self._rotated(part >> 42, 0) * self._rotated(part >> 21 & 0x1FFFFF, 1)
                     * self._rotated(part & 0x1FFFFF, 2)).astype(np.float32)
            own = (at >= low) & (at < low + 4096)
            counts = np.bincount(row[own] * len(part) + at[own] - low, minlength=n * len(part))
            vectors += counts.reshape(n, len(part)).astype(np.float32) @ bound
        return vectors, lettered


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text", PART_BYTES):
        for low in range(0, part.num_rows, PART_ROWS):
            yield part.slice(low, PART_ROWS)


def learn(rows: DataFrame, dimensions: int = DIMENSIONS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Language names in code point order and their prototypes, from (lang, text)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions), {}
        for batch in batches:
            for part in _parts(batch):
                vectors, _ = profiles.of(part.column("text"))
                langs = np.array(part.column("lang").to_pylist(), object)
                for name in set(langs.tolist()):
                    sums[name] = sums.get(name, 0) + vectors[langs == name].astype(np.float64).sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                names=["lang", "sums"])

    known = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    partial = known.mapInArrow(add, "lang string, sums array<double>")
    merged = partial.select("lang", F.posexplode("sums").alias("at", "value")).groupBy("lang", "at").agg(
        F.sum("value").alias("value")).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells")).select(
        "lang", F.transform("cells", lambda c: c["value"]).alias("sums"))
    found = sorted(merged.limit(max_languages + 1).collect(), key=lambda r: r["lang"].encode())
    if len(found) > max_languages:
        raise ValueError(f"lang has more than {max_languages} values; name a larger max_languages")
    names = [r["lang"] for r in found]
    table = np.array([r["sums"] for r in found], np.float64).reshape(len(names), dimensions)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return names, (table / np.where(norms > 0, norms, 1)).astype(np.float32)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """The rows' doc_id with lang_pred and score (cosine, negative ones as 0)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(prototypes.shape[1])
        for batch in batches:
            for part in _parts(batch):
                vectors, lettered = profiles.of(part.column("text"))
                if names:
                    norm = np.linalg.norm(vectors, axis=1)
                    cosine = (vectors @ prototypes.T) / np.where(norm > 0, norm, 1)[:, None]
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                    pred = np.where(lettered, np.array(names, object)[best], "und")
                    score = np.where(lettered, score, 0.0)
                else:
                    pred, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred.tolist(), pa.string()),
                                                  pa.array(score.astype(np.float64))],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning; a row without id takes part in learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that aren't held out."""
    names, prototypes = learn(docs.where(~held_out(F.col("doc_id"))), dimensions)
    return identify(docs, names, prototypes).withColumn("held_out", held_out(F.col("doc_id")))
