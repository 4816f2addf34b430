"""Language-model scores from Brown's class-based bigrams.

Words are counted over all training rows. A word with more than 1 / ``SHARE`` of the training tokens (fewer than
``SHARE`` words are) is a unit of its own; all other words, however rare or new, belong to the unit of their last two bytes; the
end of a text is one more unit. So there are at most SHARE + 65,537 units, every token belongs to one, and the
tasks can hold a class for each. The numbers of all pairs of neighbouring units are counted over all training rows and stored,
filed under either unit.

Exchange clustering: units start in classes by rank. In a round every unit's neighbours are counted by class; for
each unit of the round's share, the class in which the likelihood of the class bigrams is highest is found with all other units as they
are, and the unit moves there. Units move at the same time, so a round may overshoot: then its moves are taken
back and the next round moves half as many; after a round that holds, it is twice as many again. The end keeps a class of its own.

A text starts after an end, and has ``p(class | class before) * p(word | class)`` for each token. Transitions are smoothed by
``STRENGTH`` tokens of the class distribution; of every word's count a discount goes to the unknown words of its class, so
the probabilities of all words of the training rows and of one unknown word per class add up to 1.

Counts of frequent words go to the tasks with the units; rare words of a text move to their counts, by their bytes (words of more
than 32 bytes by a digest). Within a slice of a task, and among frequent words, words are told apart by 64-bit hashes. Texts of more than ``SLICE_BYTES`` are taken in parts.

Defined results: a null or empty text has its end token only; a row without id is a training row; without training rows
every word is unknown and the base score 0; repeated rows count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .textarrays import BLANK, SLICE_BYTES, lowered, prefix_sums, slices, span_hashes, spans, text_bytes

SHARE = 1 << 17
CLASSES = 64
ROUNDS = 10
STRENGTH = 64.0
ENDINGS = 1 << 16
#: Longest word that is compared by its own bytes.
NAMED = 32
#: Different counts that a task holds before it sends them on.
HELD = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Rows that aren't learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Part:
    """Words of some rows of a batch, or of a stretch of one long row; ``opens`` and ``closes`` say whether that row begins and
    ends here."""

    low: int
    rows: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    opens: bool = True
    closes: bool = True

    def hashes(self) -> np.ndarray:
        return span_hashes(prefix_sums(self.data), self.starts, self.ends)

    def endings(self) -> np.ndarray:
        """The last two bytes of each word as a number."""
        before = np.where(self.ends - self.starts > 1, self.data[np.maximum(self.ends - 2, 0)], 0)
        return before.astype(np.int64) << 8 | self.data[self.ends - 1]


def _stretches(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of a long text at blanks, about ``limit`` bytes apart."""
    low = 0
    while len(data) - low > limit:
        cut = low + limit
        while cut < len(data) and not (hit := BLANK[data[cut:cut + 65536]]).any():
            cut += 65536
        if cut >= len(data):
            break
        cut += int(hit.argmax())
        yield low, cut
        low = cut
    yield low, len(data)


def parts(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[Part]:
    low = 0
    for piece in slices(batch, "text", limit):
        data, offsets = text_bytes(piece.column("text"))
        if piece.num_rows == 1 and len(data) > limit:
            cuts = list(_stretches(data, limit))
            for k, (a, b) in enumerate(cuts):
                own = lowered(data[a:b])
                starts, ends, counts = spans(~BLANK[own], np.array([0, b - a]))
                yield Part(low, 1, own, starts, ends, counts, k == 0, k == len(cuts) - 1)
        else:
            data = lowered(data)
            starts, ends, counts = spans(~BLANK[data], offsets)
            yield Part(low, piece.num_rows, data, starts, ends, counts)
        low += piece.num_rows


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as byte strings of at most NAMED bytes; a longer one is a digest and its last two bytes."""
    long = np.flatnonzero(ends - starts > NAMED)
    if len(long):
        digests = [hashlib.sha256(data[s:e].tobytes()).digest()[:NAMED - 2] + data[e - 2:e].tobytes()
                   for s, e in zip(starts[long].tolist(), ends[long].tolist())]
        starts, ends = starts.copy(), ends.copy()
        starts[long] = len(data) + NAMED * np.arange(len(long))
        ends[long] = starts[long] + NAMED
        data = np.concatenate([data, np.frombuffer(b"".join(digests), np.uint8)])
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    taken = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken)])


def count_words(rows: DataFrame) -> DataFrame:
    """(word, hash, n) over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                hashes, first, n = np.unique(part.hashes(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([names(part.data, part.starts[first], part.ends[first]),
                                                  pa.array(hashes.view(np.int64)), pa.array(n)], names=["word", "hash", "n"])

    return rows.select("text").mapInArrow(count, "word binary, hash long, n long").groupBy("word", "hash").agg(
        F.sum("n").alias("n"))


@dataclass
class Units:
    """The units: frequent words by rank, then endings, then the end of a text."""

    hashes: np.ndarray
    rank: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray) -> Units:
        """Of the frequent words, given in the order of their ranks."""
        order = np.argsort(hashes)
        return cls(hashes[order], order, counts)

    @property
    def end(self) -> int:
        return len(self.hashes) + ENDINGS

    def __len__(self) -> int:
        return self.end + 1

    def ids(self, part: Part, hashes: np.ndarray) -> np.ndarray:
        rare = len(self.hashes) + part.endings()
        if not len(self.hashes):
            return rare
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], rare)


def neighbours(part: Part, ids: np.ndarray, end: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Unit before each token, unit of each token, row of each token, with the ends of rows as tokens; and the last unit."""
    closing = np.full(part.rows, 1)
    closing[-1:] = part.closes
    row = np.repeat(np.arange(part.rows), part.counts + closing)
    here = np.full(len(row), end)
    here[np.arange(len(ids)) + np.repeat(np.cumsum(closing) - closing, part.counts)] = ids
    before = np.empty_like(here)
    before[1:] = here[:-1]
    if len(here):
        before[0] = end if part.opens else last
    return before, here, row, int(here[-1]) if len(here) else last


def count_pairs(rows: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a, over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(units)

    def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate(codes), return_inverse=True)
        return values, np.bincount(at, np.concatenate(counts), len(values)).astype(np.int64)

    def told(codes: np.ndarray, n: np.ndarray, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((codes // size).astype(np.int32)), pa.array((codes % size).astype(np.int32)),
                                           pa.array(n)], names=["a", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        codes, counts, size, last = [], [], 0, own.end
        for batch in batches:
            for part in parts(batch):
                before, here, _, last = neighbours(part, own.ids(part, part.hashes()), own.end, last)
                found, n = np.unique(before * len(own) + here, return_counts=True)
                codes, counts, size = [*codes, found], [*counts, n], size + len(found)
                if size > HELD:
                    found, n = merged(codes, counts)
                    codes, counts, size = [found], [n], len(found)
                    if size > HELD // 2:
                        yield told(found, n, len(own))
                        codes, counts, size = [], [], 0
        if size:
            yield told(*merged(codes, counts), len(own))

    return rows.select("text").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def filed(pairs: DataFrame) -> DataFrame:
    """The pairs under either unit: (unit, other, side, n); side 0: other follows, 1: it comes before, 2: it is the unit itself."""
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(
        F.col("a").alias("unit"), F.col("b").alias("other"), F.lit(2).alias("side"), "n"))).otherwise(F.array(
            F.struct(F.col("a").alias("unit"), F.col("b").alias("other"), F.lit(0).alias("side"), "n"),
            F.struct(F.col("b").alias("unit"), F.col("a").alias("other"), F.lit(1).alias("side"), "n")))
    return pairs.select(F.inline(both)).repartition("unit").sortWithinPartitions("unit")


def by_class(pairs: DataFrame, classes: np.ndarray, k: int) -> DataFrame:
    """(unit, slots, n) for filed pairs: how often each class follows (slot = class), comes before (k + class), and the unit
    itself follows (2k). A unit's rows stand together, so little is left to add up after the tasks have added theirs."""
    sent = pairs.sparkSession.sparkContext.broadcast(classes)
    width = 2 * k + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, other, side = (batch.column(c).to_numpy().astype(np.int64) for c in ("unit", "other", "side"))
            slot = np.where(side == 2, 2 * k, side * k + sent.value[other])
            codes, at = np.unique(unit * width + slot, return_inverse=True)
            n = np.bincount(at, batch.column("n").to_numpy(), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((codes // width).astype(np.int32)), pa.array((codes % width).astype(np.int32)),
                                              pa.array(n)], names=["unit", "slot", "n"])

    summed = pairs.mapInArrow(count, "unit int, slot int, n long").groupBy("unit", "slot").agg(F.sum("n").alias("n"))
    return summed.groupBy("unit").agg(F.collect_list(F.struct("slot", "n")).alias("cells"))


def _dense(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Units, and counts by class after them, before them, and of themselves."""
    for low in range(0, batch.num_rows, 64):
        part = batch.slice(low, 64)
        cells = part.column("cells")
        flat = cells.flatten()
        row = np.repeat(np.arange(len(part)), cells.value_lengths().to_numpy(zero_copy_only=False))
        out = np.zeros((len(part), 2 * k + 1))
        out[row, flat.field("slot").to_numpy()] = flat.field("n").to_numpy()
        yield part.column("unit").to_numpy(), out[:, :k], out[:, k:2 * k], out[:, 2 * k]


def class_pairs(counted: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the class bigrams, from units counted with the same classes."""
    sent = counted.sparkSession.sparkContext.broadcast(classes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for unit, after, _, own in _dense(batch, k):
                at = sent.value[unit]
                np.add.at(total, at, after)
                np.add.at(total, (at, at), own)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total.ravel()[cell].astype(np.int64))],
                                         names=["cell", "n"])

    found = counted.mapInArrow(add, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, without the words' own part, which no exchange changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def exchange_gains(table: np.ndarray, classes: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each unit (row) and class: the likelihood with the unit in that class, up to a constant of the unit."""
    m, k = after.shape
    at = np.arange(m)
    without = np.broadcast_to(table, (m, k, k)).copy()
    without[at, classes] -= after
    without[at, :, classes] -= before
    without[at, classes, classes] -= own
    plain = _xlogx(without)
    corner = np.einsum("mii->mi", without)
    gains = (_xlogx(without + after[:, None, :]) - plain).sum(axis=2) + (_xlogx(without + before[:, :, None]) - plain).sum(axis=1)
    gains += (_xlogx(corner + after + before + own[:, None]) - _xlogx(corner + after) - _xlogx(corner + before) + _xlogx(corner))
    for side, mine, others in ((2, after, before), (1, before, after)):
        # What other classes have with the unit stays theirs, wherever it goes.
        sums = without.sum(axis=side) + others
        gains -= _xlogx(sums + (mine.sum(axis=1) + own)[:, None]) - _xlogx(sums)
    return gains


def best_classes(counted: DataFrame, classes: np.ndarray, table: np.ndarray, end: int, turn: int, share: int) -> np.ndarray:
    """Classes after one round in which one unit in ``share`` may move; the end's class is nobody else's."""
    k = len(table)
    sent = counted.sparkSession.sparkContext.broadcast((classes, table))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pairs = sent.value
        for batch in batches:
            for unit, after, before, own in _dense(batch, k):
                mine = (unit != end) & ((unit.astype(np.int64) * 0x9E3779B1 + turn * 0x85EBCA77 >> 16) % share == 0)
                unit, after, before, own = unit[mine], after[mine], before[mine], own[mine]
                gains = exchange_gains(pairs, current[unit], after, before, own)[:, :k - 1]
                best = gains.argmax(axis=1)
                rows = np.arange(len(unit))
                moved = gains[rows, best] > gains[rows, current[unit]] + 1e-9
                yield pa.RecordBatch.from_arrays([pa.array(unit[moved].astype(np.int32)), pa.array(best[moved].astype(np.int32))],
                                                 names=["unit", "cls"])

    # One short row for each unit at most, and units are bounded.
    found = counted.mapInArrow(choose, "unit int, cls int").toArrow()
    out = classes.copy()
    out[found["unit"].to_numpy()] = found["cls"].to_numpy()
    return out


def cluster(pairs: DataFrame, units: Units, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of every unit (the end has class k), the class bigrams, and the likelihood of each state that was kept."""
    classes = np.arange(len(units)) % k
    classes[units.end] = k
    share, best = 2, None
    for turn in range(rounds + 1):
        counted = staged(by_class(pairs, classes, k + 1))
        table = class_pairs(counted, classes, k + 1)
        if best is None or likelihood(table) >= best[-1][-1]:
            best = (counted, classes, table, [*(best[-1] if best else []), likelihood(table)])
            share = max(2, share // 2)
        else:
            share *= 2
        if turn < rounds:
            counted, classes, table, _ = best
            classes = best_classes(counted, classes, table, units.end, turn, share)
    return best[1], best[2], best[3]


@dataclass
class Model:
    """What scoring needs. ``words`` holds the counts of all words of the training rows, ``often`` the bound above which a
    word is a unit of its own."""

    words: DataFrame
    units: Units
    often: int
    ends: int
    tokens: int
    types: int
    discount: float
    classes: np.ndarray
    table: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    history: list[float]

    def log_moves(self) -> np.ndarray:
        """log10 p(class | class before), a row for each class before."""
        share = (self.table.sum(axis=0) + 1) / (self.table.sum() + len(self.table))
        return np.log10((self.table + STRENGTH * share) / (self.table.sum(axis=1, keepdims=True) + STRENGTH))

    def log_class_tokens(self) -> np.ndarray:
        return np.log10(np.maximum(self.class_tokens, 1))

    def log_unknown(self) -> np.ndarray:
        """log10 of the mass that a class leaves to unknown words, times its tokens; all of it in a class without words."""
        return np.log10(np.where(self.class_tokens > 0, self.discount * np.maximum(self.class_types, 1), 1.0))


def fit(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, share: int = SHARE) -> Model:
    """Counts, units and classes from the rows that aren't held out."""
    rows = docs.where(~held_out(F.col("doc_id"))).select("text")
    words = staged(count_words(rows))
    ends = rows.count()
    seen = words.agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once"),
                     F.count_if(F.col("n") == 2).alias("twice")).first()
    tokens = (seen["n"] or 0) + ends
    often = tokens // share
    # Fewer than `share` words can have more than 1 / share of all tokens each.
    frequent = words.where(F.col("n") > often).select("word", "hash", "n").toArrow().sort_by(
        [("n", "descending"), ("word", "ascending")])
    n = frequent["n"].to_numpy().astype(np.int64)
    units = Units.of(frequent["hash"].to_numpy().astype(np.int64).view(np.uint64), n)
    pairs = staged(filed(count_pairs(rows, units)))
    found, table, history = cluster(pairs, units, classes, rounds)
    rare = words.where(F.col("n") <= often).groupBy(F.substring("word", -2, 2).alias("ending")).agg(
        F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    class_tokens, class_types = np.zeros(classes + 1), np.zeros(classes + 1)
    np.add.at(class_tokens, found[:len(n)], n)
    np.add.at(class_types, found[:len(n)], 1)
    for r in rare:
        at = found[len(n) + int.from_bytes(r["ending"], "big")]
        class_tokens[at] += r["n"]
        class_types[at] += r["types"]
    class_tokens[classes], class_types[classes] = ends, 0
    once, twice = seen["once"], seen["twice"]
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    return Model(words, units, often, ends, tokens, seen["types"] + (ends > 0), discount, found, table, class_tokens,
                 class_types, history)


def word_classes(model: Model) -> DataFrame:
    """(word, n, cls) of all words of the training rows."""
    spark = model.words.sparkSession
    n = len(model.units.hashes)
    # Bounded by the number of units.
    own = spark.createDataFrame(pa.table({"hash": model.units.hashes.view(np.int64), "own": model.classes[model.units.rank]}))
    code = np.arange(ENDINGS)
    ending = pa.array([int(c).to_bytes(2, "big") if c > 0xFF else int(c).to_bytes(1, "big") for c in code], pa.binary())
    shared = spark.createDataFrame(pa.table({"ending": ending, "cls": model.classes[n + code]}))
    often = F.col("n") > model.often
    frequent = model.words.where(often).join(F.broadcast(own), "hash").select("word", "n", F.col("own").alias("cls"))
    tail = F.substring("word", -2, 2)
    # A first byte of zero does not count.
    tail = F.when((F.length(tail) == 2) & (F.substring(tail, 1, 1) == F.lit(b"\0")), F.substring(tail, 2, 1)).otherwise(tail)
    rare = model.words.where(~often).withColumn("ending", tail).join(F.broadcast(shared), "ending").select("word", "n", "cls")
    return frequent.unionByName(rare)


def _rows(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base, score, rare): sums over the tokens that need no look-up, and the rare words."""
    units, own = model.units, model.classes
    n = len(units.hashes)
    # Of rare words, the count and what depends on it are still missing.
    known, base, emit = np.zeros(len(units), bool), np.zeros(len(units)), -model.log_class_tokens()[own]
    known[:n], known[units.end] = True, model.ends > 0
    base[:n], base[units.end] = np.log10(units.counts + 1.0), np.log10(model.ends + 1.0)
    emit[:n] += np.log10(units.counts - model.discount)
    emit[units.end] = 0.0
    sent = docs.sparkSession.sparkContext.broadcast((units, own, known, base, emit, model.log_moves(), model.log_unknown()))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, own, known, base, emit, moves, log_unknown = sent.value
        last = units.end
        kept: list[tuple] = []
        for batch in batches:
            for part in parts(batch):
                hashes = part.hashes()
                ids = units.ids(part, hashes)
                before, here, row, last = neighbours(part, ids, units.end, last)
                sums = np.stack([np.bincount(row, minlength=part.rows), np.bincount(row, known[here], part.rows),
                                 np.bincount(row, base[here], part.rows),
                                 np.bincount(row, moves[own[before], own[here]] + emit[here], part.rows)])
                rare = np.flatnonzero(ids >= len(units.hashes))
                of = np.repeat(np.arange(part.rows), part.counts)[rare]
                order = np.lexsort((hashes[rare], of))
                rare, of = rare[order], of[order]
                new = np.ones(len(rare), bool)
                new[1:] = (of[1:] != of[:-1]) | (hashes[rare[1:]] != hashes[rare[:-1]])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare)))
                rare, of = rare[first], of[first]
                kept.append((sums, np.bincount(of, minlength=part.rows), names(part.data, part.starts[rare], part.ends[rare]),
                             log_unknown[own[ids[rare]]], times))
                if not part.closes:
                    continue
                sums = kept[0][0] if len(kept) == 1 else sum(k[0] for k in kept)
                many = kept[0][1] if len(kept) == 1 else sum(k[1] for k in kept)
                word = pa.StructArray.from_arrays(
                    [pa.concat_arrays([k[2] for k in kept]), pa.array(np.concatenate([k[3] for k in kept])),
                     pa.array(np.concatenate([k[4] for k in kept]).astype(np.int64))], ["word", "unknown", "times"])
                kept = []
                edges = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.low, part.rows), pa.array(sums[0].astype(np.int64)),
                     pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), pa.ListArray.from_arrays(edges, word)],
                    names=["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {id_type}, n_tokens long, n_known long, base double, score double, "
              "rare array<struct<word: binary, unknown: double, times: long>>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity); scores are log10 probabilities.

    Rows are written with a number of their own and their rare words, each once; these move to their counts, and sums by row
    come back.
    """
    rows = staged(_rows(docs, model).withColumn("row", F.monotonically_increasing_id()))
    counts = model.words.where(F.col("n") <= model.often).select("word", "n")
    found = rows.selectExpr("row", "inline(rare)").join(counts, "word", "left")
    n, times = F.col("n"), F.col("times")
    sums = found.groupBy("row").agg(
        F.sum(F.when(n.isNotNull(), times).otherwise(0)).alias("more_known"),
        F.sum(F.when(n.isNotNull(), times * F.log10(n + 1.0)).otherwise(0.0)).alias("more_base"),
        F.sum(times * F.when(n.isNotNull(), F.log10(n - model.discount)).otherwise(F.col("unknown"))).alias("more_score"))
    whole = rows.drop("rare").join(sums, "row", "left").fillna(0, ["more_known", "more_base", "more_score"])
    total = float(np.log10(model.tokens + model.types + 1.0))
    return whole.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("score") + F.col("more_score")).alias("score")).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
