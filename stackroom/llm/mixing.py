"""Mix sources to target weights with fixed-length blocks.

The words of a source form one stream, cut into blocks of ``block_words``. Every output shard gets a multinomial
number of slots of each source; the slots of a source are numbered, and a slot takes the block that a
pseudorandom permutation of the source's block numbers gives it, a new permutation after each full pass.
Blocks and slots meet in a join on (source, block number).

The draw is conditional on the source totals: slots of a source are ``target / source size`` times its blocks,
rounded, and each goes to a shard at random. So a source's words come within about one block of its target whatever the shards
get, and no block is taken more often than full passes ask for.

Defined results: a null or empty text has size 0 and is never taken, and a source of such texts only has target 0 and no
slots; a null source is a source of its own, last in
order; repeated rows and repeated ids are rows of their own; an empty table gives an empty mix; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows of a source that one window task numbers; more rows make more buckets.
BUCKET_ROWS = 2_000
#: Slots drawn by one call.
CHUNK_SLOTS = 1 << 16
#: Slots drawn by one task, about.
TASK_SLOTS = 1 << 18
SEED = 20240229


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
                most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with sid, weight and target.

    Targets share ``share`` of all words by weight; a target stops at ``most`` times its source and the excess is
    shared anew by the others. That is min(most * size, level * weight) with one level for all: sources are put
    in the order in which they stop, and the level is the first that its own source doesn't stop. The table has
    one row per source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("sid", (F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")).withColumn("weight", weight)
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn(
        "stops", F.col("cap") / F.col("weight"))
    order = Window.orderBy("stops", "sid")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(whole) * F.lit(share)
    level = capped.withColumn("level", (total - before) / rest)
    fits = F.when(F.col("level") <= F.col("stops"), F.col("level"))
    return level.withColumn("common", F.first(fits, ignorenulls=True).over(whole)).select(
        "source", "source_size", "sid", "weight",
        F.coalesce(F.least("cap", F.col("common") * F.col("weight")), F.col("cap")).alias("target"))


def _permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Positions of a pseudorandom permutation of range(size): a four-round Feistel network, walked until the
    value is in range."""
    if size <= 1:
        return np.zeros(len(index), np.uint64)
    half = (int(size - 1).bit_length() + 1) // 2
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(4):
            f = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while len(far := np.flatnonzero(out >= size)):
        out[far] = once(out[far])
    return out


def draw_slots(targets: DataFrame, block_words: int, slots_per_shard: int, seed: int = SEED) -> DataFrame:
    """(shard, sid, slot, block): which block of which source every slot of every shard takes."""
    plan = targets.select(
        "sid", F.ceil(F.col("source_size") / block_words).cast("long").alias("n_blocks"),
        F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("passes")).select(
        "sid", "n_blocks", F.round(F.col("passes") * F.col("n_blocks")).cast("long").alias("slots"))
    shards = F.greatest(F.ceil(F.sum("slots").over(Window.partitionBy()) / slots_per_shard), F.lit(1)).cast("long")
    chunks = (plan.withColumn("n_shards", shards).where("slots > 0")
              .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1,
                                                        F.lit(CHUNK_SLOTS).cast("long"))))
              .select("sid", "n_blocks", "slots", "n_shards", "first"))
    # The rows are few and short, what is drawn from them is not: the number of tasks is named, so they stay apart.
    total = plan.agg(F.sum("slots").alias("n")).first()["n"] or 0
    chunks = chunks.repartition(max(1, -(-total // TASK_SLOTS)), "sid", "first")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                slot = np.arange(c["first"], min(c["first"] + CHUNK_SLOTS, c["slots"]), dtype=np.int64)
                rng = np.random.default_rng([seed, c["sid"], c["first"]])
                # The counts of this chunk's slots over the shards are multinomial.
                shard = np.sort(rng.integers(0, c["n_shards"], len(slot)))
                block = np.empty(len(slot), np.int64)
                for turn in np.unique(slot // c["n_blocks"]):
                    own = slot // c["n_blocks"] == turn
                    key = (seed * 1_000_003 + c["sid"] * 8_191 + int(turn) * 131) & (2**64 - 1)
                    block[own] = _permuted(slot[own] % c["n_blocks"], c["n_blocks"], key).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(np.full(len(slot), c["sid"])), pa.array(slot), pa.array(block)],
                    names=["shard", "sid", "slot", "block"])

    return chunks.mapInArrow(draw, "shard long, sid long, slot long, block long")


class Mix:
    """The parts of a mix: ``rows`` (one per document, with its place in the stream), ``targets``, ``slots``."""

    def __init__(self, docs: DataFrame, block_words: int = 64, slots_per_shard: int = 4096,
                 weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                 seed: int = SEED, keep_text: bool = False) -> None:
        self.block_words = block_words
        sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
        sized = staged(sized.withColumn("row_id", F.monotonically_increasing_id()))
        n_buckets = sized.count() // BUCKET_ROWS + 1
        sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.targets = staged(mix_targets(sums, weights, share, most))
        numbered = sized.withColumnRenamed("source", "name").join(
            self.targets, F.col("name").eqNullSafe(F.col("source"))).drop("name").withColumn(
            "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)))
        in_source = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        bases = numbered.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).select(
            "sid", "bucket", F.coalesce(F.sum("words").over(in_source), F.lit(0)).alias("base"))
        in_bucket = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "text_hash", "row_id").rowsBetween(
            Window.unboundedPreceding, -1)
        self.rows = (numbered.withColumn("within", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
                     .join(bases, ["sid", "bucket"])
                     .select("row_id", "doc_id", "text_hash", "sid", "source", "size", "source_size", "target",
                             (F.col("base") + F.col("within")).alias("start")))
        self.slots = draw_slots(self.targets, block_words, slots_per_shard, seed)
        self._docs = docs if keep_text else None

    def pieces(self) -> DataFrame:
        """(sid, block, row_id, doc_id, text_hash, start, length, skip): the part of a document in each block it touches."""
        size, start, width = F.col("size"), F.col("start"), self.block_words
        first, last = F.floor(start / width), F.floor((start + size - 1) / width)
        low, high = F.greatest(start, F.col("block") * width), F.least(start + size, (F.col("block") + 1) * width)
        return (self.rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
                .select("sid", "block", "row_id", "doc_id", "text_hash", low.alias("at"), (high - low).alias("length"),
                        (low - start).alias("skip")))

    def taken(self) -> DataFrame:
        """Per document: (doc_id, source, size, source_size, target, taken)."""
        times = self.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
        drawn = self.pieces().join(times.hint("merge"), ["sid", "block"]).groupBy("row_id").agg(
            F.sum(F.col("length") * F.col("times")).alias("taken"))
        return self.rows.join(drawn.hint("merge"), "row_id", "left").select(
            "doc_id", "source", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def blocks(self) -> DataFrame:
        """The mix itself: (shard, sid, source, slot, block, n_words, doc_ids, text), one row per slot."""
        # Texts are read anew from the documents and not kept beside them. They travel whole and once, to their cuts; they are split
        # into words only there, once for all cuts. Rows of one id and one text are one text with the cuts of all of them.
        # No hash is null; said on both sides, the name has one type, and one shuffle of the texts serves grouping and join.
        named = F.struct("doc_id", F.coalesce("text_hash", F.lit(0).cast("long")).alias("text_hash")).alias("named")
        per_text = self.pieces().groupBy(named).agg(F.collect_list(F.struct("sid", "block", "at", "length", "skip")).alias("cuts"))
        texts = self._docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).groupBy(named).agg(
            F.first("text").alias("text"))
        words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
        cuts = let(words, lambda ws: F.transform("cuts", lambda c: F.struct(
            c["sid"], c["block"], c["at"], c["length"], F.array_join(F.slice(
                ws, (c["skip"] + 1).cast("int"), c["length"].cast("int")), " ")).cast(
            "struct<sid:bigint,block:bigint,at:bigint,length:bigint,text:string>")))
        cut = per_text.join(texts, "named").select("named.doc_id", F.explode(cuts).alias("c")).select("doc_id", "c.*")
        packed = cut.groupBy("sid", "block").agg(
            F.array_sort(F.collect_list(F.struct("at", "length", "doc_id", "text"))).alias("parts")).select(
            "sid", "block", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_words"),
            F.array_distinct(F.transform("parts", lambda p: p["doc_id"])).alias("doc_ids"),
            F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))
        return self.slots.hint("merge").join(packed.hint("merge"), ["sid", "block"]).join(
            self.targets.select("sid", "source"), "sid").select("shard", "sid", "source", "slot", "block", "n_words", "doc_ids", "text")
