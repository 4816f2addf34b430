"""Continuous ingest with duplicate decisions: every batch is parsed, compared with what is indexed, decided, chunked and written.

The index is kept in four tables that grow by generations: ``documents`` (live documents with their sketches and texts), ``keys``
(the keys under which they are found), ``chunks`` and ``decisions``. A batch looks its own keys up in the stored ones, so
only stored documents that can be near meet its documents; the decisions of both are replayed in the order of
arrival, in which stored documents are known to be indexed. The end is the same as that of one replay over all documents.

A batch counts once its record stands, a small file with the generations that it left. A batch cut short leaves
generations that no record names; the next attempt forgets them first and starts from the same state. A batch that is sent
again after its record does nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import first_line
from ..operators import generations as G
from ..operators.chunking import fixed_chunks
from ..operators.embed import dense_embed
from ..operators.sequence import look_up_keys, replay_texts, sketches
from ..session import staged
from ..sources.readers import Parsers

TABLES = ("documents", "keys", "chunks", "decisions")
INCOMING = "doc_id bigint, kb_id string, doc_type string, text string, version int, doc_created_at bigint"


class Records:
    """The batches that are complete: for each the generations of the tables and the last arrival number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, f"{path}/batches"

    def _at(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def last(self) -> dict | None:
        fs, at = self._at()
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.getLen()] if fs.exists(at) else []
        names = [n for n in names if n.startswith("batch-")]
        if not names:
            return None
        fs, at = self._at(max(names))
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def add(self, record: dict) -> None:
        fs, at = self._at(f"batch-{record['batch']:012d}")
        # An empty record of an attempt cut short is written over; readers pass it by.
        stream = fs.create(at, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()


def parsed(batch: DataFrame, parsers: Parsers) -> DataFrame:
    """(doc_id, kb_id, title, text, doc_created_at, version): the newest version of each document, parsed by its type."""
    newest = batch.groupBy("doc_id").agg(F.max_by(F.struct("kb_id", "doc_type", "text", "doc_created_at", "version"), "version").alias("d"))
    return parsers.parse(newest.select("doc_id", "d.*")).select(
        "doc_id", "kb_id", first_line(F.col("text")).alias("title"), "text", "doc_created_at", "version")


def decide(new: DataFrame, stored: DataFrame | None, keys: DataFrame | None) -> DataFrame:
    """Decisions over arriving documents and the stored ones that they can meet, by arrival number.

    new and stored (seq, doc_id, kb_id, title, title_hash, simhash, signature, nibbles, digest, doc_created_at, text).
    """
    world = new.withColumn("indexed", F.lit(False))
    if stored is not None:
        asked = look_up_keys(new).select("kb_id", "kind", "key").distinct()
        met = keys.join(asked, ["kb_id", "kind", "key"], "left_semi").select("doc_id").distinct()
        near = stored.join(met, "doc_id", "left_semi").join(new.select("doc_id"), "doc_id", "left_anti")
        world = world.unionByName(near.withColumn("indexed", F.lit(True)))
    world = staged(world)
    groups = world.groupBy("kb_id", "digest").agg(F.min("seq").alias("group"), F.bool_and("indexed").alias("old"))
    placed = staged(world.select("seq", "kb_id", "digest", "doc_created_at", "indexed").join(groups, ["kb_id", "digest"]))
    leads = world.join(placed.where("seq = group").select("seq"), "seq", "left_semi").drop("doc_id").withColumnRenamed("seq", "doc_id")
    asking = placed.where("NOT old").select(F.col("group").alias("doc_id")).distinct()
    decided = replay_texts(placed.select(F.col("seq").alias("doc_id"), "group", "doc_created_at", "indexed"), leads,
                           leads.select("doc_id", "text"), asking, bodies=True)
    names = world.select("seq", F.col("doc_id").alias("name"), "indexed")
    out = decided.withColumnRenamed("doc_id", "seq").join(names.withColumnRenamed("name", "doc_id"), "seq")
    for column in ("candidate_id", "replaced_by", "body_of"):
        other = names.select(F.col("seq").alias(column), F.col("name").alias("_name"))
        out = out.join(other, column, "left").drop(column).withColumnRenamed("_name", column)
    return staged(out.select("doc_id", "indexed", "candidate_id", "body_match", "title_match", "action", "replaced_by", "live", "body_of"))


def ingest_batch(batch: DataFrame, number: int, path: str, parsers: Parsers, size: int, overlap: int) -> None:
    spark = batch.sparkSession
    records = Records(spark, path)
    before = records.last()
    if before and number <= before["batch"]:
        return
    for name in TABLES:
        G.rollback(spark, f"{path}/{name}", before["generations"][name] if before else None)

    table = {name: G.read(spark, f"{path}/{name}") for name in TABLES} if before else {}
    docs = parsed(batch, parsers)
    if before:
        # A file that comes late does not undo a newer version.
        known = table["decisions"].select("doc_id", F.col("version").alias("known"))
        docs = docs.join(known, "doc_id", "left").where("known IS NULL OR version >= known").drop("known")
    docs = staged(docs)
    # Arrival numbers are given to ids alone; texts stay where they are.
    arrival = docs.select("doc_id", (F.row_number().over(Window.orderBy("doc_id")) + (before["seq"] if before else 0)).cast(
        "long").alias("seq"))
    new = staged(sketches(docs).join(docs.select("doc_id", "text", "doc_created_at", F.sha2("text", 256).alias("digest")), "doc_id").join(
        arrival, "doc_id"))
    decided = decide(new, table.get("documents"), table.get("keys"))
    fresh = decided.where("NOT indexed").drop("indexed").join(docs.select("doc_id", "version"), "doc_id")
    beaten = decided.where("indexed AND replaced_by IS NOT NULL").select("doc_id", "replaced_by")
    live = fresh.where("live").select("doc_id", "body_of")
    changed = staged(docs.select("doc_id").union(beaten.select("doc_id")).distinct())

    kept = new.join(live.select("doc_id"), "doc_id", "left_semi")
    own = live.join(docs.select(F.col("doc_id").alias("body_of"), "kb_id", "text"), "body_of")
    cut = dense_embed(fixed_chunks(own.select("doc_id", "kb_id", "text"), size, overlap))
    if before:
        # Chunks of a stored document that gave way to a newer title move to it.
        taken = live.where("doc_id <> body_of").join(docs.select(F.col("doc_id").alias("body_of")), "body_of", "left_anti")
        moved = table["chunks"].withColumnRenamed("doc_id", "body_of").join(taken, "body_of")
        cut = cut.unionByName(moved.select(*cut.columns))
        old = table["decisions"].drop("replaced_by", "live").join(beaten, "doc_id").withColumn("live", F.lit(False))
        fresh = fresh.unionByName(old)
    rows = {"documents": kept, "keys": look_up_keys(kept), "chunks": cut, "decisions": fresh}
    done = {}
    for name in TABLES:
        at = f"{path}/{name}"
        if before:
            done[name] = G.upsert(rows[name], changed, at)
        else:
            G.create(rows[name], at)
            done[name] = 0
    last = arrival.agg(F.max("seq").alias("seq")).first()["seq"] or (before["seq"] if before else 0)
    records.add({"batch": number, "generations": done, "seq": last})


def ingest_stream(spark: SparkSession, source: str, path: str, checkpoint: str, parsers: Parsers | None = None,
                  size: int = 200, overlap: int = 20, files_per_batch: int = 100) -> StreamingQuery:
    """Watch a folder of parquet documents in the columns of ``INCOMING`` and keep the index current."""
    parsers = parsers or Parsers()
    stream = spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, number: ingest_batch(batch, number, path, parsers, size, overlap)).start()
