"""Maintenance of index tables by key: replace, delete, move, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def replace_by_key(current: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Current rows without the changed keys, and the fresh rows. A changed key may have no fresh row."""
    return current.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def _tombstones(buckets: DataFrame, like: DataFrame) -> DataFrame:
    """Rows without a key, one per bucket, in the columns of ``like``."""
    return buckets.select(*[
        F.col("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def write_table(df: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """First write of an index table, laid out in hash buckets of the key. An empty table keeps its schema.

    The buckets are fixed in number and grow with the table; Spark may give one to several tasks, each with a file of its own.
    """
    rows = df.withColumn("bucket", bucket(key, buckets))
    first = df.sparkSession.range(1).select(F.lit(0).alias("bucket"))
    rows.unionByName(_tombstones(first, rows)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    return spark.read.parquet(path).drop("bucket").filter(F.col(key).isNotNull())


def replace_in_table(spark: SparkSession, path: str, fresh: DataFrame, changed: DataFrame,
                     key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Replace all rows of the changed keys in a stored table.

    Only the buckets that hold a changed key are read and rewritten. New files are complete before the first of the old
    ones goes, but buckets are exchanged one by one, so readers can meanwhile see some old and some new ones; see
    generations for tables whose changes appear as a whole. A touched bucket always keeps its partition: a tombstone row
    without a key stands where no row is left.
    """
    keys = changed.select(key).distinct()
    touched = keys.select(bucket(key, buckets).alias("bucket")).distinct()
    stored = spark.read.parquet(path)
    kept = stored.join(touched, "bucket", "left_semi").join(keys, key, "left_anti").filter(F.col(key).isNotNull())
    new = kept.unionByName(fresh.withColumn("bucket", bucket(key, buckets)))
    new.unionByName(_tombstones(touched, new)).hint("rebalance", "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def delete_by_doc(rows: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def update_payload(chunks: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Overwrite payload fields of all chunks of a document; a null change keeps the value.

    changes (doc_id, new_<field>...); ``doc_id`` itself may be among the fields.
    """
    joined = chunks.join(changes, "doc_id", "left")
    for f in fields:
        if f != "doc_id":
            joined = joined.withColumn(f, F.coalesce(f"new_{f}", f))
    if "doc_id" in fields:
        joined = joined.withColumn("doc_id", F.coalesce("new_doc_id", "doc_id"))
    return joined.select(*chunks.columns)


def purge(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove a set of documents from every artifact table."""
    return {name: delete_by_doc(rows, doc_ids) for name, rows in tables.items()}


def delete_plan(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, force) -> plus ``action``: missing, skip, soft or hard."""
    joined = requests.join(documents.select("doc_id", "status"), "doc_id", "left")
    return joined.withColumn("action", F.when(F.col("status").isNull(), "missing").when(
        F.col("status") == "deleted", "skip").when(
        (F.col("status") == "indexed") & ~F.col("force"), "soft").otherwise("hard"))


def apply_delete(documents: DataFrame, plan: DataFrame, at: Column) -> DataFrame:
    """Documents after a delete plan: soft deletes are marked and stay, hard ones go."""
    gone = plan.filter(F.col("action") == "hard")
    soft = plan.filter(F.col("action") == "soft").select("doc_id", F.lit(True).alias("_soft"))
    left = delete_by_doc(documents, gone).join(soft, "doc_id", "left")
    marked = F.coalesce("_soft", F.lit(False))
    return left.withColumn("status", F.when(marked, "deleted").otherwise(F.col("status"))).withColumn(
        "deleted_at", F.when(marked, at).otherwise(F.col("deleted_at"))).drop("_soft")


def drop_kb(tables: dict[str, DataFrame], kb_id: str, connectors: DataFrame) -> dict[str, DataFrame]:
    """Tables without one knowledge base; nothing changes while one of its connectors is syncing."""
    busy = connectors.filter((F.col("kb_id") == kb_id) & (F.col("sync_status") == "running")).limit(1).agg(
        (F.count("*") > 0).alias("_busy"))
    return {name: rows.join(F.broadcast(busy)).filter(F.col("_busy") | (F.col("kb_id") != kb_id)).drop("_busy")
            for name, rows in tables.items()}


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(kb_id, doc_id) whose chunks have no document row or no id: the purge list."""
    named = chunks.select("kb_id", "doc_id").distinct()
    lost = named.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")
    return lost.select("kb_id", "doc_id")


def transfer_ownership(chunks: DataFrame, documents: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move chunks of an older document to the newer one with the same body.

    pairs (old_id, new_id); documents (doc_id, title, source, status, chunk_count, duplicate_of).
    """
    names = documents.select(F.col("doc_id").alias("new_id"), F.col("title").alias("new_title"), F.col("source").alias("new_source"))
    changes = pairs.join(names, "new_id").select(
        F.col("old_id").alias("doc_id"), F.col("new_id").alias("new_doc_id"), "new_title", "new_source")
    moved = update_payload(chunks, changes, ["title", "source", "doc_id"])
    counts = documents.select(F.col("doc_id").alias("old_id"), F.col("chunk_count").alias("taken"))
    lost = pairs.select(F.col("old_id").alias("doc_id"), F.col("new_id").alias("taken_by"))
    won = pairs.join(counts, "old_id").select(F.col("new_id").alias("doc_id"), "taken", F.lit(True).alias("won"))
    d = documents.join(lost, "doc_id", "left").join(won, "doc_id", "left")
    beaten, winner = F.col("taken_by").isNotNull(), F.coalesce("won", F.lit(False))
    after = d.select(
        "doc_id", "title", "source",
        F.when(beaten, "outdated").when(winner, "indexed").otherwise(F.col("status")).alias("status"),
        F.when(winner, F.col("taken")).otherwise(F.col("chunk_count")).alias("chunk_count"),
        F.when(beaten, F.col("taken_by")).otherwise(F.col("duplicate_of")).alias("duplicate_of"))
    return moved, after
