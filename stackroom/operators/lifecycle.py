"""Document life cycle: status machine, queues, plans for reindexing, aborting, deleting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_hooks(rows: DataFrame, hooks: list[tuple[str, Column]]) -> DataFrame:
    """Mark new rows a hook stops; the first hook that objects gives the reason and later ones do not run."""
    reason = F.lit(None).cast("string")
    for name, objects in reversed(hooks):
        reason = F.when(objects, f"blocked by hook: {name}").otherwise(reason)
    return rows.withColumn("rejected", reason)


# Retry delay of a blocked event, age at which a running sync is stale, reason texts.
RETRY_SECONDS = 10
STALE_SYNC_SECONDS = 3600
ABORTED = "Aborted"


def is_active(status: Column) -> Column:
    return ~status.isin("indexed", "failed", "deleted", "outdated")


def current_status(events: DataFrame) -> DataFrame:
    """State of every document after its events, applied in order of ``event_id``.

    events (doc_id, event_id, ts, status, error): pending and indexed clear the error, failed sets it,
    running sets the start, indexed and failed the end. One aggregation, no ordering of groups.
    """
    at = F.col("event_id")

    def last(value: Column, when: Column) -> Column:
        return F.max_by(F.when(when, value), F.when(when, at))

    clears = F.col("status").isin("pending", "indexed", "failed")
    return events.groupBy("doc_id").agg(
        F.max_by("status", at).alias("status"),
        F.max_by(F.when(F.col("status") == "failed", F.substring("error", 1, 500)), F.when(clears, at)).alias("last_error"),
        last(F.col("ts"), F.col("status") == "running").alias("process_started_at"),
        last(F.col("ts"), F.col("status").isin("indexed", "failed")).alias("process_finished_at"),
        F.count("*").alias("n_events"))


def enqueue_guard(events: DataFrame, documents: DataFrame) -> DataFrame:
    """events (doc_id, ...) plus ``decision`` and the status the document gets.

    An event for a missing or deleted document is dropped; else it is queued, and the document becomes
    pending unless it is running or being deleted.
    """
    j = events.join(documents.select("doc_id", "status"), "doc_id", "left")
    decision = F.when(F.col("status").isNull(), "drop_missing").when(F.col("status") == "deleted", "drop_deleted").otherwise("queued")
    return j.withColumn("decision", decision).withColumn("new_status", F.when(
        (F.col("decision") == "queued") & ~F.col("status").isin("running", "deleting"), "pending").otherwise(F.col("status")))


def delayed(events: DataFrame, seconds: int = RETRY_SECONDS) -> DataFrame:
    """(payload, ready_at): a repeated payload takes the later ready time."""
    return events.groupBy("payload").agg(
        F.max(F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))).alias("ready_at"))


def dispatch(events: DataFrame, documents: DataFrame) -> DataFrame:
    """events (event_id, kind, payload) plus doc_id, force and ``decision``: dispatch, delay or drop.

    Broken JSON and a payload without a document are dropped; an upload waits for a running or deleting
    document, a delete for a running one.
    """
    parsed = events.withColumn("p", F.from_json("payload", "doc_id bigint, force boolean")).select(
        *events.columns, F.col("p.doc_id").alias("doc_id"), F.coalesce("p.force", F.lit(False)).alias("force"))
    j = parsed.join(documents.select("doc_id", "status"), "doc_id", "left")
    waits = (F.col("status") == "running") | ((F.col("kind") == "upload") & (F.col("status") == "deleting"))
    return j.withColumn("decision", F.when(F.col("doc_id").isNull(), "drop").when(
        F.coalesce(waits, F.lit(False)), "delay").otherwise("dispatch"))


def recover_zombies(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Running documents against the runs: dropped without a run id, delayed while it runs, else failed.

    documents (doc_id, run_id), runs (run_id, finished)
    """
    j = documents.join(runs, "run_id", "left")
    lost = F.col("finished").isNull() | F.col("finished")
    return j.select(
        "doc_id", "run_id",
        F.when(F.col("run_id").isNull(), "drop").when(lost, "recover").otherwise("delay").alias("decision"),
        F.when(F.col("run_id").isNotNull() & lost, F.concat(
            F.lit("Recovered: previous run no longer active (run_id="), "run_id", F.lit(")"))).alias("last_error"))


def sync_decision(connectors: DataFrame, now: Column, timeout: int = STALE_SYNC_SECONDS) -> DataFrame:
    """connectors (status, sync_status, sync_started_at) plus ``decision``: run, run_stale or a skip."""
    started = F.col("sync_started_at")
    fresh = started.isNotNull() & (started + F.make_dt_interval(secs=F.lit(timeout)) > now)
    return connectors.withColumn("decision", F.when(F.col("status") == "paused", "skip_paused").when(
        (F.col("sync_status") == "running") & fresh, "skip_running").when(
        (F.col("sync_status") == "running") & started.isNotNull(), "run_stale").otherwise("run"))


def reindex_plan(documents: DataFrame, listing: DataFrame, force: bool = False) -> DataFrame:
    """Documents that are not deleted plus ``decision``: queue or the reason of a skip.

    documents (doc_id, status, storage_key, content_version), listing (storage_key, etag)
    """
    j = documents.filter(F.col("status") != "deleted").join(listing, "storage_key", "left")
    same = F.lit(not force) & (F.col("etag") != "") & (F.col("etag") == F.col("content_version"))
    return j.withColumn("decision", F.when(F.col("status") == "outdated", "skip_outdated").when(
        is_active(F.col("status")), "skip_active").when(
        F.coalesce("storage_key", F.lit("")) == "", "skip_no_object").when(
        F.coalesce(same, F.lit(False)), "skip_same").otherwise("queue"))


def abort_plan(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Pending and running documents become failed; the run to stop is the row's or the one looked up.

    documents (doc_id, status, run_id), runs (doc_id, active_run_id)
    """
    active = documents.filter(F.col("status").isin("pending", "running"))
    run = F.when(F.col("status") == "running", F.coalesce("run_id", "active_run_id"))
    return active.join(runs, "doc_id", "left").select(
        "doc_id", F.lit("failed").alias("new_status"), F.lit(ABORTED).alias("last_error"), run.alias("stop_run_id"))


def drop_queued(queue: DataFrame, documents: DataFrame) -> DataFrame:
    """Queue without the events of the given documents."""
    return queue.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")


def upload_plan(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Outcome of batches of uploads: (batch_id, idx, outcome).

    files (batch_id, idx, kb_id, source, bad, hook_blocks), documents (kb_id, source, status). A bad file is
    an error and the rest goes on; an active document is a conflict of that file; a hook that objects to
    a new document stops its batch, and later files are skipped. Within a batch the second file of a
    source finds the first one's document active.
    """
    from pyspark.sql import Window

    batch = Window.partitionBy("batch_id").orderBy("idx")
    j = files.join(documents.select("kb_id", "source", "status"), ["kb_id", "source"], "left")
    good = ~F.col("bad")
    nth = F.sum(F.when(good, 1).otherwise(0)).over(Window.partitionBy("batch_id", "kb_id", "source").orderBy("idx"))
    j = j.withColumn("again", good & (nth > 1))
    blocked = good & ~F.col("again") & F.col("status").isNull() & F.col("hook_blocks")
    stopped = F.coalesce(F.max(blocked.cast("int")).over(batch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    outcome = F.when(stopped, "skipped").when(F.col("bad"), "error").when(blocked, "blocked").when(
        F.col("again") | F.coalesce(is_active(F.col("status")), F.lit(False)), "conflict").when(
        F.col("status").isNull(), "insert").otherwise("reuse")
    return j.select("batch_id", "idx", outcome.alias("outcome"))


def manual_actions(documents: DataFrame) -> DataFrame:
    """What a forced failure and a recovery would do to each document."""
    s = F.col("status")
    return documents.select(
        "doc_id", "status",
        F.when(s.isin("uploading", "pending", "running", "deleting"), "failed").otherwise("conflict").alias("force_fail"),
        F.when(s == "running", "requeue_forced").otherwise("conflict").alias("recover"))
