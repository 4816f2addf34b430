"""Status machine, queues and plans over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources.tables import status_events, table
from .catalog_queries import CAT, CONN, catalog, connectors
from .registry import query

_ST = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'indexed' WHEN 'error' THEN 'failed' ELSE 'deleted' END"
_EV = f"ev AS (SELECT event_id, user_id AS doc_id, ts, {_ST} AS status, value, props FROM events)"
# The document rows an event meets: the labelled ones, with the state of the catalog.
_DOCS = f"{CAT}, dd AS (SELECT c.doc_id, c.status FROM cat c JOIN labels USING (doc_id))"


def events(spark, sf):
    return status_events(spark, sf)


def labelled(spark, sf):
    return catalog(spark, sf).select("doc_id", "status").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("status_machine", f"""WITH {_EV} SELECT doc_id, arg_max(status, event_id) AS status, (SELECT CASE WHEN e2.status = 'failed' THEN left(e2.props, 500) END FROM ev e2 WHERE e2.doc_id = ev.doc_id AND e2.status IN ('pending', 'indexed', 'failed') ORDER BY e2.event_id DESC LIMIT 1) AS last_error,
  CAST(arg_max(ts, event_id) FILTER (WHERE status = 'running') AS VARCHAR) AS process_started_at, CAST(arg_max(ts, event_id) FILTER (WHERE status IN ('indexed', 'failed')) AS VARCHAR) AS process_finished_at, count(*) AS n_events FROM ev GROUP BY doc_id""")
def status_machine(spark, sf):
    state = L.current_status(events(spark, sf).withColumnRenamed("props", "error"))
    return state.withColumn("process_started_at", F.col("process_started_at").cast("string")).withColumn(
        "process_finished_at", F.col("process_finished_at").cast("string"))


@query("is_active", f"WITH {_EV} SELECT status, status NOT IN ('indexed', 'failed', 'deleted', 'outdated') AS active, count(*) AS n FROM ev GROUP BY ALL")
def is_active(spark, sf):
    return events(spark, sf).groupBy("status", L.is_active(F.col("status")).alias("active")).agg(F.count("*").alias("n"))


@query("enqueue_guard", f"WITH {_EV}, {_DOCS} SELECT event_id, ev.doc_id, CASE WHEN dd.status IS NULL THEN 'drop_missing' WHEN dd.status = 'deleted' THEN 'drop_deleted' ELSE 'queued' END AS decision, CASE WHEN dd.status NOT IN ('deleted', 'running', 'deleting') THEN 'pending' ELSE dd.status END AS new_status FROM ev LEFT JOIN dd USING (doc_id)")
def enqueue_guard(spark, sf):
    return L.enqueue_guard(events(spark, sf).select("event_id", "doc_id"), labelled(spark, sf)).select(
        "event_id", "doc_id", "decision", "new_status")


@query("event_dedup_delay", "SELECT user_id || '|' || props AS payload, CAST(max(ts) + INTERVAL 10 SECOND AS VARCHAR) AS ready_at FROM events GROUP BY 1")
def event_dedup_delay(spark, sf):
    e = events(spark, sf).select(F.concat_ws("|", "doc_id", "props").alias("payload"), "ts")
    return L.delayed(e).withColumn("ready_at", F.col("ready_at").cast("string"))


# Payloads: small values give broken JSON, the next ones lack the document.
_PAY = """CASE WHEN value < 2 THEN '{"doc_id": ' WHEN value < 4 THEN '{"force": true}' ELSE '{"doc_id": ' || user_id || ', "force": ' || CASE WHEN value > 10 THEN 'true' ELSE 'false' END || '}' END"""


@query("dispatch_decision", f"""WITH {CAT}, q AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'delete' ELSE 'upload' END AS kind, CASE WHEN value >= 4 THEN user_id END AS doc_id, CASE WHEN value >= 4 THEN value > 10 WHEN value >= 2 THEN true ELSE false END AS force FROM events)
  SELECT event_id, kind, q.doc_id, force, CASE WHEN q.doc_id IS NULL THEN 'drop' WHEN status = 'running' OR (kind = 'upload' AND status = 'deleting') THEN 'delay' ELSE 'dispatch' END AS decision FROM q LEFT JOIN cat c ON c.doc_id = q.doc_id""")
def dispatch_decision(spark, sf):
    v = F.col("value")
    payload = F.when(v < 2, '{"doc_id": ').when(v < 4, '{"force": true}').otherwise(F.concat(
        F.lit('{"doc_id": '), "doc_id", F.lit(', "force": '), F.when(v > 10, "true").otherwise("false"), F.lit("}")))
    queue = events(spark, sf).select(
        "event_id", F.when(F.col("status").isin("deleted", "failed"), "delete").otherwise("upload").alias("kind"), payload.alias("payload"))
    return L.dispatch(queue, catalog(spark, sf)).select("event_id", "kind", "doc_id", "force", "decision")


# Runs: the label of a document tells whether its run is over; toxic ones never recorded a run.
_RUN = f"{CAT}, rd AS (SELECT c.doc_id, CASE WHEN l.toxic = 1 THEN NULL ELSE 'run-' || c.doc_id END AS run_id, c.status FROM cat c LEFT JOIN labels l USING (doc_id)), runs AS (SELECT 'run-' || doc_id AS run_id, doc_id, quality = 1 AS finished FROM labels)"


def runs_of(spark, sf):
    labels = table(spark, sf, "labels")
    runs = labels.select(F.concat(F.lit("run-"), "doc_id").alias("run_id"), "doc_id", (F.col("quality") == 1).alias("finished"))
    docs = catalog(spark, sf).join(labels, "doc_id", "left").select(
        "doc_id", "status", F.when(F.coalesce("toxic", F.lit(0)) != 1, F.concat(F.lit("run-"), "doc_id")).alias("run_id"))
    return docs, runs


@query("zombie_recovery", f"WITH {_RUN} SELECT rd.doc_id, rd.run_id, CASE WHEN rd.run_id IS NULL THEN 'drop' WHEN finished IS NULL OR finished THEN 'recover' ELSE 'delay' END AS decision, CASE WHEN rd.run_id IS NOT NULL AND (finished IS NULL OR finished) THEN 'Recovered: previous run no longer active (run_id=' || rd.run_id || ')' END AS last_error FROM rd LEFT JOIN runs ON runs.run_id = rd.run_id WHERE status = 'running'")
def zombie_recovery(spark, sf):
    docs, runs = runs_of(spark, sf)
    return L.recover_zombies(docs.filter(F.col("status") == "running").select("doc_id", "run_id"), runs.select("run_id", "finished"))


@query("stale_sync", f"WITH {CAT}, {CONN} SELECT connector_id, CASE WHEN status = 'paused' THEN 'skip_paused' WHEN sync_status = 'running' AND sync_started_at + INTERVAL 3600 SECOND > n THEN 'skip_running' WHEN sync_status = 'running' AND sync_started_at IS NOT NULL THEN 'run_stale' ELSE 'run' END AS decision FROM conn, (SELECT max(ts) AS n FROM events)")
def stale_sync(spark, sf):
    now = table(spark, sf, "events").agg(F.max("ts").alias("now"))
    return L.sync_decision(connectors(spark, sf).join(F.broadcast(now)), F.col("now")).select("connector_id", "decision")


_KEYED = f"{CAT}, rx AS (SELECT doc_id, CASE WHEN status = 'failed' AND file_size % 2 = 0 THEN 'outdated' ELSE status END AS status, CASE WHEN source_type <> 'web' THEN kb_id || '/' || doc_id END AS storage_key, md5(title) AS content_version FROM cat), lst AS (SELECT lang || '/' || doc_id AS storage_key, CASE WHEN n_chars % 2 = 0 THEN md5(split_part(text, chr(10), 1)) ELSE 'newer' END AS etag FROM documents)"


def stored_docs(spark, sf):
    c = catalog(spark, sf)
    return c.select(
        "doc_id", F.when((F.col("status") == "failed") & (F.col("file_size") % 2 == 0), "outdated").otherwise(F.col("status")).alias("status"),
        F.when(F.col("source_type") != "web", F.concat_ws("/", "kb_id", "doc_id")).alias("storage_key"), F.md5("title").alias("content_version"))


@query("reindex_plan", f"WITH {_KEYED} SELECT doc_id, CASE WHEN status = 'outdated' THEN 'skip_outdated' WHEN status NOT IN ('indexed', 'failed') THEN 'skip_active' WHEN storage_key IS NULL THEN 'skip_no_object' WHEN etag = content_version THEN 'skip_same' ELSE 'queue' END AS decision FROM rx LEFT JOIN lst USING (storage_key) WHERE status <> 'deleted'")
def reindex_plan(spark, sf):
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    listing = table(spark, sf, "documents").select(
        F.concat_ws("/", "lang", "doc_id").alias("storage_key"), F.when(F.col("n_chars") % 2 == 0, F.md5(title)).otherwise("newer").alias("etag"))
    return L.reindex_plan(stored_docs(spark, sf), listing).select("doc_id", "decision")


@query("abort_plan", f"WITH {_RUN} SELECT rd.doc_id, 'failed' AS new_status, 'Aborted' AS last_error, CASE WHEN status = 'running' THEN coalesce(rd.run_id, r.run_id) END AS stop_run_id, (SELECT count(*) FROM events e WHERE e.user_id = rd.doc_id) AS n_dequeued FROM rd LEFT JOIN runs r ON r.doc_id = rd.doc_id WHERE status IN ('pending', 'running')")
def abort_plan(spark, sf):
    docs, runs = runs_of(spark, sf)
    plan = L.abort_plan(docs, runs.select("doc_id", F.col("run_id").alias("active_run_id")))
    queue = events(spark, sf).select("event_id", "doc_id")
    left = L.drop_queued(queue, plan).withColumn("kept", F.lit(True)).select("event_id", "kept")
    gone = queue.join(left, "event_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_dequeued"))
    return plan.join(gone, "doc_id", "left").withColumn("n_dequeued", F.coalesce("n_dequeued", F.lit(0)))


# Uploads: the turns of a conversation are the files of one batch.
_UP = f"""{CAT}, f AS (SELECT conv_id AS batch_id, turn AS idx, 'en' AS kb_id, 'path/src' || (length(text) % 20) || '/' || (conv_id + length(text) % 3) AS source, length(text) % 7 = 0 AS bad, length(text) % 5 = 0 AS hook_blocks FROM conversations),
  j AS (SELECT f.*, c.status, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY batch_id, f.kb_id, f.source ORDER BY idx) AS nth FROM f LEFT JOIN cat c ON c.kb_id = f.kb_id AND c.source = f.source),
  b AS (SELECT *, NOT bad AND nth <= 1 AND status IS NULL AND hook_blocks AS blocked FROM j), s AS (SELECT *, coalesce(bool_or(blocked) OVER (PARTITION BY batch_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM b)"""


@query("upload_upsert", f"WITH {_UP} SELECT batch_id, idx, CASE WHEN stopped THEN 'skipped' WHEN bad THEN 'error' WHEN blocked THEN 'blocked' WHEN nth > 1 OR status NOT IN ('indexed', 'failed', 'deleted', 'outdated') THEN 'conflict' WHEN status IS NULL THEN 'insert' ELSE 'reuse' END AS outcome FROM s")
def upload_upsert(spark, sf):
    n = F.length("text")
    files = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("batch_id"), F.col("turn").alias("idx"), F.lit("en").alias("kb_id"),
        F.concat(F.lit("path/src"), n % 20, F.lit("/"), F.col("conv_id") + n % 3).alias("source"),
        (n % 7 == 0).alias("bad"), (n % 5 == 0).alias("hook_blocks"))
    return L.upload_plan(files, catalog(spark, sf))


@query("recover_fail", f"WITH {CAT} SELECT doc_id, status, CASE WHEN status IN ('uploading', 'pending', 'running', 'deleting') THEN 'failed' ELSE 'conflict' END AS force_fail, CASE WHEN status = 'running' THEN 'requeue_forced' ELSE 'conflict' END AS recover FROM cat")
def recover_fail(spark, sf):
    return L.manual_actions(catalog(spark, sf))


@query("incremental_listing", "SELECT event_id, user_id AS doc_id, CAST(ts AS VARCHAR) AS last_modified FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def incremental_listing(spark, sf):
    from ..sources.readers import newer_than
    listing = events(spark, sf).select("event_id", "doc_id", F.col("ts").alias("last_modified"))
    return newer_than(listing, "2024-01-15 00:00:00").withColumn("last_modified", F.col("last_modified").cast("string"))
