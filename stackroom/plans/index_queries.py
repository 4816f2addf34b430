"""Index maintenance over chunk, band and parent tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import generations as G
from ..operators import index as I
from ..operators import minhash as M
from ..operators import simhash as H
from ..operators.chunking import fixed_chunks
from ..session import shared_dir, spread
from ..sources.tables import documents, status_events, table
from . import sqlbits as S
from .catalog_queries import CAT, CONN, catalog, connectors
from .chunk_queries import tree_of, tree_sql
from .dedup_queries import FP, SIG_DOCS
from .registry import query

# Documents that changed or went: by their last event.
LAST = "lastev AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS et, arg_max(value, event_id) AS val FROM events GROUP BY user_id)"


def last_events(spark, sf):
    return status_events(spark, sf).groupBy("doc_id").agg(
        F.max_by("status", "event_id").alias("status"), F.max_by("value", "event_id").alias("value"))


def changed_docs(spark, sf):
    return last_events(spark, sf).filter(F.col("status") == "indexed").select("doc_id")


def turns(spark, sf):
    """Chunk table of the conversations: (chunk_id, doc_id, kb_id, title, source, text)."""
    return table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("role").alias("kb_id"),
        F.concat(F.lit("conversation "), "conv_id").alias("title"), F.lit("chat").alias("source"), "text")


_TURNS = "turns AS (SELECT conv_id || ':' || turn AS chunk_id, conv_id AS doc_id, role AS kb_id, 'conversation ' || conv_id AS title, 'chat' AS source, text FROM conversations)"


def through_table(spark, current, fresh, changed, key="doc_id"):
    """Write the current rows, replace the changed keys in a further generation and read the table back."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    G.create(current, path, key)
    G.upsert(fresh, changed, path, key)
    return G.read(spark, path, key)


_A, _B = S.windows(200, 20, out="wa"), S.windows(100, 10, out="wb")


@query("chunk_index_sink", f"""WITH {S.DOCS}, {LAST}, {_A}, {_B}, ch AS (SELECT doc_id FROM lastev WHERE et = 'click'),
  allc AS (SELECT doc_id, pos, text, 200 AS chunk_size FROM wa WHERE length(text) >= 30 AND doc_id NOT IN (SELECT doc_id FROM ch) UNION ALL SELECT doc_id, pos, text, 100 FROM wb WHERE length(text) >= 30 AND doc_id IN (SELECT doc_id FROM ch))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_index, CAST(chunk_size AS INTEGER) AS chunk_size, md5(text) AS text_md5 FROM allc""")
def chunk_index_sink(spark, sf):
    docs = spread(documents(spark, sf).select("doc_id", "text"), "doc_id")
    changed = changed_docs(spark, sf)

    def rows(d, size, overlap):
        return fixed_chunks(d, size, overlap).select(
            "doc_id", "chunk_index", F.lit(size).alias("chunk_size"), F.md5("text").alias("text_md5"))

    return through_table(spark, rows(docs, 200, 20), rows(docs.join(changed, "doc_id", "left_semi"), 100, 10), changed)


@query("band_sink", f"WITH {FP} SELECT doc_id || ':0' AS band_id, doc_id, kb_id, 0 AS band_index, b0 AS band_value FROM fp UNION ALL SELECT doc_id || ':1', doc_id, kb_id, 1, b1 FROM fp UNION ALL SELECT doc_id || ':2', doc_id, kb_id, 2, b2 FROM fp UNION ALL SELECT doc_id || ':3', doc_id, kb_id, 3, b3 FROM fp")
def band_sink(spark, sf):
    """Bands of an older state (texts reversed) are stored, then every document is upserted."""
    docs = spread(documents(spark, sf).select("doc_id", "kb_id", "text"), "doc_id")

    def rows(d):
        bands = H.band_rows(H.simhash64(d, "doc_id", "kb_id"), "doc_id", "kb_id")
        return bands.withColumn("band_id", F.concat_ws(":", "doc_id", "band_index"))

    return through_table(spark, rows(docs.withColumn("text", F.reverse("text"))), rows(docs), docs.select("doc_id"))


@query("minhash_sink", f"WITH {SIG_DOCS} SELECT doc_id, kb_id, CAST(i AS INTEGER) AS position, s[i + 1] AS hash FROM sig, range(128) r(i)")
def minhash_sink(spark, sf):
    """Signatures of an older state (texts reversed) are stored, then every document is upserted."""
    docs = spread(documents(spark, sf).select("doc_id", "kb_id", "text"), "doc_id")

    def rows(d):
        return M.minhash128(d, "doc_id", "kb_id").select("doc_id", "kb_id", "signature")

    stored = through_table(spark, rows(docs.withColumn("text", F.reverse("text"))), rows(docs), docs.select("doc_id"))
    return stored.select("doc_id", "kb_id", F.posexplode("signature").alias("position", "hash"))


@query("parent_sink", f"WITH {tree_sql()}, {LAST} SELECT doc_id, chunk_id, parent_id, CAST(level AS INTEGER) AS level, md5(text) AS text_md5 FROM tree WHERE level < 2 AND doc_id NOT IN (SELECT doc_id FROM lastev WHERE et = 'purchase')")
def parent_sink(spark, sf):
    """Ancestors of every document; those of deleted documents are replaced by nothing."""
    parents = tree_of(spark, sf).filter(F.col("level") < 2).select(
        "doc_id", "chunk_id", "parent_id", "level", F.md5("text").alias("text_md5"))
    gone = last_events(spark, sf).filter(F.col("status") == "deleted").select("doc_id")
    return through_table(spark, parents, parents.limit(0), gone)


@query("delete_by_doc", f"WITH {_TURNS}, {LAST} SELECT chunk_id, doc_id FROM turns WHERE doc_id NOT IN (SELECT doc_id FROM lastev WHERE et = 'purchase')")
def delete_by_doc(spark, sf):
    gone = last_events(spark, sf).filter(F.col("status") == "deleted")
    return I.delete_by_doc(turns(spark, sf), gone).select("chunk_id", "doc_id")


@query("payload_update_by_doc", f"WITH {_TURNS}, {LAST} SELECT chunk_id, CASE WHEN et = 'click' THEN t.doc_id + 100000 ELSE t.doc_id END AS doc_id, CASE WHEN et = 'click' THEN 'renamed ' || t.doc_id ELSE title END AS title, source FROM turns t LEFT JOIN lastev USING (doc_id)")
def payload_update_by_doc(spark, sf):
    changes = changed_docs(spark, sf).select(
        "doc_id", (F.col("doc_id") + 100000).alias("new_doc_id"), F.concat(F.lit("renamed "), "doc_id").alias("new_title"),
        F.lit(None).cast("string").alias("new_source"))
    return I.update_payload(turns(spark, sf), changes, ["title", "source", "doc_id"]).select("chunk_id", "doc_id", "title", "source")


@query("purge_artifacts", f"""WITH {_TURNS}, {LAST}, gone AS (SELECT doc_id FROM lastev WHERE et IN ('purchase', 'error')), {tree_sql()}
  SELECT 'chunks' AS artifact, count(*) AS n FROM turns WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'parents', count(*) FROM tree WHERE level < 2 AND doc_id NOT IN (SELECT doc_id FROM gone)
  UNION ALL SELECT 'objects', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)""")
def purge_artifacts(spark, sf):
    gone = last_events(spark, sf).filter(F.col("status").isin("deleted", "failed"))
    kept = I.purge({"chunks": turns(spark, sf), "parents": tree_of(spark, sf).filter(F.col("level") < 2),
                    "objects": documents(spark, sf)}, gone)
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "n") for name, rows in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("soft_hard_delete", f"""WITH {CAT}, {LAST}, req AS (SELECT doc_id, val > 10 AS force FROM lastev),
  plan AS (SELECT r.doc_id, CASE WHEN c.status IS NULL THEN 'missing' WHEN c.status = 'deleted' THEN 'skip' WHEN c.status = 'indexed' AND NOT force THEN 'soft' ELSE 'hard' END AS action FROM req r LEFT JOIN cat c USING (doc_id))
  SELECT c.doc_id, CASE WHEN action = 'soft' THEN 'deleted' ELSE status END AS status, CASE WHEN action = 'soft' THEN 'now' END AS deleted_at FROM cat c LEFT JOIN plan USING (doc_id) WHERE coalesce(action, '') <> 'hard'""")
def soft_hard_delete(spark, sf):
    cat = catalog(spark, sf).withColumn("deleted_at", F.lit(None).cast("string"))
    requests = last_events(spark, sf).select("doc_id", (F.col("value") > 10).alias("force"))
    return I.apply_delete(cat, I.delete_plan(requests, cat), F.lit("now")).select("doc_id", "status", "deleted_at")


@query("cascade_connector_delete", f"WITH {CAT} SELECT doc_id, CASE WHEN connector_id = 'src4' THEN 'deleted' ELSE status END AS status, CASE WHEN connector_id = 'src4' THEN NULL ELSE chunk_count END AS live_chunks FROM cat")
def cascade_connector_delete(spark, sf):
    cat = catalog(spark, sf).withColumn("deleted_at", F.lit(None).cast("string"))
    owned = cat.filter(F.col("connector_id") == "src4").select("doc_id", F.lit("soft").alias("action"))
    after = I.apply_delete(cat, owned, F.lit("now"))
    live = I.delete_by_doc(cat.filter(F.col("chunk_count").isNotNull()), owned).select("doc_id", F.col("chunk_count").alias("live_chunks"))
    return after.join(live, "doc_id", "left").select("doc_id", "status", "live_chunks")


@query("drop_kb", f"""WITH {CAT}, {CONN}, busy AS (SELECT count(*) > 0 AS b FROM conn WHERE kb_id = 'fr' AND sync_status = 'running')
  SELECT 'documents' AS artifact, kb_id, count(*) AS n FROM cat, busy WHERE b OR kb_id <> 'fr' GROUP BY ALL UNION ALL SELECT 'connectors', kb_id, count(*) FROM conn, busy WHERE b OR kb_id <> 'fr' GROUP BY ALL""")
def drop_kb(spark, sf):
    conn = connectors(spark, sf)
    left = I.drop_kb({"documents": catalog(spark, sf), "connectors": conn}, "fr", conn)
    counts = [rows.groupBy("kb_id").agg(F.count("*").alias("n")).withColumn("artifact", F.lit(name)) for name, rows in left.items()]
    return counts[0].unionByName(counts[1])


@query("orphan_chunks", f"WITH {_TURNS} SELECT kb_id, doc_id, count(*) AS n_chunks FROM turns WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL")
def orphan_chunks(spark, sf):
    t = turns(spark, sf)
    return t.join(I.orphans(t, table(spark, sf, "labels")), ["kb_id", "doc_id"]).groupBy("kb_id", "doc_id").agg(
        F.count("*").alias("n_chunks"))




@query("transfer_ownership", f"""WITH {CAT}, {_TURNS}, pr AS (SELECT min(doc_id) AS old_id, max(doc_id) AS new_id FROM cat WHERE status = 'indexed' GROUP BY kb_id, title HAVING count(*) > 1),
  after AS (SELECT c.doc_id, CASE WHEN o.old_id IS NOT NULL THEN 'outdated' WHEN w.new_id IS NOT NULL THEN 'indexed' ELSE c.status END AS status, CASE WHEN w.new_id IS NOT NULL THEN oc.chunk_count ELSE c.chunk_count END AS chunk_count, o.new_id AS duplicate_of
    FROM cat c LEFT JOIN pr o ON o.old_id = c.doc_id LEFT JOIN pr w ON w.new_id = c.doc_id LEFT JOIN cat oc ON oc.doc_id = w.old_id),
  moved AS (SELECT coalesce(new_id, doc_id) AS doc_id, count(*) AS n_moved FROM turns LEFT JOIN pr ON old_id = doc_id GROUP BY 1)
  SELECT a.doc_id, status, chunk_count, duplicate_of, coalesce(n_moved, 0) AS n_turns FROM after a LEFT JOIN moved USING (doc_id)""")
def transfer_ownership(spark, sf):
    cat = catalog(spark, sf).withColumn("duplicate_of", F.lit(None).cast("bigint"))
    pairs = cat.filter(F.col("status") == "indexed").groupBy("kb_id", "title").agg(
        F.min("doc_id").alias("old_id"), F.max("doc_id").alias("new_id")).filter(
        F.col("old_id") != F.col("new_id")).select("old_id", "new_id")
    moved, after = I.transfer_ownership(turns(spark, sf), cat, pairs)
    n = moved.groupBy("doc_id").agg(F.count("*").alias("n_turns"))
    return after.join(n, "doc_id", "left").select(
        "doc_id", "status", "chunk_count", "duplicate_of", F.coalesce("n_turns", F.lit(0)).alias("n_turns"))
