"""Listings, counts and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import settings as G
from ..sources.tables import EPOCH, documents, status_events, table
from .registry import query

# ---- entities derived from the tables -----------------------------------------------------------

_N = "CAST(substr(connector_id, 4) AS INTEGER)"
_TYPE = f"CASE WHEN {_N} < 5 THEN 's3' WHEN {_N} < 10 THEN 'web' WHEN {_N} < 15 THEN 'github' ELSE 'confluence' END"
CAT = f"""cat_ev AS (SELECT user_id, arg_max(event_type, event_id) AS et, max(ts) AS last_ts FROM events GROUP BY user_id),
cat AS (SELECT doc_id, kb_id, connector_id, title, {_TYPE} AS source_type, 'path/' || connector_id || '/' || doc_id AS source,
  CASE et WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'deleted' ELSE 'indexed' END AS status,
  CASE WHEN coalesce(et, 'click') = 'click' THEN n_chars // 500 END AS chunk_count, CASE WHEN {_N} < 5 OR {_N} >= 10 THEN n_chars END AS file_size,
  TIMESTAMP '{EPOCH}' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at, coalesce(last_ts, TIMESTAMP '{EPOCH}' + to_minutes(CAST(doc_id AS INTEGER))) AS updated_at
  FROM (SELECT doc_id, lang AS kb_id, source AS connector_id, split_part(text, chr(10), 1) AS title, n_chars FROM documents) LEFT JOIN cat_ev ON user_id = doc_id)"""
CONN = f"""conn AS (SELECT connector_id, min(kb_id) AS kb_id, 'Connector ' || upper(connector_id) AS name, {_TYPE} AS source_type, CASE WHEN {_N} % 2 = 0 THEN '0 * * * *' END AS sync_schedule,
  CASE {_N} % 4 WHEN 0 THEN 'running' ELSE 'idle' END AS sync_status, CASE {_N} % 5 WHEN 0 THEN 'paused' WHEN 1 THEN 'error' ELSE 'active' END AS status, min(created_at) AS created_at,
  CASE WHEN {_N} % 3 <> 0 THEN max(created_at) END AS last_synced_at, CASE WHEN {_N} % 8 <> 0 THEN max(updated_at) END AS sync_started_at FROM cat GROUP BY connector_id)"""
KBS = """kbs AS (SELECT kb_id, upper(kb_id) AS kb_name, 'Texts in ' || kb_id AS description, list_sort(list(DISTINCT source_type)) AS tags FROM cat GROUP BY kb_id)"""


def _number():
    return F.substring("connector_id", 4, 9).cast("int")


def _type():
    n = _number()
    return F.when(n < 5, "s3").when(n < 10, "web").when(n < 15, "github").otherwise("confluence")


def catalog(spark, sf):
    """(doc_id, kb_id, connector_id, title, source_type, source, status, chunk_count, file_size, created_at, updated_at)"""
    last = status_events(spark, sf).groupBy("doc_id").agg(
        F.max_by("status", "event_id").alias("status"), F.max("ts").alias("last_ts"))
    chars = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.col("lang").alias("kb_id"), F.col("source").alias("connector_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    d = chars.join(last, "doc_id", "left")
    status = F.coalesce("status", F.lit("indexed"))
    created = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    n = _number()
    return d.select(
        "doc_id", "kb_id", "connector_id", "title", _type().alias("source_type"),
        F.concat(F.lit("path/"), "connector_id", F.lit("/"), "doc_id").alias("source"), status.alias("status"),
        F.when(status == "indexed", F.expr("n_chars div 500")).alias("chunk_count"),
        F.when((n < 5) | (n >= 10), F.col("n_chars")).alias("file_size"),
        created.alias("created_at"), F.coalesce("last_ts", created).alias("updated_at"))


def connectors(spark, sf):
    n = _number()
    g = catalog(spark, sf).groupBy("connector_id").agg(
        F.min("kb_id").alias("kb_id"), F.min("created_at").alias("created_at"), F.max("created_at").alias("newest"),
        F.max("updated_at").alias("touched"))
    return g.select(
        "connector_id", "kb_id", F.concat(F.lit("Connector "), F.upper("connector_id")).alias("name"), _type().alias("source_type"),
        F.when(n % 2 == 0, "0 * * * *").alias("sync_schedule"), F.when(n % 4 == 0, "running").otherwise("idle").alias("sync_status"),
        F.when(n % 5 == 0, "paused").when(n % 5 == 1, "error").otherwise("active").alias("status"), "created_at",
        F.when(n % 3 != 0, F.col("newest")).alias("last_synced_at"), F.when(n % 8 != 0, F.col("touched")).alias("sync_started_at"))


def knowledge_bases(spark, sf):
    return catalog(spark, sf).groupBy("kb_id").agg(F.array_sort(F.collect_set("source_type")).alias("tags")).select(
        "kb_id", F.upper("kb_id").alias("kb_name"), F.concat(F.lit("Texts in "), "kb_id").alias("description"), "tags")


# ---- documents ----------------------------------------------------------------------------------

_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in C.COUNTED)
_OTHER = "count(*) FILTER (WHERE status NOT IN (" + ", ".join(f"'{s}'" for s in C.COUNTED) + ")) AS other, count(*) AS total"


@query("status_counts", f"WITH {CAT} SELECT connector_id, {_COUNTS}, {_OTHER} FROM cat GROUP BY connector_id")
def status_counts(spark, sf):
    return C.status_counts(catalog(spark, sf), "connector_id")


@query("all_kb_status", f"WITH {CAT}, {KBS} SELECT kb_id, {_COUNTS}, {_OTHER} FROM kbs JOIN cat USING (kb_id) GROUP BY kb_id")
def all_kb_status(spark, sf):
    return C.all_status(knowledge_bases(spark, sf), catalog(spark, sf), "kb_id")


def _page_sql(where: str, order: str, size: int, offset: int) -> str:
    return f"""WITH {CAT}, hits AS (SELECT * FROM cat WHERE status <> 'deleted' AND {where})
  SELECT doc_id, title, status, chunk_count, file_size, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY {order}, doc_id LIMIT {size} OFFSET {offset}"""


_PAGE = ["doc_id", "title", "status", "chunk_count", "file_size", "total"]


@query("list_docs_page", _page_sql("kb_id = 'en' AND source_type = 's3' AND (title ILIKE '%the%' OR source ILIKE '%the%' OR CAST(doc_id AS VARCHAR) ILIKE '%the%')", "updated_at DESC", 20, 20))
def list_docs_page(spark, sf):
    return C.list_docs_page(catalog(spark, sf), page=2, kb_id="en", source_type="s3", search="the").select(*_PAGE)


@query("list_all_docs_page", _page_sql("status = 'indexed' AND (title ILIKE '%an%' OR source ILIKE '%an%')", "chunk_count DESC NULLS LAST", 100, 0))
def list_all_docs_page(spark, sf):
    return C.list_docs_page(catalog(spark, sf), page_size=500, sort_by="chunk_count", search="an", search_id=False,
                            status="indexed").select(*_PAGE)


@query("list_connector_docs_page", _page_sql("connector_id = 'src7'", "file_size ASC NULLS LAST", 15, 15))
def list_connector_docs_page(spark, sf):
    return C.list_docs_page(catalog(spark, sf), page=2, page_size=15, sort_by="file_size", descending=False,
                            connector_id="src7").select(*_PAGE)


@query("list_docs", f"WITH {CAT} SELECT doc_id, kb_id, status, CAST(created_at AS VARCHAR) AS created_at FROM cat WHERE status = 'indexed'")
def list_docs(spark, sf):
    return C.list_docs(catalog(spark, sf), status="indexed").select(
        "doc_id", "kb_id", "status", F.col("created_at").cast("string").alias("created_at"))


@query("list_kbs", f"WITH {CAT}, {KBS} SELECT kb_id, kb_name, description, array_to_string(tags, ',') AS tags FROM kbs")
def list_kbs(spark, sf):
    return C.list_kbs(knowledge_bases(spark, sf), "kb_name", True).withColumn("tags", F.array_join("tags", ","))


@query("list_connectors", f"WITH {CAT}, {CONN} SELECT connector_id, name, status, CAST(last_synced_at AS VARCHAR) AS last_synced_at FROM conn WHERE kb_id IN ('de', 'en') AND sync_schedule IS NOT NULL AND (lower(name) LIKE '%src1%' OR lower(connector_id) LIKE '%src1%')")
def list_connectors(spark, sf):
    return C.list_connectors(connectors(spark, sf), ["de", "en"], has_schedule=True, search="SRC1",
                             sort_by="last_synced_at").select(
        "connector_id", "name", "status", F.col("last_synced_at").cast("string").alias("last_synced_at"))


@query("lookup_doc", f"WITH {CAT}, w AS (SELECT DISTINCT user_id AS doc_id FROM events) SELECT w.doc_id, c.source, c.status, c.doc_id IS NOT NULL AS known FROM w LEFT JOIN cat c USING (doc_id)")
def lookup_doc(spark, sf):
    wanted = status_events(spark, sf).select("doc_id").distinct()
    found = catalog(spark, sf).select("doc_id", "source", "status", F.lit(True).alias("known"))
    return wanted.join(found, "doc_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query("pending_docs", f"WITH {CAT} SELECT connector_id, count(*) FILTER (WHERE status NOT IN ('indexed','failed','deleted','deleting','outdated')) AS n_pending, count(*) FILTER (WHERE status IN ('pending','running')) AS n_active FROM cat GROUP BY connector_id")
def pending_docs(spark, sf):
    return C.pending(catalog(spark, sf), "connector_id")


@query("register_kb", f"""WITH {CAT}, {KBS}, req AS (SELECT lower(n_name) AS kb_id, n_name AS kb_name, NULL::VARCHAR AS description, ['nation'] AS tags FROM nation UNION ALL SELECT kb_id, NULL, 'renamed ' || kb_id, NULL FROM kbs)
  SELECT kb_id, coalesce(r.kb_name, k.kb_name) AS kb_name, coalesce(r.description, k.description) AS description, array_to_string(coalesce(r.tags, k.tags), ',') AS tags FROM kbs k FULL JOIN req r USING (kb_id)""")
def register_kb(spark, sf):
    kbs = knowledge_bases(spark, sf)
    new = table(spark, sf, "nation").select(
        F.lower("n_name").alias("kb_id"), F.col("n_name").alias("kb_name"), F.lit(None).cast("string").alias("description"),
        F.array(F.lit("nation")).alias("tags"))
    update = kbs.select("kb_id", F.lit(None).cast("string").alias("kb_name"), F.concat(F.lit("renamed "), "kb_id").alias("description"),
                        F.lit(None).cast("array<string>").alias("tags"))
    return C.register_kbs(kbs, new.unionByName(update)).withColumn("tags", F.array_join("tags", ","))


@query("sync_status", f"WITH {CAT}, {CONN}, n AS (SELECT connector_id, {_COUNTS}, {_OTHER} FROM cat GROUP BY connector_id) SELECT c.connector_id, sync_status, CAST(last_synced_at AS VARCHAR) AS last_synced_at, indexed, failed, total FROM conn c JOIN n USING (connector_id)")
def sync_status(spark, sf):
    counts = C.status_counts(catalog(spark, sf), "connector_id")
    return connectors(spark, sf).join(counts, "connector_id").select(
        "connector_id", "sync_status", F.col("last_synced_at").cast("string").alias("last_synced_at"), "indexed", "failed", "total")


@query("kb_tags", f"WITH {CAT}, {KBS} SELECT tag, count(*) AS n_kbs, count(*) FILTER (WHERE list_contains(tags, 'web')) AS n_with_web FROM (SELECT unnest(tags) AS tag, tags FROM kbs) GROUP BY tag")
def kb_tags(spark, sf):
    return knowledge_bases(spark, sf).select(F.explode("tags").alias("tag"), "tags").groupBy("tag").agg(
        F.count("*").alias("n_kbs"), F.count_if(F.array_contains("tags", "web")).alias("n_with_web"))


# ---- settings: every document sends one override, the last per key stays -------------------------

KEYS = ["chunking.chunk_size", "chunking.chunk_overlap", "dedup.minhash.jaccard_threshold", "retrieval.top_k", "redis.url",
        "dedup.enabled", "chunking.strategy", "dedup.simhash.hamming_similar_threshold", "chunking.nope", "retrieval.auto_merge.merge_threshold"]
VALUES = ["512", "64", "0.7", "5", "x", "false", "semantic", "25", "1", "abc"]
_KEYS, _VALUES = str(KEYS), str(VALUES)
OVR = f"""sent AS (SELECT lang AS kb_id, doc_id, ({_KEYS})[CAST(n_chars % 10 AS INTEGER) + 1] AS key, CASE WHEN n_chars % 3 = 0 THEN CAST(n_chars % 9000 AS VARCHAR) ELSE ({_VALUES})[CAST(n_chars % 10 AS INTEGER) + 1] END AS value FROM documents),
ovr AS (SELECT kb_id, key, arg_max(value, doc_id) AS value FROM sent GROUP BY ALL)"""
_RULES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in G.RULES)
RULES = f"rules(key, type, dflt, low, high, allowed, overridable) AS (VALUES {_RULES})"


def sent_overrides(spark, sf):
    n = F.col("n_chars")
    pick = (n % 10).cast("int")
    keys, values = F.array(*[F.lit(k) for k in KEYS]), F.array(*[F.lit(v) for v in VALUES])
    return table(spark, sf, "documents").select(
        F.col("lang").alias("kb_id"), "doc_id", F.get(keys, pick).alias("key"),
        F.when(n % 3 == 0, (n % 9000).cast("string")).otherwise(F.get(values, pick)).alias("value"))


def overrides(spark, sf):
    return sent_overrides(spark, sf).groupBy("kb_id", "key").agg(F.max_by("value", "doc_id").alias("value"))


@query("resolve_settings", f"WITH {OVR}, {RULES} SELECT k.kb_id, r.key, coalesce(o.value, dflt) AS value, o.value IS NOT NULL AS overridden FROM (SELECT DISTINCT lang AS kb_id FROM documents) k CROSS JOIN rules r LEFT JOIN ovr o ON o.kb_id = k.kb_id AND o.key = r.key")
def resolve_settings(spark, sf):
    return G.resolve(documents(spark, sf), overrides(spark, sf), G.rule_table(spark))


@query("overlap_check", f"WITH {OVR}, {RULES}, s AS (SELECT k.kb_id, coalesce(a.value, '1024') AS chunk_size, coalesce(b.value, '128') AS chunk_overlap FROM (SELECT DISTINCT lang AS kb_id FROM documents) k LEFT JOIN ovr a ON a.kb_id = k.kb_id AND a.key = 'chunking.chunk_size' LEFT JOIN ovr b ON b.kb_id = k.kb_id AND b.key = 'chunking.chunk_overlap') SELECT * FROM s WHERE TRY_CAST(chunk_overlap AS INTEGER) > TRY_CAST(chunk_size AS INTEGER) * 0.15::DOUBLE")
def overlap_check(spark, sf):
    return G.overlap_violations(G.resolve(documents(spark, sf), overrides(spark, sf), G.rule_table(spark)))


@query("validate_overrides", f"""WITH {OVR}, {RULES} SELECT kb_id, key, value, reason FROM (SELECT s.kb_id, s.key, s.value, CASE WHEN NOT (starts_with(s.key, 'ingestion.') OR starts_with(s.key, 'chunking.') OR starts_with(s.key, 'dedup.') OR starts_with(s.key, 'retrieval.')) THEN 'not overridable'
   WHEN type IS NULL THEN 'unknown key' WHEN NOT overridable THEN 'not overridable'
   WHEN (type = 'int' AND TRY_CAST(s.value AS BIGINT) IS NULL) OR (type = 'float' AND TRY_CAST(s.value AS DOUBLE) IS NULL) OR (type = 'bool' AND s.value NOT IN ('true', 'false')) OR (type = 'enum' AND NOT list_contains(string_split(allowed, '|'), s.value)) THEN 'bad value'
   WHEN TRY_CAST(s.value AS DOUBLE) < low OR TRY_CAST(s.value AS DOUBLE) > high THEN 'out of range' END AS reason FROM sent s LEFT JOIN rules r USING (key)) WHERE reason IS NOT NULL""")
def validate_overrides(spark, sf):
    return G.violations(sent_overrides(spark, sf), G.rule_table(spark))


@query("override_merge", f"""WITH {OVR}, ch AS (SELECT kb_id, key, CASE WHEN length(value) > 3 THEN NULL ELSE value || '0' END AS value FROM ovr WHERE key LIKE 'chunking%' UNION ALL SELECT DISTINCT lang, 'dedup.added', 'true' FROM documents)
  SELECT coalesce(o.kb_id, c.kb_id) AS kb_id, coalesce(o.key, c.key) AS key, CASE WHEN c.key IS NOT NULL THEN c.value ELSE o.value END AS value FROM ovr o FULL JOIN ch c ON o.kb_id = c.kb_id AND o.key = c.key
  WHERE CASE WHEN c.key IS NOT NULL THEN c.value ELSE o.value END IS NOT NULL""")
def override_merge(spark, sf):
    current = overrides(spark, sf)
    edits = current.filter(F.col("key").startswith("chunking")).select(
        "kb_id", "key", F.when(F.length("value") <= 3, F.concat("value", F.lit("0"))).alias("value"))
    added = documents(spark, sf).select("kb_id").distinct().select(
        "kb_id", F.lit("dedup.added").alias("key"), F.lit("true").alias("value"))
    return G.patch(current, edits.unionByName(added))
