"""Retrieval: dense, sparse, hybrid, merging, reranking, caching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cache as C
from ..operators.chunking import fixed_chunks
from ..operators.dense import dense_topk, dense_topk_in_doc
from ..operators.embed import dense_embed
from ..operators.fusion import hybrid_rsf, rrf_merge, similarity_merge
from ..operators.parents import auto_merge
from ..operators.rerank import rerank
from ..operators.retrieval import drop_orphans, fan_out, response_meta, tool_result
from ..operators.sparse import sparse_topk
from ..session import spread, staged
from ..sources.tables import documents, passages, table, vectors
from . import sqlbits as S
from .registry import query

SIZE, OVERLAP = 200, 20
K = 10

# ---- inputs shared by the queries -------------------------------------------------------------


def search_chunks(spark, sf):
    """(doc_id, kb_id, connector_id, title, chunk_index, chunk_id, text) of the chunked documents."""
    docs = spread(documents(spark, sf), "doc_id")
    return fixed_chunks(docs, SIZE, OVERLAP).withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_index"))


def centroids(spark, sf):
    """One query vector per label: the mean of its vectors."""
    flat = vectors(spark, sf).select(F.col("kb_id").alias("query_id"), F.posexplode("vec").alias("i", "x"))
    return flat.groupBy("query_id", "i").agg(F.avg("x").alias("x")).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("query_id", F.col("s.x").alias("vec"))


def centroid_hits(spark, sf, k=K):
    return dense_topk(centroids(spark, sf), vectors(spark, sf), k)


def sparse_hits(spark, sf, k=K, chunks=None):
    return sparse_topk(passages(spark, sf), search_chunks(spark, sf) if chunks is None else chunks, k)


def dense_text_hits(spark, sf, k=K, chunks=None):
    source = search_chunks(spark, sf) if chunks is None else chunks
    embedded = dense_embed(source.select("kb_id", "chunk_id", "text"), keep_text=False)
    return dense_topk(dense_embed(passages(spark, sf), keep_text=False), embedded, k)


def hybrid_hits(spark, sf, k=K):
    chunks = staged(search_chunks(spark, sf).select("kb_id", "chunk_id", "text"))
    return hybrid_rsf(dense_text_hits(spark, sf, k, chunks), sparse_hits(spark, sf, k, chunks), k)


def with_list_no(hits):
    """Number the lists of a query by knowledge base, as they are asked."""
    return hits.withColumn("list_no", F.dense_rank().over(
        Window.partitionBy("query_id").orderBy("kb_id")))


# ---- the same in SQL --------------------------------------------------------------------------

CHUNKS = S.chunks(SIZE, OVERLAP)
CENTROIDS = """cen AS (SELECT label AS query_id, i, avg(embedding[i+1]::DOUBLE) AS x FROM embeddings, range(64) r(i) GROUP BY ALL),
cen_v AS (SELECT query_id, list(x ORDER BY i) AS q FROM cen GROUP BY query_id)"""
DENSE = CENTROIDS + """, scored AS (SELECT query_id, label AS kb_id, vec_id AS chunk_id,
  round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) AS score FROM cen_v, embeddings),
dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10)"""
SPARSE = f"""{CHUNKS},
ct AS (SELECT kb_id, chunk_id, token, count(*) AS tf FROM (SELECT kb_id, chunk_id, unnest({S.tokens('text')}) AS token FROM chunks) GROUP BY ALL),
qt AS (SELECT query_id, token, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({S.tokens('text')}) AS token FROM benchmark) GROUP BY ALL),
dfq AS (SELECT kb_id, token, count(*) AS df FROM ct WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
nk AS (SELECT kb_id, count(*) AS n FROM chunks GROUP BY kb_id),
sscored AS (SELECT query_id, ct.kb_id, chunk_id, round(sum(qt.tf * (ln(n / df) + 1) * ct.tf), 9) AS score
  FROM ct JOIN qt USING (token) JOIN dfq ON dfq.kb_id = ct.kb_id AND dfq.token = ct.token JOIN nk ON nk.kb_id = ct.kb_id GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sscored) WHERE rank <= 10)"""
HYBRID = f"""{SPARSE}, {S.hashed('chunks', 'kb_id, chunk_id', 'cv')}, {S.hashed('(SELECT item_id AS query_id, text FROM benchmark)', 'query_id', 'qv')},
dd AS (SELECT query_id, kb_id, chunk_id, sum(cv.v * qv.v) AS score FROM cv JOIN qv USING (b) GROUP BY ALL),
dscored AS (SELECT item_id AS query_id, c.kb_id, c.chunk_id, round(coalesce(score, 0), 9) AS score
  FROM chunks c CROSS JOIN benchmark LEFT JOIN dd ON dd.query_id = item_id AND dd.kb_id = c.kb_id AND dd.chunk_id = c.chunk_id),
tdense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, chunk_id) AS rank FROM dscored) WHERE rank <= 10),
nd AS (SELECT query_id, kb_id, chunk_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s FROM (
  SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM tdense WINDOW w AS (PARTITION BY query_id, kb_id))),
ns AS (SELECT query_id, kb_id, chunk_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s FROM (
  SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sparse WINDOW w AS (PARTITION BY query_id, kb_id))),
hscored AS (SELECT query_id, kb_id, chunk_id, round(0.5 * coalesce(nd.s, 0) + 0.5 * coalesce(ns.s, 0), 9) AS score
  FROM nd FULL JOIN ns USING (query_id, kb_id, chunk_id)),
hybrid AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM hscored) WHERE rank <= 10)"""
RRF = f"""{HYBRID},
lists AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY kb_id) AS list_no FROM hybrid),
fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS raw, min(list_no * 1000 + rank) AS first, arg_max(kb_id, list_no) AS kb_id FROM lists GROUP BY ALL),
rrf AS (SELECT query_id, chunk_id, kb_id, round(raw, 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, first) AS INTEGER) AS rank FROM fused) WHERE rank <= 10)"""
OUT = "query_id, kb_id, chunk_id, round(score, 6) AS score, rank"


def shown(hits):
    return hits.select("query_id", "kb_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("dense_topk", f"WITH {DENSE} SELECT {OUT} FROM dense")
def dense_topk_q(spark, sf):
    return shown(centroid_hits(spark, sf))


@query("dense_topk_in_doc", """WITH q AS (SELECT vec_id AS query_id, vec_id // 10 AS doc_id, embedding::DOUBLE[] AS q FROM embeddings),
  s AS (SELECT q.query_id, q.doc_id, vec_id AS chunk_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings e ON e.vec_id // 10 = q.doc_id)
  SELECT query_id, doc_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def dense_topk_in_doc_q(spark, sf):
    v = vectors(spark, sf)
    hits = dense_topk_in_doc(v.select(F.col("chunk_id").alias("query_id"), "doc_id", "vec"), v)
    return hits.withColumn("score", F.round("score", 6))


@query("sparse_idf_topk", f"WITH {SPARSE} SELECT {OUT} FROM sparse")
def sparse_idf_topk(spark, sf):
    return shown(sparse_hits(spark, sf))


@query("hybrid_rsf", f"WITH {HYBRID} SELECT {OUT} FROM hybrid")
def hybrid_rsf_q(spark, sf):
    return shown(hybrid_hits(spark, sf))


@query("rrf_merge", f"WITH {RRF} SELECT query_id, chunk_id, kb_id, score, rank FROM rrf")
def rrf_merge_q(spark, sf):
    return rrf_merge(with_list_no(hybrid_hits(spark, sf)), k=K, payload=("kb_id",))


@query("similarity_merge", f"""WITH {DENSE} SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, rank FROM (
  SELECT query_id, kb_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM dense WHERE score >= 0) WHERE rank <= 10""")
def similarity_merge_q(spark, sf):
    return shown(similarity_merge(centroid_hits(spark, sf), K))


@query("min_score_filter", f"WITH {DENSE} SELECT {OUT} FROM dense WHERE score >= 0.4")
def min_score_filter(spark, sf):
    return shown(centroid_hits(spark, sf).filter(F.col("score") >= 0.4))


_REQ = "CASE query_id % 4 WHEN 0 THEN NULL WHEN 1 THEN [0, 1, 2] WHEN 2 THEN [3, 99] ELSE [query_id] END"


@query("multi_kb_search", f"""WITH {DENSE}, req AS (SELECT query_id, coalesce({_REQ}, (SELECT list(DISTINCT label ORDER BY label) FROM embeddings)) AS kbs FROM cen_v),
  fan AS (SELECT query_id, unnest(kbs) AS kb_id, generate_subscripts(kbs, 1) - 1 AS list_no FROM req)
  SELECT f.query_id, CAST(f.kb_id AS INTEGER) AS kb_id, CAST(f.list_no AS INTEGER) AS list_no, f.kb_id IN (SELECT label FROM embeddings) AS valid, count(d.chunk_id) AS n_hits, round(max(d.score), 6) AS best
  FROM fan f LEFT JOIN dense d ON d.query_id = f.query_id AND d.kb_id = f.kb_id GROUP BY ALL""")
def multi_kb_search(spark, sf):
    q = F.col("query_id")
    wanted = F.when(q % 4 == 1, F.array(*[F.lit(i) for i in (0, 1, 2)])).when(
        q % 4 == 2, F.array(F.lit(3), F.lit(99))).when(q % 4 == 3, F.array(q))
    cen = centroids(spark, sf)
    fan = fan_out(cen.select("query_id", wanted.alias("kb_ids")), vectors(spark, sf))
    return fan.join(dense_topk(cen, vectors(spark, sf), K), ["query_id", "kb_id"], "left").groupBy(
        "query_id", "kb_id", "list_no", "valid").agg(
        F.count("chunk_id").alias("n_hits"), F.round(F.max("score"), 6).alias("best"))


@query("query_embed_once", f"""WITH q AS (SELECT item_id AS query_id, text FROM benchmark), {S.hashed('q', 'query_id', 'h')}
  SELECT query_id, kb_id, n_dims, norm FROM (SELECT query_id, count(*) AS n_dims, round(sqrt(sum(v*v)), 6) AS norm FROM h GROUP BY query_id), (SELECT DISTINCT lang AS kb_id FROM documents)""")
def query_embed_once(spark, sf):
    embedded = dense_embed(passages(spark, sf), keep_text=False).select(
        "query_id", F.size(F.filter("vec", lambda x: x != 0)).cast("long").alias("n_dims"),
        F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))
    fan = fan_out(passages(spark, sf).select("query_id", F.lit(None).cast("array<string>").alias("kb_ids")),
                  documents(spark, sf))
    return embedded.join(fan, "query_id").select("query_id", "kb_id", "n_dims", "norm")


# Two ancestor levels over the vectors of a label: blocks of 40 and of 160 consecutive ids.
_P1 = "label || ':1:' || (vec_id // 40)"
_P2 = "label || ':2:' || (vec_id // 160)"


def vector_parents(spark, sf):
    v = vectors(spark, sf).select(
        "kb_id", F.concat_ws(":", "kb_id", F.lit("1"), (F.col("chunk_id") / 40).cast("long")).alias("p1"),
        F.concat_ws(":", "kb_id", F.lit("2"), (F.col("chunk_id") / 160).cast("long")).alias("p2"))
    first = v.groupBy("p1", "p2").agg(F.count("*").alias("child_count"))
    second = first.groupBy("p2").agg(F.count("*").alias("child_count"))
    return first.select(F.col("p1").alias("parent_chunk_id"), F.col("p2").alias("grandparent_id"), "child_count",
                        F.concat(F.lit("text of "), "p1").alias("parent_text")).unionByName(second.select(
                            F.col("p2").alias("parent_chunk_id"), F.lit(None).cast("string").alias("grandparent_id"),
                            "child_count", F.concat(F.lit("text of "), "p2").alias("parent_text")))


@query("auto_merge", f"""WITH {DENSE},
  l1 AS (SELECT {_P1} AS p1, {_P2} AS p2, count(*) AS n FROM embeddings GROUP BY ALL), l2 AS (SELECT p2, count(*) AS n FROM l1 GROUP BY p2),
  a0 AS (SELECT query_id, kb_id, CAST(chunk_id AS VARCHAR) AS chunk_id, kb_id || ':1:' || (chunk_id // 40) AS pid, score, rank FROM dense),
  g1 AS (SELECT a0.*, l1.n AS cc, l1.p2, count(*) OVER w AS m, min(rank) OVER w AS head FROM a0 JOIN l1 ON a0.pid = l1.p1 WINDOW w AS (PARTITION BY query_id, kb_id, pid)),
  a1 AS (SELECT query_id, kb_id, pid AS chunk_id, p2 AS pid, avg(score) AS score, true AS merged, head AS k1, 0 AS k2 FROM g1 WHERE m / cc >= 0.5 GROUP BY query_id, kb_id, pid, p2, head
    UNION ALL SELECT query_id, kb_id, chunk_id, pid, score, false, head, rank FROM g1 WHERE m / cc < 0.5),
  par AS (SELECT p1 AS pid, p2 AS up, n FROM l1 UNION ALL SELECT p2, NULL, n FROM l2),
  g2 AS (SELECT a1.*, par.n AS cc, par.up, count(*) OVER w AS m, min(k1 * 100 + k2) OVER w AS head FROM a1 JOIN par USING (pid) WINDOW w AS (PARTITION BY query_id, kb_id, a1.pid)),
  a2 AS (SELECT query_id, kb_id, pid AS chunk_id, up AS pid, avg(score) AS score, true AS merged, head AS k1, 0 AS k2 FROM g2 WHERE m / cc >= 0.5 GROUP BY query_id, kb_id, pid, up, head
    UNION ALL SELECT query_id, kb_id, chunk_id, pid, score, merged, head, k1 * 100 + k2 FROM g2 WHERE m / cc < 0.5)
  SELECT query_id, kb_id, chunk_id, pid AS parent_chunk_id, round(score, 12) AS score, merged, CASE WHEN merged THEN 'text of ' || chunk_id ELSE 'chunk ' || chunk_id END AS text,
    CAST(row_number() OVER (PARTITION BY query_id, kb_id ORDER BY k1, k2) AS INTEGER) AS position FROM a2""")
def auto_merge_q(spark, sf):
    hits = centroid_hits(spark, sf).withColumn(
        "parent_chunk_id", F.concat_ws(":", "kb_id", F.lit("1"), (F.col("chunk_id") / 40).cast("long"))).withColumn(
        "chunk_id", F.col("chunk_id").cast("string")).withColumn("text", F.concat(F.lit("chunk "), "chunk_id"))
    return auto_merge(hits, vector_parents(spark, sf), levels=2, threshold=0.5).withColumn("score", F.round("score", 12))


@query("post_topk_orphan_filter", f"""WITH {DENSE}, top AS (SELECT * FROM (SELECT query_id, kb_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM dense) WHERE rank <= 10)
  SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, rank, count(*) OVER (PARTITION BY query_id) AS total_candidates FROM top WHERE chunk_id // 10 IN (SELECT doc_id FROM labels)""")
def post_topk_orphan_filter(spark, sf):
    top = similarity_merge(centroid_hits(spark, sf), K, min_score=-1.0).withColumn(
        "doc_id", (F.col("chunk_id") / 10).cast("long"))
    kept = drop_orphans(top, table(spark, sf, "labels"))
    total = kept.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
    return shown(kept).join(total, "query_id")


RERANK = f"""{SPARSE},
top AS (SELECT * FROM (SELECT query_id, kb_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sparse) WHERE rank <= 10),
cov AS (SELECT t.*, c.text, c.doc_id, b.text AS query, len(list_intersect(list_distinct({S.tokens('b.text')}), {S.tokens('c.text')})) / len(list_distinct({S.tokens('b.text')})) AS rel
  FROM top t JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = t.query_id),
rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rel, 9) DESC, rank) AS INTEGER) AS position FROM cov)"""


def merged_sparse(spark, sf):
    """Merged sparse list with the texts of query and chunk."""
    chunks = staged(search_chunks(spark, sf).select("kb_id", "chunk_id", "doc_id", "title", "connector_id", "text"))
    top = similarity_merge(sparse_hits(spark, sf, chunks=chunks), K)
    return top.join(chunks.drop("kb_id"), "chunk_id").join(
        passages(spark, sf).select("query_id", F.col("text").alias("query")), "query_id")


@query("rerank", f"WITH {RERANK} SELECT query_id, chunk_id, position, round(rel, 6) AS rerank_score, round(score, 6) AS score, false AS fallback FROM rr WHERE position <= 3")
def rerank_q(spark, sf):
    return rerank(merged_sparse(spark, sf)).select(
        "query_id", "chunk_id", "position", "rerank_score", F.round("score", 6).alias("score"), "fallback")


@query("search_response", f"""WITH {RERANK}
  SELECT item_id AS query_id, (SELECT count(*) FROM rr WHERE rr.query_id = item_id) AS total_candidates, (SELECT count(*) FROM rr WHERE rr.query_id = item_id AND (position <= 3 OR length(benchmark.text) % 3 = 0)) AS returned,
   CASE WHEN length(text) > 250 THEN 'similarity' ELSE 'hybrid' END AS search_mode, CASE WHEN length(text) > 250 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS score_threshold,
   CASE WHEN length(text) % 3 = 0 THEN false ELSE true END AS reranked, false AS rerank_fallback, 'disabled' AS cache_status FROM benchmark""")
def search_response(spark, sf):
    n = F.length("text")
    requests = passages(spark, sf).select(
        "query_id", F.when(n > 250, "similarity").alias("mode"), F.when(n > 250, 0.3).alias("min_score"),
        F.when(n % 3 == 0, F.lit(False)).alias("rerank_enabled"))
    hits = merged_sparse(spark, sf)
    return response_meta(hits, requests, rerank(hits), {
        "mode": "hybrid", "min_score": 0.0, "rerank_enabled": True, "cache_enabled": False})


@query("tool_result_shape", f"""WITH {RERANK} SELECT query_id, rr.doc_id, title, chunk_id, round(score, 6) AS score, round(rel, 6) AS rerank_score,
   CASE WHEN connector_id < 'src5' THEN '/api/kb/' || rr.kb_id || '/docs/' || rr.doc_id || '/download' ELSE connector_id END AS source
   FROM rr JOIN docs ON docs.doc_id = rr.doc_id WHERE position <= 3""")
def tool_result_shape(spark, sf):
    hits = rerank(merged_sparse(spark, sf))
    kind = F.when(F.col("connector_id") < "src5", "s3").otherwise("web")
    full = hits.withColumn("source", F.col("connector_id")).withColumn(
        "download_url", X.download_url(F.col("kb_id"), F.col("doc_id"), kind))
    return tool_result(full).select("query_id", "doc_id", "title", "chunk_id", "score", "rerank_score", "source")


# Cache entries: one per event; the text of the payload is the query, the type names the bases.
_ENTRIES = """ent AS (SELECT event_id, props AS query, CASE event_type WHEN 'view' THEN ['en'] WHEN 'click' THEN ['de','en'] WHEN 'error' THEN ['fr','de'] WHEN 'signup' THEN ['es'] ELSE ['es','en','fr'] END AS kb_ids,
  '{"mode":"' || CASE WHEN value > 10 THEN 'hybrid' ELSE 'similarity' END || '"}' AS options, ts AS created_at FROM events),
ent_h AS (SELECT *, sha256(CAST(to_json(list_sort(kb_ids)) AS VARCHAR) || '|' || options) AS bucket_hash FROM ent),
entries AS (SELECT *, sha256(bucket_hash || '|' || query) AS query_hash FROM ent_h)"""


def cache_entries(spark, sf):
    kind = F.col("event_type")

    def ids(*names):
        return F.array(*[F.lit(n) for n in names])

    kb_ids = F.when(kind == "view", ids("en")).when(kind == "click", ids("de", "en")).when(
        kind == "error", ids("fr", "de")).when(kind == "signup", ids("es")).otherwise(ids("es", "en", "fr"))
    options = F.to_json(F.struct(F.when(F.col("value") > 10, "hybrid").otherwise("similarity").alias("mode")))
    e = table(spark, sf, "events").select(
        "event_id", F.col("props").alias("query"), kb_ids.alias("kb_ids"), options.alias("options"),
        F.col("ts").alias("created_at"))
    e = e.withColumn("bucket_hash", C.bucket_hash(F.col("kb_ids"), F.col("options")))
    return e.withColumn("query_hash", C.query_hash(F.col("bucket_hash"), F.col("query")))


@query("cache_keys", f"WITH {_ENTRIES} SELECT bucket_hash, query_hash, count(*) AS n FROM entries GROUP BY ALL")
def cache_keys(spark, sf):
    return cache_entries(spark, sf).groupBy("bucket_hash", "query_hash").agg(F.count("*").alias("n"))


_STORE = f"""{_ENTRIES}, store AS (SELECT query_hash, any_value(bucket_hash) AS bucket_hash, max(event_id) AS event_id, max(created_at) AS created_at, any_value(kb_ids) AS kb_ids FROM entries GROUP BY query_hash)"""


def cache_store(spark, sf):
    """The stored entries: the last write of a key stays."""
    return cache_entries(spark, sf).groupBy("bucket_hash", "query_hash").agg(
        F.max("event_id").alias("event_id"), F.max("created_at").alias("created_at"),
        F.any_value("kb_ids").alias("kb_ids")).withColumn("response", F.concat(F.lit("response "), "event_id"))


@query("cache_lookup", f"""WITH {_STORE}, live AS (SELECT * FROM store WHERE created_at + INTERVAL 3 DAY > (SELECT max(ts) FROM events))
  SELECT e.event_id, e.query_hash, CASE WHEN l.event_id IS NULL THEN NULL ELSE 'response ' || l.event_id END AS response FROM entries e LEFT JOIN live l USING (query_hash)""")
def cache_lookup(spark, sf):
    store = cache_store(spark, sf)
    now = table(spark, sf, "events").agg(F.max("ts").alias("now"))
    live = C.live(store.join(F.broadcast(now)), F.col("now"), ttl=3 * 86400)
    return C.exact_lookup(cache_entries(spark, sf), live).select("event_id", "query_hash", "response")


@query("cache_lookup_semantic", f"""WITH {S.DOCS}, {S.hashed('docs', 'doc_id, kb_id', 'h')}, {S.hashed('(SELECT item_id, text FROM benchmark)', 'item_id', 'q')},
  pairs AS (SELECT doc_id, item_id, round(sum(h.v * q.v), 9) AS score FROM h JOIN q USING (b) GROUP BY ALL)
  SELECT doc_id AS request_id, round(score, 6) AS score, CAST(item_id AS VARCHAR) AS query_hash FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CAST(item_id AS VARCHAR)) AS r FROM pairs WHERE score >= 0.5) WHERE r = 1""")
def cache_lookup_semantic(spark, sf):
    """Documents ask the cache in which the passages are stored."""
    entries = dense_embed(passages(spark, sf), keep_text=False).select(
        F.lit("b").alias("bucket_hash"), F.col("query_id").cast("string").alias("query_hash"), F.col("vec").alias("embedding"))
    docs = spread(documents(spark, sf).select("doc_id", "text"), "doc_id")
    requests = dense_embed(docs, keep_text=False).select(
        F.col("doc_id").alias("request_id"), F.lit("b").alias("bucket_hash"), F.col("vec").alias("embedding"))
    return C.semantic_lookup(requests, entries, threshold=0.5).withColumn("score", F.round("score", 6))


@query("cache_evict", f"WITH {_STORE} SELECT query_hash, event_id FROM store ORDER BY created_at DESC, query_hash DESC LIMIT 100")
def cache_evict(spark, sf):
    return C.evict(cache_store(spark, sf), 100).select("query_hash", "event_id")


@query("cache_invalidate", f"""WITH {_STORE} SELECT 'de' AS kb_id, count(*) FILTER (WHERE list_contains(kb_ids, 'de')) AS cleared_count, count(*) FILTER (WHERE NOT list_contains(kb_ids, 'de')) AS kept FROM store""")
def cache_invalidate(spark, sf):
    kept, cleared = C.invalidate(cache_store(spark, sf), "de")
    return cleared.join(F.broadcast(kept.agg(F.count("*").alias("kept")))).withColumn("kb_id", F.lit("de"))


@query("cache_gate", f"WITH {_ENTRIES} SELECT event_id, query_hash FROM entries WHERE NOT list_contains(kb_ids, 'fr')")
def cache_gate(spark, sf):
    return C.usable(cache_entries(spark, sf), gate=lambda kbs: ~F.array_contains(kbs, "fr")).select("event_id", "query_hash")
