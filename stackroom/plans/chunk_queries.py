"""Chunking of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as K
from ..session import spread
from ..sources.tables import documents, table
from . import sqlbits as S
from .registry import query

SIZES, LEAF_OVERLAP = [600, 200, 60], 10


def docs_of(spark, sf):
    return spread(documents(spark, sf).select("doc_id", "kb_id", "text"), "doc_id")


@query("chunk_fixed", f"WITH {S.DOCS}, {S.windows(200, 20)} SELECT doc_id, CAST(pos AS INTEGER) AS pos, text FROM windows")
def chunk_fixed(spark, sf):
    return K.chunk_fixed(docs_of(spark, sf), 200, 20).select("doc_id", "pos", "text")


@query("chunk_finalize", f"WITH {S.chunks(100, 10)} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks, text FROM chunks")
def chunk_finalize(spark, sf):
    return K.finalize(K.chunk_fixed(docs_of(spark, sf).drop("kb_id"), 100, 10), ["pos"]).drop("pos")


# Greedy packing as a recursion over chunks: the units of a document are a list of lengths.
_UNITS = f"""{S.DOCS}, sen AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {S.strip('x')}), lambda x: x <> '') AS ss FROM docs))),
  un AS (SELECT doc_id, i, j, ws[j*120+1 : j*120+120] AS u FROM (SELECT doc_id, i, ws, unnest(range(CAST(ceil(len(ws)/120.0) AS BIGINT))) AS j FROM (SELECT doc_id, i, {S.words('s')} AS ws FROM sen))),
  doc_u AS (SELECT doc_id, list(len(u) ORDER BY i, j) AS n, list(array_to_string(u, ' ') ORDER BY i, j) AS t FROM un GROUP BY doc_id)"""


@query("chunk_recursive", f"""WITH RECURSIVE {_UNITS},
  ends AS (SELECT doc_id, n, t, len(n) AS m FROM doc_u),
  walk(doc_id, pos, a, e) AS (
    SELECT doc_id, 0, 1, coalesce(list_max(list_filter(range(1, m + 1), lambda x: x = 1 OR list_sum(n[1:x]) <= 120)), 1) FROM ends
    UNION ALL
    SELECT doc_id, pos + 1, b, coalesce(list_max(list_filter(range(b, m + 1), lambda x: x = b OR list_sum(n[b:x]) <= 120)), b) FROM (
      SELECT w.doc_id, pos, n, m, coalesce(list_min(list_filter(range(a + 1, e + 1), lambda x: list_sum(n[x:e]) <= 20 AND list_sum(n[x:e+1]) <= 120)), e + 1) AS b
      FROM walk w JOIN ends USING (doc_id) WHERE e < m))
  SELECT w.doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(t[a:e], ' ') AS text FROM walk w JOIN ends USING (doc_id)""")
def chunk_recursive(spark, sf):
    return K.chunk_recursive(docs_of(spark, sf).drop("kb_id"), 120, 20)


@query("chunk_semantic", f"""WITH {S.DOCS}, sen AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {S.strip('x')}), lambda x: x <> '') AS ss FROM docs))),
  arnd AS (SELECT doc_id, i, concat_ws(' ', lag(s) OVER w, s, lead(s) OVER w) AS text FROM sen WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  {S.hashed('arnd', 'doc_id, i', 'v')},
  sim AS (SELECT a.doc_id, a.i, sum(a.v * b.v) AS c FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.b = b.b GROUP BY ALL),
  dist AS (SELECT x.doc_id, x.i, round(1.0 - coalesce(c, 0), 9) AS d FROM sen x JOIN sen y ON x.doc_id = y.doc_id AND y.i = x.i + 1 LEFT JOIN sim ON sim.doc_id = x.doc_id AND sim.i = x.i),
  lim AS (SELECT doc_id, round(quantile_cont(d, 0.8), 9) AS lim FROM dist GROUP BY doc_id),
  cut AS (SELECT s.doc_id, s.i, s.s, coalesce(sum(CASE WHEN d > lim THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM sen s LEFT JOIN dist USING (doc_id, i) LEFT JOIN lim USING (doc_id))
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, string_agg(s, ' ' ORDER BY i) AS text FROM cut GROUP BY doc_id, pos""")
def chunk_semantic(spark, sf):
    return K.chunk_semantic(docs_of(spark, sf).drop("kb_id"), 0.8)


@query("chunk_code")
def chunk_code(spark, sf):
    return K.chunk_code(docs_of(spark, sf).drop("kb_id"), 1500)


def tree_sql() -> str:
    def level(k: int, size: int, overlap: int, source: str) -> str:
        step = size - overlap
        return f"""w{k} AS (SELECT doc_id, path, {S.words('text')} AS ws FROM {source}),
n{k} AS (SELECT doc_id, path AS parent, list_append(path, i) AS path, array_to_string(ws[i*{step}+1 : i*{step}+{size}], ' ') AS text FROM (
  SELECT *, unnest(range(CASE WHEN len(ws)=0 THEN 0 WHEN len(ws)<={size} THEN 1 ELSE CAST(ceil((len(ws)-{size})/{step}.0) AS BIGINT)+1 END)) AS i FROM w{k}))"""
    parts = [level(0, SIZES[0], 0, "(SELECT doc_id, []::BIGINT[] AS path, text FROM docs)"),
             level(1, SIZES[1], 0, "n0"), level(2, SIZES[2], LEAF_OVERLAP, "n1")]
    return f"""{S.DOCS}, {', '.join(parts)},
nodes AS (SELECT doc_id, 0 AS level, NULL::BIGINT[] AS parent, path, text FROM n0 UNION ALL SELECT doc_id, 1, parent, path, text FROM n1 UNION ALL SELECT doc_id, 2, parent, path, text FROM n2),
num AS (SELECT *, doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY level, path) - 1) AS chunk_id FROM nodes),
tree AS (SELECT c.doc_id, c.level, c.path, c.chunk_id, p.chunk_id AS parent_id, c.text FROM num c LEFT JOIN num p ON p.doc_id = c.doc_id AND p.path = c.parent)"""


def tree_of(spark, sf):
    return K.chunk_hierarchical(docs_of(spark, sf), SIZES, LEAF_OVERLAP)


@query("chunk_hierarchical", f"WITH {tree_sql()} SELECT doc_id, CAST(level AS INTEGER) AS level, chunk_id, parent_id, text FROM tree")
def chunk_hierarchical(spark, sf):
    return tree_of(spark, sf).select("doc_id", "level", "chunk_id", "parent_id", "text")


@query("parent_child_count", f"""WITH {tree_sql()},
  cc AS (SELECT parent_id, count(*) AS n FROM tree WHERE parent_id IS NOT NULL AND (level < 2 OR length({S.strip('text')}) >= 30) GROUP BY parent_id)
  SELECT doc_id, chunk_id, CAST(level AS INTEGER) AS level, t.parent_id, CAST(n AS INTEGER) AS child_count,
    CAST(row_number() OVER (PARTITION BY doc_id, level ORDER BY path) - 1 AS INTEGER) AS chunk_index FROM tree t JOIN cc ON cc.parent_id = t.chunk_id WHERE level < 2""")
def parent_child_count(spark, sf):
    return K.parent_rows(tree_of(spark, sf), leaf_level=2).select(
        "doc_id", "chunk_id", "level", "parent_id", "child_count", "chunk_index")


@query("chunk_atomic", f"""WITH src AS (SELECT conv_id AS doc_id, turn, CASE role WHEN 'user' THEN 'table' ELSE 'text' END AS content_type, text FROM conversations),
  w AS (SELECT *, {S.words('text')} AS ws FROM src WHERE content_type = 'text'),
  pieces AS (SELECT doc_id, 0 AS grp, turn, i AS pos, array_to_string(ws[i*40+1 : i*40+50], ' ') AS text FROM (
      SELECT *, unnest(range(CASE WHEN len(ws)=0 THEN 0 WHEN len(ws)<=50 THEN 1 ELSE CAST(ceil((len(ws)-50)/40.0) AS BIGINT)+1 END)) AS i FROM w)
    UNION ALL SELECT doc_id, 1, turn, 0, text FROM src WHERE content_type = 'table')
  SELECT doc_id, CASE grp WHEN 1 THEN 'atomic' ELSE 'fixed' END AS chunk_strategy, text,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, turn, pos) - 1 AS INTEGER) AS chunk_index,
    CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks FROM pieces WHERE length({S.strip('text')}) >= 30""")
def chunk_atomic(spark, sf):
    src = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", F.when(F.col("role") == "user", "table").otherwise("text").alias("content_type"), "text")
    split = K.chunk_fixed(src.filter(~K.is_atomic(F.col("content_type"))).select(
        "doc_id", F.lit(0).alias("grp"), "turn", "text"), 50, 10)
    whole = src.filter(K.is_atomic(F.col("content_type"))).select(
        "doc_id", F.lit(1).alias("grp"), "turn", F.lit(0).alias("pos"), "text")
    return K.finalize(split.unionByName(whole), ["grp", "turn", "pos"]).select(
        "doc_id", F.when(F.col("grp") == 1, "atomic").otherwise("fixed").alias("chunk_strategy"), "text",
        "chunk_index", "total_chunks")


@query("chunk_config_check", """WITH c AS (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) % 10000 AS a, CAST(o_custkey AS BIGINT) % 1200 AS b, CAST(o_orderkey AS BIGINT) % 200 AS overlap FROM orders)
  SELECT o_orderkey, reason FROM (SELECT o_orderkey, CASE WHEN a <= b THEN 'not strictly descending' WHEN a < 64 OR a > 8192 OR b < 64 OR b > 8192 THEN 'size out of range'
    WHEN overlap > b * 0.15::DOUBLE THEN 'overlap above 15%' END AS reason FROM c) WHERE reason IS NOT NULL""")
def chunk_config_check(spark, sf):
    # As the cast of the SQL: a half goes to the even neighbour.
    whole = F.rint("o_totalprice").cast("long")
    configs = table(spark, sf, "orders").select(
        "o_orderkey", F.array((whole % 10000).cast("int"), (F.col("o_custkey") % 1200).cast("int")).alias("sizes"),
        (F.col("o_orderkey") % 200).alias("overlap"))
    return K.config_violations(configs).select("o_orderkey", "reason")


@query("no_indexable_content", f"WITH {S.chunks(200, 20)} SELECT doc_id, 'no indexable content' AS last_error FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM chunks)")
def no_indexable_content(spark, sf):
    docs = docs_of(spark, sf)
    return docs.join(K.fixed_chunks(docs, 200, 20), "doc_id", "left_anti").select(
        "doc_id", F.lit("no indexable content").alias("last_error"))
