"""Tokens, titles, names and vectors of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import cosine, norm
from ..operators.dictionary import dictionary_tokens, read_dictionary
from ..operators.embed import dense_embed, dimension_violations
from ..operators.sparse import sparse_tf
from ..session import shared_dir, spread
from ..sources.tables import documents, passages, table, vectors
from . import sqlbits as S
from .registry import query


@query("word_tokens", f"""WITH {S.DOCS} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens,
  md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {S.tokens('text')} AS t FROM docs)""")
def word_tokens(spark, sf):
    t = X.word_tokens(F.col("text"))
    return documents(spark, sf).select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("ws_tokens", f"""WITH {S.DOCS} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens,
  CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5
  FROM (SELECT doc_id, {S.words('lower(text)')} AS t FROM docs)""")
def ws_tokens(spark, sf):
    return documents(spark, sf).select("doc_id", X.ws_tokens(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"))


# The dictionary is derived from the data: the two-word beginnings of passages.
_DICT = f"""dict AS (SELECT DISTINCT ws[1] || ' ' || ws[2] AS e FROM (
  SELECT {S.words('lower(text)')} AS ws FROM benchmark) WHERE len(ws) >= 2)"""


@query("user_dict_tokens", f"""WITH {S.DOCS}, {_DICT}, t AS (
  SELECT doc_id, ' ' || array_to_string({S.words('lower(text)')}, '  ') || ' ' AS p FROM docs)
  SELECT doc_id, e AS expression, CAST((length(p) - length(replace(p, m, ''))) / length(m) AS BIGINT) AS n
  FROM t, (SELECT e, ' ' || replace(e, ' ', '  ') || ' ' AS m FROM dict) WHERE contains(p, m)""")
def user_dict_tokens(spark, sf):
    w = X.ws_tokens(F.col("text"))
    entries = passages(spark, sf).select(w.alias("w")).filter(F.size("w") >= 2).select(
        F.concat(F.col("w")[0], F.lit(" "), F.col("w")[1]).alias("e")).distinct()
    return dictionary_counts(documents(spark, sf), entries)


# A dictionary file with entries of two, three and five words, a comment and a line without a tag.
_LONG = f"""entries AS (SELECT DISTINCT array_to_string(ws[1:k], ' ') AS e FROM (SELECT {S.words('lower(text)')} AS ws FROM benchmark), (VALUES (2), (3), (5)) AS v(k) WHERE len(ws) >= k),
pat AS (SELECT string_agg(regexp_escape(e) || ' ', '|' ORDER BY length(e) DESC, e) || '|[^ ]+ ' AS p FROM entries)"""


@query("dictionary_tokens", f"""WITH {S.DOCS}, {_LONG},
  t AS (SELECT doc_id, list_transform(regexp_extract_all(array_to_string({S.words('lower(text)')}, ' ') || ' ', p), lambda x: left(x, length(x) - 1)) AS t FROM docs, pat)
  SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_filter(t, lambda x: contains(x, ' '))) AS BIGINT) AS n_kept, md5(array_to_string(t, '|')) AS tokens_md5 FROM t""")
def dictionary_tokens_q(spark, sf):
    """Documents cut into tokens with a dictionary read from a file."""
    path = f"{shared_dir(spark)}/dictionary-{uuid.uuid4().hex}"
    w = X.ws_tokens(F.col("text"))
    cuts = passages(spark, sf).select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), w.alias("w")) for k in (2, 3, 5)])).alias("c")).select("c.*").where("size(w) >= k")
    lines = cuts.select(F.concat(F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.lit("\tNNP")).alias("value"))
    odd = lines.sparkSession.createDataFrame([("# of the\tNNP",), ("and the",), ("",)], "value string")
    lines.distinct().unionByName(odd).write.text(path)
    got = dictionary_tokens(documents(spark, sf), read_dictionary(spark, path), "doc_id")
    return got.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                      F.size(F.filter("tokens", lambda t: t.contains(" "))).cast("long").alias("n_kept"),
                      F.md5(F.array_join("tokens", "|")).alias("tokens_md5"))


def dictionary_counts(docs, entries):
    """How often each dictionary expression is kept as one token, per document.

    Two-word windows of a document are matched with the dictionary by an equi-join, so neither side
    has to fit into memory. A window takes both its words, so a word repeated k times in a row holds its own pair k / 2 times,
    rounded down; windows of two different words never overlap their like.
    """
    def kept_pairs(t):
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))

        def of_run(b, at, p):
            word, after = F.get(t, at), F.coalesce(F.get(b, p + 1), F.size(t))
            pair = lambda other: F.concat(word, F.lit(" "), other)
            own = F.array_repeat(pair(word), ((after - at) / 2).cast("int"))
            return F.when(after < F.size(t), F.concat(own, F.array(pair(F.get(t, after))))).otherwise(own)

        return F.when(F.size(t) > 1, X.let(starts, lambda b: F.flatten(F.transform(b, lambda at, p: of_run(b, at, p)))))

    pairs = docs.select("doc_id", X.ws_tokens(F.col("text")).alias("t")).select(
        "doc_id", F.explode(X.token_counts(kept_pairs(F.col("t")))).alias("p"))
    return pairs.select("doc_id", F.col("p.token").alias("e"), F.col("p.tf").alias("n")).join(entries, "e").select(
        "doc_id", F.col("e").alias("expression"), "n")


@query("title_hash", f"WITH {S.DOCS} SELECT doc_id, sha256({S.strip('title')}) AS title_hash FROM docs")
def title_hash(spark, sf):
    return documents(spark, sf).select("doc_id", X.title_hash(F.col("title")).alias("title_hash"))




@query("download_filename", f"""WITH {S.DOCS},
  b AS (SELECT doc_id, CASE WHEN {S.strip('title')} = '' THEN CAST(doc_id AS VARCHAR) ELSE {S.strip('title')} END AS base FROM docs),
  e AS (SELECT doc_id, base, regexp_extract(regexp_extract(base, '([^/]*)$', 1), '(?s)[^.].*?\\.([^.]+)$', 1) AS own FROM b),
  s AS (SELECT doc_id, CASE WHEN own <> '' THEN own ELSE 'txt' END AS ext,
    CASE WHEN own <> '' THEN left(base, CAST(length(base) - length(own) - 1 AS BIGINT)) ELSE base END AS stem FROM e),
  c AS (SELECT doc_id, ext, regexp_replace(regexp_replace(stem, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS c FROM s),
  w AS (SELECT doc_id, ext, c, left(c, 30) AS win, regexp_extract(left(c, 30), '(?s)^(.+)[^0-9A-Za-z가-힣]', 1) AS cut FROM c),
  f AS (SELECT doc_id, ext, regexp_replace(regexp_replace(CASE WHEN length(c) <= 30 THEN c WHEN cut <> '' THEN cut ELSE win END,
    '[^0-9A-Za-z가-힣]+$', ''), '^[ ._]+|[ ._]+$', '', 'g') AS f FROM w)
  SELECT doc_id, CASE WHEN f = '' THEN CAST(doc_id AS VARCHAR) ELSE f END || '.' || ext AS filename FROM f""")
def download_filename(spark, sf):
    return documents(spark, sf).select(
        "doc_id", X.download_filename(F.col("title"), F.lit("txt"), F.col("doc_id")).alias("filename"))


@query("download_url", f"""WITH {S.DOCS} SELECT doc_id, CASE WHEN st = 's3' THEN '/api/kb/' || kb_id || '/docs/' || doc_id || '/download' END AS url
  FROM (SELECT *, CASE WHEN connector_id < 'src5' THEN 's3' ELSE 'web' END AS st FROM docs)""")
def download_url(spark, sf):
    kind = F.when(F.col("connector_id") < "src5", "s3").otherwise("web")
    return documents(spark, sf).select(
        "doc_id", X.download_url(F.col("kb_id"), F.col("doc_id"), kind).alias("url"))


@query("truncate_error", "SELECT doc_id, left(text, 500) AS last_error, CAST(length(text) > 500 AS BOOLEAN) AS was_cut FROM documents")
def truncate_error(spark, sf):
    return documents(spark, sf).select(
        "doc_id", X.truncate_error(F.col("text")).alias("last_error"), (F.length("text") > 500).alias("was_cut"))


@query("ilike_search", f"""WITH {S.DOCS} SELECT doc_id, kb_id, title FROM docs
  WHERE title ILIKE '%the_and%' OR connector_id ILIKE '%the_and%' OR CAST(doc_id AS VARCHAR) ILIKE '%the_and%'""")
def ilike_search(spark, sf):
    return documents(spark, sf).filter(
        X.ilike_any("the_and", F.col("title"), F.col("connector_id"), F.col("doc_id"))).select("doc_id", "kb_id", "title")


@query("page_label_split", """SELECT doc_id, CASE WHEN n IS NOT NULL THEN n END AS page_num, CASE WHEN n IS NULL THEN lbl END AS page_label
  FROM (SELECT doc_id, lbl, TRY_CAST(lbl AS INTEGER) AS n FROM (
    SELECT doc_id, CASE WHEN source < 'src5' THEN source ELSE CAST(n_chars AS VARCHAR) END AS lbl FROM documents))""")
def page_label_split(spark, sf):
    label = F.when(F.col("source") < "src5", F.col("source")).otherwise(F.col("n_chars").cast("string"))
    return split_page_label(table(spark, sf, "documents").select("doc_id", label.alias("label")), "label").select(
        "doc_id", "page_num", "page_label")


def split_page_label(df, label: str, page_num=None):
    """A numeric label becomes the page number where none is known; any other stays text."""
    number = F.col(label).try_cast("int")
    known = F.lit(None).cast("int") if page_num is None else F.col(page_num)
    use = number.isNotNull() & known.isNull()
    return df.withColumn("page_label", F.when(~F.coalesce(use, F.lit(False)), F.col(label))).withColumn(
        "page_num", F.when(use, number).otherwise(known))


@query("doc_created_at", """SELECT e.event_id, strftime(coalesce(
    CASE WHEN e.value > 10 THEN e.ts END, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(e.user_id AS INTEGER))), '%Y-%m-%dT%H:%M:%S+00:00') AS doc_created_at
  FROM events e""")
def doc_created_at(spark, sf):
    own = F.when(F.col("value") > 10, F.col("ts"))
    stored = F.timestamp_add("MINUTE", F.col("user_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", created_at_text(own, stored).alias("doc_created_at"))


def created_at_text(own, stored):
    """File date, else date of the stored object, else empty; rendered in UTC."""
    shown = F.date_format(F.coalesce(own, stored), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.coalesce(F.regexp_replace(shown, "Z$", "+00:00"), F.lit(""))


@query("sparse_tf", f"""WITH {S.DOCS} SELECT doc_id, token, count(*) AS tf
  FROM (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM docs) GROUP BY ALL""")
def sparse_tf_q(spark, sf):
    return sparse_tf(spread(documents(spark, sf), "doc_id"), "doc_id").select("doc_id", "token", "tf")


@query("sparse_token_ids")
def sparse_token_ids(spark, sf):
    return sparse_tf(spread(documents(spark, sf), "doc_id"), "doc_id").select("token", "token_id").distinct()


@query("dense_embed", f"""WITH {S.DOCS}, {S.hashed('docs', 'doc_id', 'h')}
  SELECT doc_id, CAST(b AS INTEGER) AS dim, round(v, 6) AS v FROM h""")
def dense_embed_q(spark, sf):
    e = dense_embed(spread(documents(spark, sf).select("doc_id", "text"), "doc_id"), keep_text=False)
    return e.select("doc_id", F.posexplode("vec").alias("dim", "v")).filter(F.col("v") != 0).select(
        "doc_id", "dim", F.round("v", 6).alias("v"))


@query("embedding_dim_check", """SELECT label AS kb_id, count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS n_bad,
  count(*) FILTER (WHERE len(embedding) <> 128) AS n_bad_128 FROM embeddings GROUP BY label""")
def embedding_dim_check(spark, sf):
    v = vectors(spark, sf)
    bad = dimension_violations(v, "vec", 64).groupBy("kb_id").agg(F.count("*").alias("n_bad"))
    bad128 = dimension_violations(v, "vec", 128).groupBy("kb_id").agg(F.count("*").alias("n_bad_128"))
    n = v.groupBy("kb_id").agg(F.count("*").alias("n"))
    return n.join(bad, "kb_id", "left").join(bad128, "kb_id", "left").fillna(0)


@query("embedding_metadata", """SELECT conv_id || ':' || turn AS chunk_id, 'feature-hash-64' AS embedding_model, 'builtin' AS embedding_provider FROM conversations""")
def embedding_metadata(spark, sf):
    return stamp_model(table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("chunk_id")), "feature-hash-64", "builtin")


def stamp_model(chunks, model: str, provider: str):
    return chunks.withColumn("embedding_model", F.lit(model)).withColumn("embedding_provider", F.lit(provider))


@query("cosine", """SELECT a.vec_id AS vec_a, b.vec_id AS vec_b,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm_a
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_q(spark, sf):
    v = vectors(spark, sf)
    nxt = v.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("chunk_id").alias("vec_b"), F.col("vec").alias("w"))
    return v.join(nxt, "chunk_id").select(
        F.col("chunk_id").alias("vec_a"), "vec_b", F.round(cosine(F.col("vec"), F.col("w")), 6).alias("cosine"),
        F.round(norm(F.col("vec")), 6).alias("norm_a"))
