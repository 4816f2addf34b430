"""Near-duplicate detection over all documents: each one against the index of all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sketches as Z
from ..functions.text import let, title_hash, trigram_set, words
from ..operators import confirm as C
from ..operators import minhash as M
from ..operators import simhash as H
from ..operators.chunking import word_windows
from ..operators.sequence import LEAST_CHARS, OVERLAP, SIZE, replay_texts, sketches
from ..operators.sequence import packs as pair_packs
from ..operators.titles import similar_titles
from ..operators.verdict import cascade, resolve_newer, verdict
from ..session import spread, staged
from ..sources.tables import documents, table
from . import sqlbits as S
from .registry import query

# Documents of source src3 count as code, which is never compared.
CODE_SOURCE = "src3"


def texts(spark, sf):
    return spread(documents(spark, sf), "doc_id")


def fingerprints(spark, sf):
    """(doc_id, kb_id, title_hash, simhash)"""
    docs = texts(spark, sf)
    titles = docs.select("doc_id", title_hash(F.col("title")).alias("title_hash"))
    return staged(H.simhash64(docs, "doc_id", "kb_id").join(titles, "doc_id"))


def signatures(spark, sf):
    """(doc_id, kb_id, title, signature)"""
    return staged(M.minhash128(texts(spark, sf), "doc_id", "kb_id", "title"))


def packs(spark, sf, pairs):
    """(doc_id, n_chunks, tile, vecs) of the documents of pairs (doc_id, candidate_id)."""
    return pair_packs(texts(spark, sf), pairs)


def created(spark, sf):
    """(doc_id, doc_created_at, chunk_count); documents of src7 have no date."""
    docs = table(spark, sf, "documents")
    at = F.when(F.col("source") != "src7", F.col("doc_id"))
    return docs.select("doc_id", at.alias("doc_created_at"))


# ---- SQL --------------------------------------------------------------------------------------

_BITS = ", ".join(f"sum(CAST((h >> {k}) & 1::UBIGINT AS BIGINT)) AS s{k}" for k in range(64))
_WORD = " + ".join(f"CASE WHEN 2 * coalesce(s{k}, 0) > coalesce(n, 0) THEN {1 << k}::HUGEINT ELSE 0::HUGEINT END" for k in range(64))
FP = f"""{S.DOCS},
grams AS (SELECT DISTINCT doc_id, substr(text, i, 3) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM docs)),
gh AS (SELECT doc_id, CAST('0x' || substr(md5(g), 17, 16) AS UBIGINT) AS h FROM grams),
gs AS (SELECT doc_id, count(*) AS n, {_BITS} FROM gh GROUP BY doc_id),
gw AS (SELECT doc_id, {_WORD} AS w FROM docs LEFT JOIN gs USING (doc_id)),
fp AS (SELECT doc_id, kb_id, title, sha256({S.strip('title')}) AS title_hash, CAST(CASE WHEN w >= 9223372036854775808::HUGEINT THEN w - 18446744073709551616::HUGEINT ELSE w END AS BIGINT) AS simhash,
  CAST((w >> 0) & 65535 AS INTEGER) AS b0, CAST((w >> 16) & 65535 AS INTEGER) AS b1, CAST((w >> 32) & 65535 AS INTEGER) AS b2, CAST((w >> 48) & 65535 AS INTEGER) AS b3 FROM docs JOIN gw USING (doc_id))"""
_SHARE = "(a.b0 = b.b0 OR a.b1 = b.b1 OR a.b2 = b.b2 OR a.b3 = b.b3)"
SIM = f"""{FP},
near AS (SELECT a.doc_id, b.doc_id AS candidate_id, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance, a.title_hash = b.title_hash AS same
  FROM fp a JOIN fp b ON a.kb_id = b.kb_id AND a.doc_id <> b.doc_id AND {_SHARE}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, candidate_id) AS r FROM near WHERE distance <= 10) WHERE r = 1),
stage1 AS (SELECT fp.doc_id, CASE WHEN distance <= 3 THEN 'identical_level' WHEN distance <= 10 THEN 'similar' ELSE 'none' END AS body_match,
  CASE WHEN distance <= 3 THEN CASE WHEN same THEN 'same' ELSE 'changed' END ELSE 'unknown' END AS title_match, candidate_id, distance FROM fp LEFT JOIN best USING (doc_id))"""

_FAMILY = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(M.hash_family()))
_P = f"{M.PRIME}::HUGEINT"
SIG = f"""@docs@fam(i, a, b) AS (VALUES {_FAMILY}),
dt AS (SELECT DISTINCT doc_id, unnest({S.words('lower(text)')}) AS t FROM docs),
voc AS (SELECT t, ((CAST(CAST('0x' || left(md5(t), 16) AS UBIGINT) AS HUGEINT) % {_P}) * 8 + CAST(CAST('0x' || right(md5(t), 16) AS UBIGINT) AS HUGEINT) % {_P}) % {_P} AS h FROM (SELECT DISTINCT t FROM dt)),
perm AS (SELECT t, i, CAST((a * h + b) % {_P} AS BIGINT) AS v FROM voc, fam),
mins AS (SELECT doc_id, i, min(v) AS v FROM dt JOIN perm USING (t) GROUP BY ALL),
sig AS (SELECT doc_id, kb_id, title, coalesce(s, list_transform(range(128), lambda x: {M.PRIME}::BIGINT)) AS s FROM docs LEFT JOIN (SELECT doc_id, list(v ORDER BY i) AS s FROM mins GROUP BY doc_id) USING (doc_id)),
mb AS (SELECT doc_id, kb_id, k AS band_index, md5(array_to_string(s[k*8+1 : k*8+8], ',')) AS band_key FROM sig, range(16) r(k))"""
SIG_DOCS = SIG.replace("@docs@", S.DOCS + ", ")
_JL = "len(list_filter(range(1, 129), lambda x: {a}[x] = {b}[x])) / 128.0::DOUBLE"
TITLES = """tt AS (SELECT DISTINCT kb_id, title FROM docs),
tg AS (SELECT kb_id, title, list_distinct(list(substr(p, i, 3))) AS g FROM (SELECT kb_id, title, p, unnest(range(1, length(p) - 1)) AS i FROM (
  SELECT kb_id, title, '  ' || unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) || ' ' AS p FROM tt)) GROUP BY kb_id, title),
tp AS (SELECT a.kb_id, a.title, b.title AS other_title, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS sim FROM tg a JOIN tg b ON a.kb_id = b.kb_id),
ts AS (SELECT * FROM tp WHERE sim >= 0.85)"""
STAGE2 = f"""{TITLES},
bodyc AS (SELECT DISTINCT a.doc_id, b.doc_id AS candidate_id FROM mb a JOIN mb b ON a.kb_id = b.kb_id AND a.band_index = b.band_index AND a.band_key = b.band_key AND a.doc_id <> b.doc_id),
titlec AS (SELECT a.doc_id, b.doc_id AS candidate_id, sim FROM docs a JOIN ts ON ts.kb_id = a.kb_id AND ts.title = a.title JOIN docs b ON b.kb_id = ts.kb_id AND b.title = ts.other_title AND b.doc_id <> a.doc_id),
cand AS (SELECT doc_id, candidate_id, max(sim) AS sim FROM (SELECT doc_id, candidate_id, 0 AS sim FROM bodyc UNION ALL SELECT * FROM titlec) GROUP BY ALL),
jac AS (SELECT c.doc_id, c.candidate_id, sim, {_JL.format(a='a.s', b='b.s')} AS j FROM cand c JOIN sig a ON a.doc_id = c.doc_id JOIN sig b ON b.doc_id = c.candidate_id),
stage2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, candidate_id) AS r FROM jac WHERE j > 0 AND (j >= 0.65 OR (sim >= 0.85 AND j >= 0.25))) WHERE r = 1)"""
PACKS = f"""{S.windows(100, 10)}, pc AS (SELECT doc_id, pos, text FROM windows WHERE length({S.strip('text')}) >= 30),
{S.hashed('pc', 'doc_id, pos', 'pv0')}, pv AS MATERIALIZED (SELECT * FROM pv0), pn AS (SELECT doc_id, count(*) AS n FROM pc GROUP BY doc_id)"""


def coverage_sql(pairs: str) -> str:
    """cov (doc_id, candidate_id, score) for the pairs of a relation."""
    return f"""rat AS (SELECT p.doc_id, p.candidate_id, a.n AS na, CASE WHEN a.n > 0 AND c.n > 0 THEN least(a.n, c.n) / greatest(a.n, c.n) ELSE 0 END AS ratio
  FROM {pairs} p LEFT JOIN pn a ON a.doc_id = p.doc_id LEFT JOIN pn c ON c.doc_id = p.candidate_id),
rx AS MATERIALIZED (SELECT r.doc_id, r.candidate_id, x.pos, x.b, x.v FROM rat r JOIN pv x ON x.doc_id = r.doc_id WHERE ratio >= 0.75),
mat AS (SELECT rx.doc_id, rx.candidate_id, rx.pos, round(sum(rx.v * y.v), 9) AS c, y.pos AS cpos FROM rx JOIN pv y ON y.doc_id = rx.candidate_id AND y.b = rx.b GROUP BY ALL),
top AS (SELECT doc_id, candidate_id, pos, max(c) AS c FROM mat WHERE c >= 0.5 GROUP BY ALL),
tot AS (SELECT doc_id, candidate_id, sum(c) AS c FROM top GROUP BY ALL),
cov AS (SELECT r.doc_id, r.candidate_id, CASE WHEN ratio < 0.75 THEN 0 ELSE coalesce(c, 0) / na * ratio END AS score FROM rat r LEFT JOIN tot USING (doc_id, candidate_id))"""


# ---- queries ----------------------------------------------------------------------------------

@query("simhash64", f"WITH {FP} SELECT doc_id, simhash FROM fp")
def simhash64(spark, sf):
    return H.simhash64(texts(spark, sf), "doc_id")


@query("hamming", f"WITH {FP} SELECT a.doc_id, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM fp a JOIN fp b ON b.doc_id = a.doc_id + 1")
def hamming(spark, sf):
    fp = staged(H.simhash64(texts(spark, sf), "doc_id"))
    following = fp.select((F.col("doc_id") - 1).alias("doc_id"), F.col("simhash").alias("other"))
    return fp.join(following, "doc_id").select("doc_id", Z.hamming(F.col("simhash"), F.col("other")).alias("distance"))


@query("simhash_bands", f"WITH {FP} SELECT doc_id, 0 AS band_index, b0 AS band_value FROM fp UNION ALL SELECT doc_id, 1, b1 FROM fp UNION ALL SELECT doc_id, 2, b2 FROM fp UNION ALL SELECT doc_id, 3, b3 FROM fp")
def simhash_bands(spark, sf):
    return H.band_rows(H.simhash64(texts(spark, sf), "doc_id"), "doc_id")


@query("simhash_candidates", f"WITH {SIM} SELECT fp.doc_id, count(candidate_id) AS n_candidates FROM fp LEFT JOIN near USING (doc_id) GROUP BY fp.doc_id")
def simhash_candidates(spark, sf):
    return H.candidate_counts(staged(H.simhash64(texts(spark, sf), "doc_id", "kb_id")))


@query("simhash_match", f"WITH {SIM} SELECT * FROM stage1")
def simhash_match(spark, sf):
    return H.simhash_match(fingerprints(spark, sf))


@query("minhash128", f"WITH {SIG_DOCS} SELECT doc_id, array_to_string(s, ',') AS signature FROM sig")
def minhash128(spark, sf):
    return signatures(spark, sf).select("doc_id", F.array_join("signature", ",").alias("signature"))


@query("split_bands", f"WITH {SIG_DOCS} SELECT doc_id, CAST(band_index AS INTEGER) AS band_index, band_key FROM mb")
def split_bands(spark, sf):
    return M.band_rows(M.with_keys(signatures(spark, sf)), "doc_id")


@query("minhash_candidates", f"WITH {SIG_DOCS}, pairs AS (SELECT DISTINCT a.doc_id, b.doc_id AS c FROM mb a JOIN mb b USING (kb_id, band_index, band_key) WHERE a.doc_id <> b.doc_id) SELECT docs.doc_id, count(c) AS n_candidates FROM docs LEFT JOIN pairs USING (doc_id) GROUP BY docs.doc_id")
def minhash_candidates(spark, sf):
    return M.candidate_counts(signatures(spark, sf))


@query("jaccard_estimate", f"WITH {SIG_DOCS} SELECT a.doc_id, {_JL.format(a='a.s', b='b.s')} AS jaccard FROM sig a JOIN sig b ON b.doc_id = a.doc_id + 1")
def jaccard_estimate(spark, sf):
    s = signatures(spark, sf).select("doc_id", "signature")
    following = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("signature").alias("other"))
    return s.join(following, "doc_id").select("doc_id", Z.jaccard_estimate(F.col("signature"), F.col("other")).alias("jaccard"))


@query("minhash_match", f"WITH {SIG_DOCS}, {STAGE2} SELECT doc_id, candidate_id, j AS jaccard FROM stage2")
def minhash_match(spark, sf):
    return M.minhash_match(signatures(spark, sf))


@query("trigram_similarity", f"WITH {S.DOCS}, {TITLES} SELECT kb_id, title, other_title, round(sim, 6) AS sim FROM tp WHERE sim >= 0.85")
def trigram_similarity(spark, sf):
    return similar_titles(documents(spark, sf), M.TITLE).withColumn("sim", F.round("sim", 6))


@query("trigram_set", f"WITH {S.DOCS}, {TITLES} SELECT kb_id, title, array_to_string(list_sort(g), '|') AS trigrams FROM tg")
def trigram_set_q(spark, sf):
    d = documents(spark, sf).select("kb_id", "title").distinct().withColumn("g", trigram_set(F.col("title")))
    return d.filter(F.size("g") > 0).select("kb_id", "title", F.array_join(F.array_sort("g"), "|").alias("trigrams"))


@query("chunk_coverage", f"WITH {SIG_DOCS}, {STAGE2}, {PACKS}, {coverage_sql('stage2')} SELECT doc_id, candidate_id, round(score, 6) AS score FROM cov")
def chunk_coverage(spark, sf):
    pairs = staged(M.minhash_match(signatures(spark, sf)).select("doc_id", "candidate_id"))
    return C.chunk_coverage(pairs, packs(spark, sf, pairs)).withColumn("score", F.round("score", 6))


_BODY = "CASE WHEN round(score, 9) >= 0.95 THEN 'identical_level' WHEN round(score, 9) >= 0.75 THEN 'similar' ELSE 'none' END"


@query("score_to_body_match", f"WITH {SIG_DOCS}, {STAGE2}, {PACKS}, {coverage_sql('stage2')} SELECT {_BODY} AS body_match, count(*) AS n FROM cov GROUP BY ALL")
def score_to_body_match(spark, sf):
    pairs = staged(M.minhash_match(signatures(spark, sf)).select("doc_id", "candidate_id"))
    return C.chunk_coverage(pairs, packs(spark, sf, pairs)).groupBy(
        C.body_match(F.round("score", 9)).alias("body_match")).agg(F.count("*").alias("n"))


_CONFIRM = f"""conf AS (SELECT cov.doc_id, round(score, 9) AS score, {_BODY} AS body_match, candidate_id FROM cov),
stage3 AS (SELECT c.doc_id, score, body_match, CASE WHEN body_match = 'none' THEN 'unknown' WHEN sha256({S.strip('a.title')}) = sha256({S.strip('b.title')}) THEN 'same' ELSE 'changed' END AS title_match,
  CASE WHEN body_match <> 'none' THEN candidate_id END AS candidate_id FROM conf c JOIN docs a ON a.doc_id = c.doc_id JOIN docs b ON b.doc_id = c.candidate_id)"""


def confirm_fn(spark, sf):
    titles = documents(spark, sf).select("doc_id", title_hash(F.col("title")).alias("title_hash"))
    return lambda pairs: C.chunk_confirm(C.chunk_coverage(pairs, packs(spark, sf, pairs)), titles)


@query("chunk_confirm", f"WITH {SIG_DOCS}, {STAGE2}, {PACKS}, {coverage_sql('stage2')}, {_CONFIRM} SELECT doc_id, round(score, 6) AS score, body_match, title_match, candidate_id FROM stage3")
def chunk_confirm(spark, sf):
    pairs = staged(M.minhash_match(signatures(spark, sf)).select("doc_id", "candidate_id"))
    return confirm_fn(spark, sf)(pairs).withColumn("score", F.round("score", 6))


_LEADS = " FROM (SELECT min(doc_id) AS doc_id, any_value(lang) AS lang, any_value(source) AS source, text FROM documents GROUP BY lang, text))"
_ALL = "passing AS (SELECT doc_id, candidate_id FROM jac WHERE j > 0 AND (j >= 0.65 OR (sim >= 0.85 AND j >= 0.25)))"
_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, candidate_id) AS r FROM cov) WHERE r = 1)"


@query("chunk_confirm_all", f"WITH {SIG_DOCS}, {STAGE2}, {_ALL}, {PACKS}, {coverage_sql('passing')}, {_BEST}, {_CONFIRM.replace('cov.doc_id', 'best.doc_id').replace('FROM cov)', 'FROM best)')} SELECT doc_id, round(score, 6) AS score, body_match, title_match, candidate_id FROM stage3".replace(" FROM documents)", _LEADS, 1))
def chunk_confirm_all(spark, sf):
    """Every candidate that passes is confirmed, and the best one counts; of equal texts the first takes part."""
    docs = texts(spark, sf)
    first = docs.groupBy("kb_id", F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))
    lead = docs.join(first.select("doc_id"), "doc_id", "left_semi")
    passing = staged(M.passing_pairs(staged(M.minhash128(lead, "doc_id", "kb_id", "title"))).select(
        "doc_id", F.col("other").alias("candidate_id")))
    return confirm_fn(spark, sf)(passing).withColumn("score", F.round("score", 6))


FULL = f"""{SIM}, {SIG.replace("@docs@", "")}, {STAGE2},
first AS (SELECT s1.doc_id, CASE WHEN s1.body_match = 'none' AND s2.candidate_id IS NOT NULL THEN 'similar' ELSE s1.body_match END AS body_match, s1.title_match, coalesce(s1.candidate_id, s2.candidate_id) AS candidate_id
  FROM stage1 s1 LEFT JOIN stage2 s2 USING (doc_id)),
asked AS (SELECT doc_id, candidate_id FROM first WHERE body_match = 'similar'),
{PACKS}, {coverage_sql('asked')}, {_CONFIRM},
res AS (SELECT f.doc_id, CASE WHEN s.doc_id IS NOT NULL THEN s.body_match ELSE f.body_match END AS body_match, CASE WHEN s.doc_id IS NOT NULL THEN s.title_match ELSE f.title_match END AS title_match,
  CASE WHEN s.doc_id IS NOT NULL THEN s.candidate_id ELSE f.candidate_id END AS candidate_id FROM first f LEFT JOIN stage3 s USING (doc_id))"""
# Code documents take no part: they neither ask nor are candidates.
FULL_DOCS = FULL.replace(" FROM documents)", f" FROM documents WHERE source <> '{CODE_SOURCE}')", 1)


def dedup_results(spark, sf):
    """(doc_id, body_match, title_match, candidate_id) of the whole cascade for every document."""
    docs = texts(spark, sf).filter(F.col("connector_id") != CODE_SOURCE)
    titles = docs.select("doc_id", title_hash(F.col("title")).alias("title_hash"))
    fp = staged(H.simhash64(docs, "doc_id", "kb_id").join(titles, "doc_id"))
    sig = staged(M.minhash128(docs, "doc_id", "kb_id", "title"))
    first = staged(H.simhash_match(fp))
    open_ = first.where("body_match = 'none'").select("doc_id")
    found = cascade(first, staged(M.minhash_match(sig, asking=open_)), confirm_fn(spark, sf))
    skipped = documents(spark, sf).filter(F.col("connector_id") == CODE_SOURCE).select(
        "doc_id", F.lit("none").alias("body_match"), F.lit("unknown").alias("title_match"),
        F.lit(None).cast("bigint").alias("candidate_id"))
    return found.unionByName(skipped)


_RES = f"(SELECT doc_id, body_match, title_match, candidate_id FROM res UNION ALL SELECT doc_id, 'none', 'unknown', NULL FROM documents WHERE source = '{CODE_SOURCE}')"


@query("dedup_cascade", f"WITH {FULL_DOCS} SELECT doc_id, body_match, title_match, candidate_id, body_match = 'none' AS needs_indexing FROM {_RES}")
def dedup_cascade(spark, sf):
    return dedup_results(spark, sf).withColumn("needs_indexing", F.col("body_match") == "none")


_DATE = "CASE WHEN source <> 'src7' THEN doc_id END"


@query("resolve_newer", f"WITH d AS (SELECT doc_id, {_DATE} AS at FROM documents) SELECT a.doc_id, b.doc_id AS existing_id, CASE WHEN b.at IS NULL OR a.at > b.at THEN 'incoming' ELSE 'existing' END AS newer FROM d a JOIN d b ON b.doc_id = a.doc_id - 1 OR b.doc_id = a.doc_id + 1")
def resolve_newer_q(spark, sf):
    d = created(spark, sf)
    other = d.select(F.explode(F.array(F.col("doc_id") - 1, F.col("doc_id") + 1)).alias("doc_id"),
                     F.col("doc_id").alias("existing_id"), F.col("doc_created_at").alias("existing_at"))
    return d.join(other, "doc_id").select(
        "doc_id", "existing_id", resolve_newer(F.col("doc_created_at"), F.col("existing_at")).alias("newer"))


# ---- sequential decisions -----------------------------------------------------------------------

# What each document finds among earlier ones, whatever their state; then one step per document.
REPLAY = f"""WITH RECURSIVE {SIM}, {SIG.replace("@docs@", "")}, {STAGE2},
s1 AS (SELECT doc_id, candidate_id, distance, same FROM near WHERE distance <= 10 AND candidate_id < doc_id),
s2 AS (SELECT doc_id, candidate_id, j FROM jac WHERE j > 0 AND (j >= 0.65 OR (sim >= 0.85 AND j >= 0.25)) AND candidate_id < doc_id),
doubt AS (SELECT doc_id, candidate_id FROM s1 WHERE distance > 3 UNION SELECT doc_id, candidate_id FROM s2),
{PACKS}, {coverage_sql('doubt')},
sure AS (SELECT cov.doc_id, cov.candidate_id, {_BODY} AS body_match, CASE WHEN a.title_hash = b.title_hash THEN 'same' ELSE 'changed' END AS title_match
  FROM cov JOIN fp a ON a.doc_id = cov.doc_id JOIN fp b ON b.doc_id = cov.candidate_id),
found AS (SELECT doc_id, candidate_id, 1 AS stage, CAST(distance AS DOUBLE) AS score, 'identical_level' AS body_match, CASE WHEN same THEN 'same' ELSE 'changed' END AS title_match FROM s1 WHERE distance <= 3
  UNION ALL SELECT doc_id, candidate_id, 1, CAST(distance AS DOUBLE), body_match, title_match FROM s1 JOIN sure USING (doc_id, candidate_id) WHERE distance > 3
  UNION ALL SELECT doc_id, candidate_id, 2, -j, body_match, title_match FROM s2 JOIN sure USING (doc_id, candidate_id)),
dated AS (SELECT doc_id, {_DATE} AS at FROM documents),
pairs AS MATERIALIZED (SELECT f.*, CASE WHEN b.at IS NULL OR a.at > b.at THEN 'incoming' ELSE 'existing' END AS newer FROM found f JOIN dated a ON a.doc_id = f.doc_id JOIN dated b ON b.doc_id = f.candidate_id),
arrivals AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
steps AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, NULL::BIGINT AS candidate_id, 'none' AS body_match, 'unknown' AS title_match, 'index' AS action, []::BIGINT[] AS alive
  UNION ALL
  SELECT n, doc_id, CASE WHEN body <> 'none' THEN b.candidate_id END, body, CASE WHEN body = 'none' THEN 'unknown' ELSE b.title_match END, action,
    CASE action WHEN 'index' THEN list_append(alive, doc_id) WHEN 'outdate' THEN alive ELSE list_append(list_filter(alive, lambda x: x <> b.candidate_id), doc_id) END
  FROM (SELECT *, CASE WHEN body = 'none' THEN 'index' WHEN body = 'identical_level' AND b.title_match = 'changed' AND b.newer = 'incoming' THEN 'take_over'
      WHEN body = 'similar' AND b.newer = 'incoming' THEN 'replace' ELSE 'outdate' END AS action
    FROM (SELECT *, coalesce(b.body_match, 'none') AS body FROM (
      SELECT o.n, o.doc_id, any_value(s.alive) AS alive, min({{'stage': p.stage, 'score': p.score, 'candidate_id': p.candidate_id, 'body_match': p.body_match, 'title_match': p.title_match, 'newer': p.newer}}) FILTER (list_contains(s.alive, p.candidate_id)) AS b
      FROM steps s JOIN arrivals o ON o.n = s.n + 1 LEFT JOIN pairs p ON p.doc_id = o.doc_id GROUP BY o.n, o.doc_id)))),
replayed AS (SELECT s.doc_id, s.candidate_id, s.body_match, s.title_match, s.action, r.doc_id AS replaced_by, s.action <> 'outdate' AND r.doc_id IS NULL AS live
  FROM steps s LEFT JOIN steps r ON r.candidate_id = s.doc_id AND r.action IN ('take_over', 'replace') WHERE s.n > 0)"""


def replayed(spark, sf):
    docs = texts(spark, sf)
    grouped = docs.groupBy("kb_id", F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("group"))
    of_doc = docs.select("doc_id", "kb_id", F.sha2("text", 256).alias("digest")).join(grouped, ["kb_id", "digest"]).select(
        "doc_id", "group")
    lead = docs.join(grouped.select(F.col("group").alias("doc_id")), "doc_id", "left_semi")
    return replay_texts(of_doc.join(created(spark, sf), "doc_id"), staged(sketches(lead)), lead)


@query("dedup_replay", f"{REPLAY} SELECT * FROM replayed")
def dedup_replay(spark, sf):
    return replayed(spark, sf)


@query("dedup_survivors", f"{REPLAY} SELECT lang AS kb_id, sha256(text) AS digest, count(*) AS n_docs, CAST(count_if(live) AS BIGINT) AS n_live, CAST(count_if(replaced_by IS NOT NULL) AS BIGINT) AS n_replaced FROM replayed JOIN documents USING (doc_id) GROUP BY ALL HAVING count(*) > 1")
def dedup_survivors(spark, sf):
    """Groups of byte-identical documents: how many stay live, and how many gave way to another text."""
    digest = documents(spark, sf).select("doc_id", "kb_id", F.sha2("text", 256).alias("digest"))
    return replayed(spark, sf).join(digest, "doc_id").groupBy("kb_id", "digest").agg(
        F.count("*").alias("n_docs"), F.count_if("live").alias("n_live"),
        F.count_if(F.col("replaced_by").isNotNull()).alias("n_replaced")).where("n_docs > 1")


@query("verdict", f"""{REPLAY}, dd AS (SELECT d.doc_id, {_DATE} AS at, CAST(coalesce(n, 0) AS INTEGER) AS chunk_count FROM documents d LEFT JOIN pn USING (doc_id)),
  v AS (SELECT r.doc_id, r.body_match, r.title_match, r.candidate_id, r.action, o.chunk_count, CASE WHEN r.candidate_id IS NULL THEN NULL WHEN o.at IS NULL OR m.at > o.at THEN 'incoming' ELSE 'existing' END AS newer FROM replayed r LEFT JOIN dd m ON m.doc_id = r.doc_id LEFT JOIN dd o ON o.doc_id = r.candidate_id)
  SELECT doc_id, body_match, title_match, candidate_id, newer, action, action IN ('index', 'replace') AS needs_indexing, CASE action WHEN 'take_over' THEN 'indexed' WHEN 'outdate' THEN 'outdated' ELSE 'pending' END AS incoming_status,
   CASE WHEN action IN ('take_over', 'replace') THEN 'outdated' END AS existing_status, CASE WHEN action = 'outdate' THEN candidate_id END AS duplicate_of, CASE WHEN action = 'take_over' THEN chunk_count END AS taken_chunks FROM v""")
def verdict_q(spark, sf):
    """Each document against what is indexed when it arrives, so a group of copies keeps one."""
    cut = let(words(F.col("text")), lambda ws: F.filter(word_windows(ws, SIZE, OVERLAP), lambda t: F.length(t) >= LEAST_CHARS))
    counts = texts(spark, sf).select("doc_id", F.size(cut).alias("chunk_count"))
    matches = replayed(spark, sf).select("doc_id", "candidate_id", "body_match", "title_match")
    return verdict(matches, created(spark, sf).join(counts, "doc_id", "left").fillna(0, ["chunk_count"]))
