from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stackroom.functions.vectors import cosine, unit
from stackroom.operators import cache as C
from stackroom.operators.dense import dense_topk
from stackroom.operators.embed import dense_embed
from stackroom.operators.fusion import hybrid_rsf, rrf_merge, similarity_merge
from stackroom.operators.parents import auto_merge
from stackroom.operators.rerank import rerank
from stackroom.operators.sparse import sparse_tf, sparse_topk


@pytest.mark.parametrize("slab", [2, 100])
def test_sparse_topk_against_brute_force(spark, slab):
    rng = random.Random(5)
    words = "a b c d e f g".split()
    chunks = [(f"kb{i % 2}", f"c{i:02d}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(50)]
    queries = [(q, " ".join(rng.choices([*words, "zz"], k=3))) for q in range(7)]
    got = {(r.query_id, r.kb_id, r.chunk_id): round(r.score, 6) for r in sparse_topk(
        spark.createDataFrame(queries, "query_id bigint, text string"),
        spark.createDataFrame(chunks, "kb_id string, chunk_id string, text string"), 4, slab).collect()}
    wanted = {}
    for q, text in queries:
        for kb in ("kb0", "kb1"):
            mine = [(c, Counter(t.split())) for k, c, t in chunks if k == kb]
            df = Counter(w for _, tf in mine for w in tf)
            scored = [(sum(n * (math.log(len(mine) / df[w]) + 1) * tf[w] for w, n in Counter(text.split()).items() if tf[w]), c)
                      for c, tf in mine]
            for s, c in sorted((-round(s, 9), c) for s, c in scored if s > 0)[:4]:
                wanted[q, kb, c] = round(-s, 6)
    assert got == wanted


def test_sparse_topk_makes_no_rows_of_queries_and_chunks(spark):
    """Few words, so that every query shares some with every chunk; a knowledge base that is null has no chunks."""
    rng = random.Random(6)
    chunks = [(None if i % 10 == 9 else f"kb{i % 2}", f"c{i:04d}", " ".join(rng.choices("abcd", k=6))) for i in range(2000)] + [("kb0", "no", "")]
    queries = [(q, "a b c d" if q else "") for q in range(60)]
    frame = sparse_topk(spark.createDataFrame(queries, "query_id bigint, text string"),
                        spark.createDataFrame(chunks, "kb_id string, chunk_id string, text string"), 3)
    got = frame.collect()
    assert len(got) == 59 * 2 * 3 and {r.kb_id for r in got} == {"kb0", "kb1"}
    assert len({(r.kb_id, r.chunk_id, r.rank, r.score) for r in got}) == 6
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_dense_topk_slabs_agree(spark):
    rng = random.Random(2)
    rows = [(i, f"kb{i % 3}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, kb_id string, vec array<double>")
    queries = chunks.select(F.col("chunk_id").alias("query_id"), "vec")
    a, b = (sorted(dense_topk(queries, chunks, 3, slab).collect()) for slab in (7, 1000))
    assert a == b and len(a) == 60 * 3 * 3
    assert all(r.chunk_id == r.query_id for r in a if r.rank == 1 and r.kb_id == f"kb{r.query_id % 3}")


def test_cosine(spark):
    df = spark.sql("select array(3D, 4D) a, array(0D, 0D) z, array(1D) s")
    assert df.select(cosine(F.col("a"), F.col("a"))).first()[0] == pytest.approx(1.0)
    assert df.select(cosine(F.col("a"), F.col("z"))).first()[0] == 0.0
    assert df.select(unit(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="length mismatch"):
        df.select(cosine(F.col("a"), F.col("s"))).collect()


def test_sparse_ids(spark):
    import zlib

    df = spark.createDataFrame([(1, "Größe size size")], "doc_id bigint, text string")
    got = {(r.token, r.token_id, r.tf) for r in sparse_tf(df, "doc_id").collect()}
    assert got == {(t, zlib.crc32(t.encode()) & 0x7FFFFFFF, n) for t, n in (("größe", 1), ("size", 2))}


def test_pluggable_embedder_and_batches(spark):
    import numpy as np

    def fn(texts):
        assert len(texts) <= 4
        return np.array([[float(len(t)), 1.0] for t in texts])

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id bigint, text string")
    got = {r.id: r.vec for r in dense_embed(df, fn=fn, batch_size=4).collect()}
    assert got == {i: [float(i), 1.0] for i in range(10)}


def test_rrf_adds_up_and_keeps_the_last_payload(spark):
    lists = spark.createDataFrame([(1, 0, 1, "A", "p0"), (1, 0, 2, "B", "p0"), (1, 1, 1, "A", "p1"), (1, 1, 2, "C", "p1")],
                                  "query_id int, list_no int, rank int, chunk_id string, src string")
    got = rrf_merge(lists, payload=("src",)).orderBy("rank").collect()
    assert [(r.chunk_id, r.src) for r in got] == [("A", "p1"), ("B", "p0"), ("C", "p1")]
    assert got[0].score == round(2 / 61, 6) and got[1].score == round(1 / 62, 6)


def test_hybrid_and_similarity(spark):
    schema = "query_id int, kb_id string, chunk_id string, score double, rank int"
    dense = spark.createDataFrame([(1, "k", "a", 0.9, 1), (1, "k", "b", 0.5, 2)], schema)
    sparse = spark.createDataFrame([(1, "k", "b", 7.0, 1)], schema)
    got = {r.chunk_id: r.score for r in hybrid_rsf(dense, sparse, 10, 0.25).collect()}
    assert got == {"b": 0.75, "a": 0.25}
    hits = spark.createDataFrame([(1, "k", c, s, 1) for c, s in (("x", 0.8), ("y", 0.3), ("z", 0.5))], schema)
    assert [r.chunk_id for r in similarity_merge(hits, 10, 0.4).orderBy("rank").collect()] == ["x", "z"]


PARENTS = "parent_chunk_id string, grandparent_id string, child_count int, parent_text string"
HITS = "query_id int, kb_id string, chunk_id string, parent_chunk_id string, score double, rank int, text string"


def test_auto_merge_one_level(spark):
    hits = spark.createDataFrame([(1, "k", "c1", "p", 0.9, 1, "a"), (1, "k", "c2", "p", 0.8, 2, "b")], HITS)
    parents = spark.createDataFrame([("p", None, 3, "whole")], PARENTS)
    got = auto_merge(hits, parents, 1, 0.5).collect()
    assert len(got) == 1 and got[0].merged and got[0].score == pytest.approx(0.85) and got[0].text == "whole"


def test_auto_merge_levels_and_order(spark):
    hits = spark.createDataFrame([
        (1, "k", "s1", None, 0.95, 1, ""), (1, "k", "a1", "A", 0.9, 2, ""), (1, "k", "b1", "B", 0.85, 3, ""),
        (1, "k", "a2", "A", 0.8, 4, ""), (1, "k", "u1", "unknown", 0.7, 5, "")], HITS)
    parents = spark.createDataFrame([("A", "G", 2, "text A"), ("B", "G", 3, "text B"), ("G", None, 2, "text G")], PARENTS)
    got = auto_merge(hits, parents, 2, 0.5).orderBy("position").collect()
    assert [(r.chunk_id, r.merged) for r in got] == [("s1", False), ("u1", False), ("G", True), ("b1", False)]
    assert got[2].score == pytest.approx(0.85)


def test_rerank_and_fallback(spark):
    hits = spark.createDataFrame([(1, "red fox", "a blue dog", 0.9, 1), (1, "red fox", "the red fox", 0.5, 2), (2, "x", "y", 0.4, 1)],
                                 "query_id int, query string, text string, score double, rank int")
    got = rerank(hits, 1).orderBy("query_id").collect()
    assert got[0].text == "the red fox" and got[0].rerank_score == 1.0 and not got[0].fallback
    broken = rerank(hits, 1, scorer=lambda d: d.withColumn("relevance", F.lit(None).cast("double"))).orderBy("query_id").collect()
    assert broken[0].text == "a blue dog" and broken[0].fallback and broken[0].rerank_score is None


def test_cache(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "k array<string>")
    assert df.select(C.bucket_hash(F.col("k"), F.lit("{}"))).distinct().count() == 1
    entries = spark.sql("""select * from values ('q1', array('a'), timestamp'2024-01-01 00:00:00'), ('q2', array('a','b'), timestamp'2024-01-01 00:30:00'),
        ('q3', array('b'), timestamp'2024-01-01 02:00:00') as t(query_hash, kb_ids, created_at)""")
    assert {r.query_hash for r in C.evict(entries, 2).collect()} == {"q2", "q3"}
    kept, cleared = C.invalidate(entries, "a")
    assert [r.query_hash for r in kept.collect()] == ["q3"] and cleared.first()[0] == 2
    assert C.invalidate(entries)[1].first()[0] == 3
    live = C.live(entries, F.lit("2024-01-01 01:10:00").cast("timestamp"))
    assert {r.query_hash for r in live.collect()} == {"q2", "q3"}


def test_cache_buckets_of_ids_with_commas_differ(spark):
    from stackroom.operators import cache as C

    df = spark.createDataFrame([(["a,b"],), (["a", "b"],), (["b", "a"],)], "k array<string>")
    keys = [r[0] for r in df.select(C.bucket_hash(F.col("k"), F.lit("{}"))).collect()]
    assert keys[0] != keys[1] and keys[1] == keys[2]


def test_levels_and_overlap_of_settings(spark):
    from stackroom.operators import settings as G

    sent = [("k", "chunking.chunk_size", v) for v in ("[600, 200]", "[600]", "[200, 600]", "[600, 200, 32]", "[9000, 100]", "512", "9000", "[x]")]
    rules = G.rule_table(spark)
    bad = G.violations(spark.createDataFrame(sent, "kb_id string, key string, value string"), rules).collect()
    assert {r["value"] for r in bad} == {"[600]", "[200, 600]", "[600, 200, 32]", "[9000, 100]", "9000", "[x]"}
    own = [("a", "chunking.chunk_size", "[600, 200]"), ("a", "chunking.chunk_overlap", "31"), ("b", "chunking.chunk_overlap", "30"),
           ("c", "chunking.chunk_size", "512")]
    kbs = spark.createDataFrame([("a",), ("b",), ("c",)], "kb_id string")
    resolved = G.resolve(kbs, spark.createDataFrame(own, "kb_id string, key string, value string"), rules)
    assert {r["kb_id"] for r in G.overlap_violations(resolved).collect()} == {"a", "c"}


def test_semantic_lookup_streams_requests_past_the_entries(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasCogroupedOps.applyInPandas", None)
    rng = np.random.default_rng(2)
    asked = [(i, None if i == 7 else f"b{i % 3}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    held = [(f"b{i % 2}", f"q{i:02}", None if i == 4 else rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(30)]
    got = C.semantic_lookup(spark.createDataFrame(asked, "request_id bigint, bucket_hash string, embedding array<double>"),
                            spark.createDataFrame(held, "bucket_hash string, query_hash string, embedding array<double>"), 0.6)
    wanted = {}
    for i, bucket, a in asked:
        for b, name, e in held:
            if b == bucket and e and any(a) and any(e):
                score = round(float(np.dot(a, e) / np.linalg.norm(a) / np.linalg.norm(e)), 9)
                if score >= 0.6:
                    wanted[i] = min(wanted.get(i, (0, "")), (-score, name))
    assert {r.request_id: (-round(r.score, 9), r.query_hash) for r in got.collect()} == wanted and len(wanted) > 100
