from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stackroom.operators import chunking as K
from stackroom.operators import index as I
from stackroom.operators import settings as G
from stackroom.sources import readers as R
from stackroom.streaming.ingest import ingest_stream
from stackroom.operators.index import read_table


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def chunks_of(df):
    out = {}
    for r in df.orderBy("doc_id", "pos").collect():
        out.setdefault(r.doc_id, []).append(r.text)
    return out


def test_recursive_packing(spark):
    text = "One two three. Four five. Six seven eight nine. Ten."
    got = chunks_of(K.chunk_recursive(docs(spark, [text, ""]), 6, 2))
    assert got == {0: ["One two three. Four five.", "Four five. Six seven eight nine.", "Ten."]}
    long = " ".join(f"w{i}" for i in range(25))
    assert [len(c.split()) for c in chunks_of(K.chunk_recursive(docs(spark, [long]), 10, 0))[0]] == [10, 10, 5]


def test_recursive_keeps_every_word(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bb.", "c!", "dd\nee"]) for _ in range(rng.randint(1, 80))) for _ in range(10)]
    got = chunks_of(K.chunk_recursive(docs(spark, texts), 12, 0))
    assert all(" ".join(got[i]).split() == t.split() for i, t in enumerate(texts))
    assert all(len(c.split()) <= 12 for cs in got.values() for c in cs)


def test_code_packing(spark):
    code = "def a():\n    one\n    two\ndef b():\n    three\n" + "x" * 50
    got = chunks_of(K.chunk_code(docs(spark, [code]), 30))[0]
    assert got[0] == "def a():\n    one\n    two" and all(len(c) <= 30 for c in got)
    assert "".join(c.replace("\n", "") for c in got) == code.replace("\n", "")


def test_hierarchy_invariants(spark):
    text = " ".join(f"word{i}" for i in range(1500))
    tree = K.chunk_hierarchical(docs(spark, [text, "short text here", ""]), [600, 200, 60], 10)
    nodes = {r.chunk_id: r for r in tree.collect()}
    assert {r.doc_id for r in nodes.values()} == {0, 1}
    for r in nodes.values():
        assert (r.parent_id is None) == (r.level == 0)
        if r.parent_id:
            up = nodes[r.parent_id]
            assert up.level == r.level - 1 and r.text.split()[0] in up.text.split()
    mine = sorted((r.node_no, r.level) for r in nodes.values() if r.doc_id == 0)
    assert [n for n, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    parents = K.parent_rows(tree, 2).collect()
    assert all(p.child_count >= 1 for p in parents) and not [p for p in parents if p.doc_id == 1 and p.level == 1]


def test_stored_table_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(d, i, "old") for d in range(20) for i in range(3)], "doc_id bigint, n int, v string")
    I.write_table(rows, path, buckets=4)
    fresh = spark.createDataFrame([(3, 0, "new"), (50, 0, "new")], "doc_id bigint, n int, v string")
    changed = spark.createDataFrame([(3,), (4,), (50,)], "doc_id bigint")
    for _ in range(2):                                            # a repeated batch changes nothing
        I.replace_in_table(spark, path, fresh, changed, buckets=4)
        got = {(r.doc_id, r.n, r.v) for r in I.read_table(spark, path).collect()}
        assert got == {(d, i, "old") for d in range(20) if d not in (3, 4) for i in range(3)} | {(3, 0, "new"), (50, 0, "new")}
    I.replace_in_table(spark, path, fresh.limit(0), spark.range(100).withColumnRenamed("id", "doc_id"), buckets=4)
    assert I.read_table(spark, path).count() == 0


def test_delimited_text(spark):
    df = spark.createDataFrame([('a\tb c\t\n"x\ty"\t"say ""hi"""\tz\n',)], "t string")
    assert df.select(R.delimited_text(F.col("t"), "\t")).first()[0] == 'a, b c, \nx\ty, say "hi", z'
    csv = spark.createDataFrame([('1,2\r\n"a,b",c',)], "t string")
    assert csv.select(R.delimited_text(F.col("t"), ",")).first()[0] == "1, 2\na,b, c"


def test_parsers(spark):
    p = R.Parsers()
    p.register("html", R.html_parser())
    with pytest.raises(ValueError):
        p.register("html", R.html_parser())
    df = spark.createDataFrame([(1, "html", "<p>x</p>"), (2, "txt", "<p>")], "doc_id bigint, doc_type string, text string")
    assert {r.doc_id: r.text for r in p.parse(df).collect()} == {1: "x", 2: "<p>"}
    p.unregister("html")
    assert p.types() == [] and p.parse(df).count() == 2


def test_stream_equals_batch_and_updates(spark, tmp_path):
    inbox, path, cp = (str(tmp_path / n) for n in ("in", "index", "cp"))
    schema = "doc_id bigint, text string, version int"

    def send(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        ingest_stream(spark, inbox, schema, path, cp, size=5, overlap=1).awaitTermination()

    long = " ".join(f"longword{i}" for i in range(12))
    send([(1, long, 1), (2, long, 1)])
    send([(2, "changed text that is long enough to keep", 2), (3, long, 1)])
    got = {}
    for r in read_table(spark, path).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert len(r.vec) == 64
    batch = K.fixed_chunks(docs(spark, ["", long, "changed text that is long enough to keep", long]), 5, 1).orderBy("doc_id", "chunk_index")
    wanted = {}
    for r in batch.collect():
        wanted.setdefault(r.doc_id, []).append(r.text)
    assert got == wanted


def test_settings(spark):
    rules = G.rule_table(spark)
    kbs = spark.createDataFrame([("a",), ("b",)], "kb_id string")
    over = spark.createDataFrame([("a", "chunking.chunk_size", "512")], "kb_id string, key string, value string")
    wide = {r.kb_id: r.chunk_size for r in G.wide(G.resolve(kbs, over, rules), ["chunking.chunk_size"]).collect()}
    assert wide == {"a": "512", "b": "1024"}
    bad = spark.createDataFrame([("a", k, v) for k, v in (
        ("chunking.chunk_size", "10"), ("dedup.enabled", "maybe"), ("redis.url", "x"), ("retrieval.top_k", "3"),
        ("chunking.x", "1"), ("chunking.strategy", "semantic"))], "kb_id string, key string, value string")
    assert {r.key: r.reason for r in G.violations(bad, rules).collect()} == {
        "chunking.chunk_size": "out of range", "dedup.enabled": "bad value", "redis.url": "not overridable",
        "retrieval.top_k": "not overridable", "chunking.x": "unknown key"}
    put = G.put(over, spark.createDataFrame([("a", "dedup.enabled", "false")], "kb_id string, key string, value string"))
    assert [(r.key, r.value) for r in put.collect()] == [("dedup.enabled", "false")]


def test_config_check_rounds_halves_to_even(spark, tmp_path):
    import duckdb

    from stackroom.plans.chunk_queries import chunk_config_check
    from stackroom.plans import load_all

    prices = [62.5, 63.5, 64.5, 100.5, 101.5, 8192.5, 10063.5, 10064.5, 99.49, 99.51]
    rows = [(8 * i + k, p, c) for i, p in enumerate(prices) for k, c in enumerate([62, 63, 64, 65, 100, 101, 102])]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(con.sql(load_all()["chunk_config_check"].sql).fetchall())
    assert sorted(tuple(r) for r in chunk_config_check(spark, str(tmp_path)).collect()) == want


def test_sentences_of_many_documents_are_embedded_together(spark):
    import numpy as np

    from stackroom.operators.chunking import chunk_semantic
    from stackroom.operators.embed import hash_embedder

    def together(texts):
        if len(texts) < 20:
            raise ValueError("a call for each document")
        return hash_embedder()(texts)

    def each(texts):
        return np.vstack([hash_embedder()([t]) for t in texts])

    texts = [f"One word {i}. Two words. Other {i} things here. And {i}." for i in range(12)]
    rows = spark.createDataFrame([*enumerate(texts), (20, None), (21, ""), (22, "Only one")], "doc_id long, text string").coalesce(1)
    got = {tuple(r) for r in chunk_semantic(rows, 0.5, together).collect()}
    assert got == {tuple(r) for r in chunk_semantic(rows, 0.5, each).collect()} and {r[0] for r in got} == {*range(12), 22}
