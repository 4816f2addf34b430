from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stackroom.operators import generations as G
from stackroom.operators.replay import replay
from stackroom.operators.sequence import found_pairs, look_up_keys, sketches
from stackroom.sources.readers import Parsers, html_parser
from stackroom.streaming import dedup_ingest as D

WORDS = "river stone mill bridge boat lamp glass voice lane dog home dinner child name spring water".split()


def text(seed: int, n: int = 250) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(base: str, n: int, seed: int, title: str = "") -> str:
    rng, words = random.Random(seed), base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(999)}"
    return (title + "\n" if title else "") + " ".join(words)


def corpus(n: int = 60) -> list[tuple]:
    """(doc_id, text, date): copies, near copies under the same and other titles, and texts of their own."""
    rng, out = random.Random(3), []
    bases = [text(s) for s in range(6)]
    for d in range(n):
        kind, base = rng.randrange(5), rng.choice(bases)
        body = text(1000 + d) if kind == 0 else base if kind == 1 else edited(
            base, rng.choice([0, 1, 3, 25]), d, rng.choice(["", "first title", "second title", "third"]))
        out.append((d, body, None if rng.random() < 0.15 else rng.randrange(50)))
    return out


def frame(spark, rows, version=1):
    return spark.createDataFrame([(d, "kb", "txt", t, version, at) for d, t, at in rows], D.INCOMING)


def decisions(table) -> dict:
    return {r.doc_id: (r.candidate_id, r.body_match, r.title_match, r.action, r.replaced_by, r.live) for r in table.collect()}


def one_replay(spark, rows) -> dict:
    docs = D.parsed(frame(spark, rows), Parsers()).withColumn("digest", F.sha2("text", 256))
    group = docs.groupBy("digest").agg(F.min("doc_id").alias("group"))
    lead = docs.join(group.select(F.col("group").alias("doc_id")), "doc_id", "left_semi")
    placed = docs.join(group, "digest").select("doc_id", "group", "doc_created_at")
    return decisions(replay(placed, found_pairs(sketches(lead), lead)))


def test_batches_end_as_one_replay(spark, tmp_path):
    rows = corpus()
    want = one_replay(spark, rows)
    assert len({v[3] for v in want.values()}) >= 3 and any(v[4] is not None for v in want.values())
    path = str(tmp_path / "index")
    for number, low in enumerate((0, 20, 40)):
        D.ingest_batch(frame(spark, rows[low:low + 20]), number, path, Parsers(), 50, 5)
    assert decisions(G.read(spark, f"{path}/decisions")) == want
    live = {d for d, v in want.items() if v[5]}
    stored = {r.doc_id for r in G.read(spark, f"{path}/documents").select("doc_id").collect()}
    chunks = {r.doc_id for r in G.read(spark, f"{path}/chunks").select("doc_id").distinct().collect()}
    assert stored == live and chunks == live
    # A batch that is sent again changes nothing.
    before = G.current(spark, f"{path}/decisions")
    D.ingest_batch(frame(spark, rows[40:]), 2, path, Parsers(), 50, 5)
    assert G.current(spark, f"{path}/decisions") == before


def test_a_batch_cut_short_is_done_again(spark, tmp_path, monkeypatch):
    rows = corpus(40)
    path = str(tmp_path / "index")
    D.ingest_batch(frame(spark, rows[:20]), 0, path, Parsers(), 50, 5)
    real, calls = G.upsert, []

    def broken(*args):
        calls.append(args)
        if len(calls) == 3:
            raise OSError("lost")
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(G, "upsert", broken)
        with pytest.raises(OSError):
            D.ingest_batch(frame(spark, rows[20:]), 1, path, Parsers(), 50, 5)
    D.ingest_batch(frame(spark, rows[20:]), 1, path, Parsers(), 50, 5)
    want = one_replay(spark, rows)
    assert decisions(G.read(spark, f"{path}/decisions")) == want
    assert {r.doc_id for r in G.read(spark, f"{path}/documents").collect()} == {d for d, v in want.items() if v[5]}


def test_versions_and_parsers(spark, tmp_path):
    path, parsers = str(tmp_path / "index"), Parsers()
    parsers.register("html", html_parser())
    page = "<p>" + text(5, 60) + "</p>"
    D.ingest_batch(spark.createDataFrame([(1, "kb", "html", page, 2, 1), (2, "kb", "txt", text(6, 60), 1, 1)], D.INCOMING),
                   0, path, parsers, 50, 5)
    D.ingest_batch(spark.createDataFrame([(1, "kb", "txt", text(7, 60), 1, 1), (2, "kb", "txt", text(8, 60), 2, 1)], D.INCOMING),
                   1, path, parsers, 50, 5)
    got = {r.doc_id: r.text for r in G.read(spark, f"{path}/documents").collect()}
    assert got == {1: text(5, 60), 2: text(8, 60)}
    first = {r.text for r in G.read(spark, f"{path}/chunks").where("doc_id = 2").collect()}
    assert first and all(t in text(8, 60) for t in first)


def test_keys_find_whatever_is_a_pair(spark):
    rows = corpus(50)
    docs = D.parsed(frame(spark, rows), Parsers())
    lead = docs.join(docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi")
    sketched = sketches(lead)
    keys = look_up_keys(sketched).collect()
    held = {}
    for r in keys:
        held.setdefault(r.doc_id, set()).add((r.kb_id, r.kind, r.key))
    pairs = {(r.group, r.other) for r in found_pairs(sketched, lead).collect()}
    assert pairs and all(held[a] & held[b] for a, b in pairs)


def test_documents_that_meet_in_the_fold_end_as_a_replay_over_all_pairs(spark):
    """No table of pairs: spanning links, and the best indexed document alone is confirmed."""
    from stackroom.operators.sequence import replay_texts

    rows = corpus(90) + [(200 + i, "ab" if i % 3 else "", i) for i in range(6)] + [(300 + i, f"{text(5)} end {i}", 60 - i) for i in range(8)]
    docs = D.parsed(frame(spark, rows), Parsers()).withColumn("digest", F.sha2("text", 256)).localCheckpoint()
    group = docs.groupBy("digest").agg(F.min("doc_id").alias("group"))
    lead = docs.join(group.select(F.col("group").alias("doc_id")), "doc_id", "left_semi")
    placed = docs.join(group, "digest").select("doc_id", "group", "doc_created_at")
    sketched = sketches(lead).localCheckpoint()
    want = decisions(replay(placed, found_pairs(sketched, lead)))
    got = decisions(replay_texts(placed, sketched, lead))
    assert got == want and len({v[3] for v in want.values()}) >= 3
