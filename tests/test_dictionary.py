from __future__ import annotations

import random

import pytest

from stackroom.operators import dictionary as D


def plain(words: list[str], entries: set[tuple]) -> list[str]:
    out, at = [], 0
    while at < len(words):
        n = max((k for k in range(1, len(words) - at + 1) if tuple(words[at:at + k]) in entries), default=1)
        out.append(" ".join(words[at:at + n]))
        at += n
    return out


def test_trie_equals_trying_every_length():
    rng = random.Random(2)
    for _ in range(300):
        entries = {tuple(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(8))}
        words = [rng.choice("abcde") for _ in range(rng.randrange(25))]
        assert D.Trie([list(e) for e in entries]).tokens(words) == plain(words, entries)


def test_file_and_tokens(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# comment\tNNP\n\nNew York\tNNP\t3.5\nnew york city\tNNP\nno tag\nbad\tNNG\tx\n  \n", encoding="utf-8")
    entries = D.read_dictionary(spark, str(tmp_path / "d.tsv"))
    assert sorted(tuple(r) for r in entries.collect()) == [("New York", "NNP", 3.5), ("bad", "NNG", 10.0), ("new york city", "NNP", 10.0)]
    docs = spark.createDataFrame([(1, "In NEW York  city\nnew york new"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in D.dictionary_tokens(docs, entries, "doc_id").collect()}
    assert got[1] == ["in", "new york city", "new york", "new"] and not got[2] and not got[3]


def test_a_large_dictionary_stops(spark, monkeypatch):
    monkeypatch.setattr(D, "LARGEST", 5)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        D.dictionary_tokens(docs, spark.createDataFrame([("long expression",)], "expression string"), "doc_id")


def test_a_repeated_word_keeps_every_second_window(spark):
    from stackroom.plans.text_queries import dictionary_counts

    docs = spark.createDataFrame([(k, "The " * k + "end") for k in range(7)] + [(7, "a b a b a"), (8, ""), (9, None), (10, "a")],
                                 "doc_id long, text string")
    entries = spark.createDataFrame([("the the",), ("the end",), ("a b",), ("b a",)], "e string")
    got = {(r.doc_id, r.expression): r.n for r in dictionary_counts(docs, entries).collect()}
    want = {(k, "the the"): k // 2 for k in range(2, 7)} | {(k, "the end"): 1 for k in range(1, 7)} | {(7, "a b"): 2, (7, "b a"): 2}
    assert got == want
