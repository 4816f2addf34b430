from __future__ import annotations

import itertools

import numpy as np
from fixtures import FOLDER, ODD, prose
from pyspark.sql import functions as F

from stackroom.llm import toxicity_crf as tc


def test_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = tc.toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.93
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert any(r["spans"] for r in got if r["predicted"])


def test_held_out_labels_are_not_used(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(tc.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in tc.toxicity(documents, x).collect()} for x in (labels, turned))
    assert a == b


def test_marginals_equal_enumeration():
    """Forward-backward over tokens with features against the sum over all paths."""
    rng = np.random.default_rng(0)
    model = tc.Crf(np.append(rng.normal(size=5), 0.0), -0.7, rng.normal(size=(2, 2)), np.zeros(3))
    texts = [(7, {1: [0, 5, 5, 5], 4: [1, 2, 5, 5]}), (5, {}), (0, {}), (6, {0: [3, 5, 5, 5], 1: [4, 5, 5, 5], 5: [2, 5, 5, 5]})]
    n = np.array([t for t, _ in texts])
    counts = np.array([len(f) for _, f in texts])
    place = np.array([p for _, f in texts for p in f], np.int64)
    ids = np.array([i for _, f in texts for i in f.values()])
    got = model.marginals(n, counts, place, ids)
    want = []
    for size, found in texts:
        total, toxic = 0.0, dict.fromkeys(found, 0.0)
        for path in itertools.product((0, 1), repeat=size):
            s, before = 0.0, 0
            for t, y in enumerate(path):
                s += model.moves[before, y] + y * (model.bias + model.weights[found.get(t, [5])].sum())
                before = y
            total += np.exp(s)
            for t in found:
                toxic[t] += path[t] * np.exp(s)
        want += [v / total for v in toxic.values()]
    assert np.allclose(got, want)


def test_odd_rows_and_no_labels(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1, 1), (6, 1, 0), (None, 1, 1), (7, 1, None), (99, 1, 1), (8, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = tc.toxicity(odd, labels).collect()
    assert len(got) == len(ODD)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in tc.toxicity(odd, none).collect()} == {0}
    assert tc.toxicity(empty, none).count() == 0
    kept = tc.mild_documents(odd, labels)
    assert kept.columns == odd.columns


def test_planted_insults_are_found_with_their_places(spark):
    docs, labels = [], []
    for i in range(300):
        words = prose(i, 80).split()
        if i % 6 == 0:
            for k in range(5):
                words[10 * k + i % 7] = ("Vilebrute", "nastyfool")[k % 2]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = tc.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in got)
    text = dict(docs)
    found = {text[r["doc_id"]].encode()[s["start"]:s["end"]].decode() for r in got for s in r["spans"]}
    assert found == {"Vilebrute", "nastyfool"}
