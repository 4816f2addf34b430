from __future__ import annotations

import binascii

import pytest
from fixtures import ODD
from pyspark.sql import functions as F

from stackroom.llm import language_id as li


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_uses_the_text_alone(documents):
    mixed = documents.withColumn("lang", F.when(li.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    plain = {(r["doc_id"], r["lang_pred"], r["score"]) for r in li.predict(documents).collect()}
    assert plain == {(r["doc_id"], r["lang_pred"], r["score"]) for r in li.predict(mixed).collect()}


def test_odd_rows(odd, empty):
    got = li.predict(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 5))
    assert by_id[14]["lang_pred"] == "ja" or by_id[14]["held_out"]
    assert li.predict(empty).count() == 0
    nothing = li.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_too_many_languages_stop(spark):
    rows = spark.createDataFrame([(str(i), "text") for i in range(9)], "lang string, text string")
    with pytest.raises(ValueError):
        li.learn(rows, max_languages=8)
