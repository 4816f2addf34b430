from __future__ import annotations

import pyarrow as pa
import pytest

from stackroom.operators import dictionary, simhash
from stackroom.operators.batches import pieces


@pytest.mark.parametrize("values", [["aaa", None, "", "b" * 40, "c", "dd", ""], [["x"] * 3, None, [], ["y"] * 40, ["z"], ["v", "w"], []]])
def test_pieces_are_whole_and_bounded(values):
    batch = pa.record_batch({"id": list(range(7)), "v": pa.array(values)})
    for part in (batch, batch.slice(2)):
        for most in (1, 4, 44, 1000):
            cut = list(pieces(part, "v", most))
            assert pa.Table.from_batches(cut).to_pylist() == part.to_pylist()
            assert all(p.num_rows == 1 or sum(len(v or "") for v in p.column("v").to_pylist()) <= most for p in cut)
    assert list(pieces(batch.slice(7), "v")) == []


def test_texts_and_words_are_taken_in_pieces(spark, monkeypatch):
    """What runs in the tasks is called here, with one large batch."""
    runs = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", lambda df, run, schema: runs.append(run))
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    simhash.simhash64(docs, "doc_id")
    dictionary.dictionary_tokens(docs, spark.createDataFrame([("a b",)], "expression string"), "doc_id")
    monkeypatch.undo()
    texts = ["w%d x y z " % i * 2000 for i in range(120)]
    out = list(runs[0](iter([pa.record_batch({"doc_id": list(range(120)), "text": texts})])))
    assert len(out) > 2 and [p for b in out for p in b.column("simhash").to_pylist()] == simhash.simhashes(texts, {}).tolist()
    out = list(runs[1](iter([pa.record_batch({"doc_id": list(range(120)), "words": [t.split() for t in texts]})])))
    assert len(out) > 1 and [t for b in out for t in b.column("tokens").to_pylist()] == [t.split() for t in texts]
