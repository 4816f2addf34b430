from __future__ import annotations

import corpus_pipeline
from fixtures import FOLDER

from stackroom.llm.queries import QUERIES


def test_every_stage_keeps_columns_and_its_decisions(spark, documents, tmp_path):
    docs, ids = documents, {r["doc_id"] for r in documents.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in QUERIES["op10_toxicity_crf"].run(spark, FOLDER).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == documents.columns and left <= ids and docs.count() == len(left)
        if name == "toxicity":
            assert left == ids - toxic and toxic
        if name == "line_dedup":
            assert left == ids
        if name == "simhash_near_dedup":
            assert docs.select("text").distinct().count() == docs.count()
        ids = left
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {d for r in mixed for d in r["doc_ids"]} <= ids
    assert all(len(r["text"].split(" ")) == r["n_words"] for r in mixed)


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        docs.collect()


def test_queries_run(spark):
    want = {"op1": 6, "op2": 5, "op3": 10, "op4": 3, "op5": 6, "op6": 7, "op7": 4, "op8": 4, "op9": 5, "op10": 5, "op11": 8,
            "op12": 8, "op13": 7}
    for name, query in QUERIES.items():
        assert len(query.run(spark, FOLDER).columns) == want[name.split("_")[0]], name
