from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stackroom.operators import generations as G

SCHEMA = "doc_id long, n int, v string"


def rows(table) -> list:
    return sorted(((r.doc_id, r.n, r.v) for r in table.collect()), key=str)


def test_generations_equal_a_dictionary(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "t")
    state = {d: [(d, i, "first") for i in range(rng.randrange(3))] for d in range(30)}
    G.create(spark.createDataFrame([r for v in state.values() for r in v] + [(None, 0, "no key")], SCHEMA), path)
    for step in range(6):
        changed = rng.sample(range(40), 7)
        fresh = {d: [(d, i, f"s{step}") for i in range(rng.randrange(3))] for d in changed}
        state |= fresh
        G.upsert(spark.createDataFrame([r for v in fresh.values() for r in v], SCHEMA),
                 spark.createDataFrame([(d,) for d in [*changed, changed[0]]], "doc_id long"), path)
        if step == 3:
            before = rows(G.read(spark, path))
            G.compact(spark, path)
            G.clean(spark, path)
            assert rows(G.read(spark, path)) == before
        want = sorted([r for v in state.values() for r in v] + [(None, 0, "no key")], key=str)
        assert rows(G.read(spark, path)) == want


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    G.create(spark.range(10_000).selectExpr("id AS doc_id", "1 AS n", "'x' AS v"), path)
    gen = G.upsert(spark.range(10).selectExpr("id AS doc_id", "2 AS n", "'y' AS v"), spark.range(10).selectExpr("id AS doc_id"), path)
    assert spark.read.parquet(f"{path}/rows/{G.GEN}={gen}").count() == 10
    assert spark.read.parquet(f"{path}/keys/{G.GEN}={gen}").count() == 10
    assert G.read(spark, path).count() == 10_000 and G.read(spark, path, at=0).where("n = 2").count() == 0


def test_a_failed_job_keeps_the_old_state(spark, tmp_path):
    path = str(tmp_path / "t")
    G.create(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], SCHEMA), path)
    broken = spark.createDataFrame([(1, 2, "c")], SCHEMA).withColumn("n", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        G.upsert(broken, spark.createDataFrame([(1,)], "doc_id long"), path)
    # Files of a job that died between writing and its mark are not seen either.
    spark.createDataFrame([(1, 9, "lost")], SCHEMA).write.mode("overwrite").parquet(f"{path}/rows/{G.GEN}=1")
    assert rows(G.read(spark, path)) == [(1, 1, "a"), (2, 1, "b")]
    G.upsert(spark.createDataFrame([(1, 3, "d")], SCHEMA), spark.createDataFrame([(1,)], "doc_id long"), path)
    assert rows(G.read(spark, path)) == [(1, 3, "d"), (2, 1, "b")]


def test_marks(spark, tmp_path):
    path = str(tmp_path / "t")
    G.create(spark.createDataFrame([(1, 1, "a")], SCHEMA), path)
    # A writer died after its rows and before its mark was whole: its generation doesn't count.
    spark.createDataFrame([(1, 9, "lost")], SCHEMA).write.parquet(f"{path}/rows/{G.GEN}=1")
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(f"{path}/keys/{G.GEN}=1")
    (tmp_path / "t" / "marks" / "mark-000000000001").touch()
    assert G.current(spark, path) == (0, 0) and rows(G.read(spark, path)) == [(1, 1, "a")]
    assert G.upsert(spark.createDataFrame([(2, 2, "b")], SCHEMA), spark.createDataFrame([(2,)], "doc_id long"), path) == 2
    assert rows(G.read(spark, path)) == [(1, 1, "a"), (2, 2, "b")]
    with pytest.raises(Exception, match="exist"):
        G._mark(spark, path, 2, 0)


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    none = spark.createDataFrame([], SCHEMA)
    G.create(none, path)
    assert G.read(spark, path).columns == ["doc_id", "n", "v"] and G.read(spark, path).count() == 0
    G.upsert(none, none.select("doc_id"), path)
    assert G.read(spark, path).count() == 0
