from __future__ import annotations

import math

import numpy as np
import pytest

from stackroom.llm import whitening as wh
from stackroom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple[int | None, list[float]]], k: int):
    """Whitened vectors up to sign by numpy's own eigensolver, exact deviations."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    y = [[n * a - s for a, s in zip(r, sums)] for r in x]
    centred = np.array([[a / n for a in r] for r in y])
    matrix = centred.T @ centred / n
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [sum(a * a for a in r) for r in y], centred @ vectors / np.sqrt(values), values / matrix.trace()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_a_plain_eigensolver(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.orderBy("vec_id").collect()]
    deviation, whitened, explained = brute(rows, 32)
    got = QUERIES["op13_whitening"].run(spark, folder).toPandas().sort_values(["vec_id", "component"])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == len(rows) * 32 and got["n"].eq(len(rows)).all()
    assert got["deviation"].to_numpy().reshape(-1, 32)[:, 0].tolist() == deviation
    w = got["whitened"].to_numpy().reshape(-1, 32)
    sign = np.sign((w * whitened).sum(axis=0))
    assert np.abs(w - whitened * sign).max() < 1e-6
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 32)[0], explained, rtol=1e-9)
    assert np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


@pytest.mark.parametrize("case", ["random", "diagonal", "equal", "blocks", "rank", "one", "two"])
def test_leading_components(case):
    rng = np.random.default_rng(5)
    n = {"one": 1, "two": 2}.get(case, 40)
    a = rng.standard_normal((n, n))
    matrix = {"random": a @ a.T, "diagonal": np.diag(rng.random(n)), "equal": np.eye(n) * 3.0, "one": a @ a.T, "two": a @ a.T,
              "blocks": np.kron(np.eye(4), a[:10, :10] @ a[:10, :10].T) if n == 40 else None, "rank": a[:, :3] @ a[:, :3].T}[case]
    k = min(12, n)
    values, vectors = wh.leading(matrix, k)
    norm = np.abs(matrix).max() * n
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-13 * norm)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * norm
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in np.float32(rng.standard_normal(5))], 1) for i in range(40)]
    odd = [(None, [0.5] * 5, None), (7, [0.25] * 5, 1), (7, [0.25] * 5, 1), (50, None, 1), (51, [1.0, None, 1.0, 1.0, 1.0], 1),
           (52, [float("nan")] * 5, 1), (53, [1.0, 2.0, 3.0, 4.0, float("-inf")], 1), (54, [], 1), (55, [1.0, 2.0], 1)]
    df = spark.createDataFrame(good + odd, SCHEMA).repartition(3).selectExpr("*", "'x' AS id", "'x' AS vec", "'x' AS n", "'x' AS at")
    got = wh.whiten(df).collect()
    kept = [(i, v) for i, v, _ in good + odd[:3]]
    assert len(got) == 43 * 5
    deviation, whitened, _ = brute(kept, 5)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    for c in range(5):
        assert np.allclose(sorted(abs(r["whitened"]) for r in got if r["component"] == c + 1), sorted(abs(whitened[:, c])), atol=1e-9)
    assert len({r["whitened"] for r in got if r["vec_id"] == 7 and r["component"] == 1}) == 2


def test_tables_without_directions(spark):
    assert wh.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1)], SCHEMA)).count() == 0
    assert wh.whiten(spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(4)], SCHEMA)).count() == 0
    # Two equal dimensions have one direction.
    twice = wh.whiten(spark.createDataFrame([(i, [float(i), float(i)], 1) for i in range(4)], SCHEMA)).collect()
    assert {r["component"] for r in twice} == {1} and abs(twice[0]["explained"] - 1) < 1e-12


def test_huge_entries_and_other_types(spark):
    rows = [(f"a{i}", [float(i) * 1e15, 1.0 * i * i]) for i in range(5)] + [("b", [1e300, -1e300])]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    assert len(got) == 12 and all(r["deviation"] is None for r in got)
    assert all(math.isfinite(r["whitened"]) for r in got)
