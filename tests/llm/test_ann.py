"""Nearest neighbours: recall and exact scores against brute force, bounds of the one-bit codes, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def recall(got, want) -> float:
    own, true = {(r[0], r[2]) for r in got}, {(r[0], r[2]) for r in want}
    return len(own & true) / len(true)


def coded(v, q, bits=512):
    mean, turn = v.mean(axis=0), ann.rotation(v.shape[1], bits)
    assert np.allclose(turn @ turn.T, np.eye(v.shape[1])) and turn.shape[1] % 64 == 0
    codes, queries = ann.Codes(*ann.encode(v, mean, turn)), ann.Queries.of(q, mean, turn)
    return tuple(np.array(x) for x in zip(*(codes.compare(queries, i) for i in range(len(q))), strict=True))


@pytest.mark.parametrize("d", [3, 64, 700])
def test_errors_are_those_of_the_estimates(d):
    rng = np.random.default_rng(0)
    v, q = rng.standard_normal((2000, d)), rng.standard_normal((50, d))
    estimate, error = coded(v, q)
    true = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    off = np.abs(estimate - true) / error
    assert (off <= 2).mean() > 0.9 and (off <= 3).mean() > 0.98
    assert np.corrcoef(estimate.ravel(), true.ravel())[0, 1] > 0.7


def test_packed_counts_are_inner_products():
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((40, 16)), rng.standard_normal((5, 16))
    mean, turn = v.mean(axis=0), ann.rotation(16, 128)
    estimate, _ = coded(v, q, 128)
    for i, x in enumerate(q):
        turned = (x - mean) / np.linalg.norm(x - mean) @ turn
        step = (turned.max() - turned.min()) / 15
        rounded = turned.min() + step * np.rint((turned - turned.min()) / step)
        for j, y in enumerate(v):
            own = (y - mean) / np.linalg.norm(y - mean) @ turn
            cosine = (2 * rounded[own > 0].sum() - turned.sum()) / np.abs(own).sum()
            want = np.sum((y - mean) ** 2) + np.sum((x - mean) ** 2) - 2 * np.linalg.norm(y - mean) * np.linalg.norm(x - mean) * cosine
            assert abs(estimate[i, j] - want) < 1e-8


@pytest.mark.parametrize(("d", "block"), [(8, 32768), (48, 7)])
def test_neighbours_agree_with_brute_force(spark, d, block):
    rng = np.random.default_rng(d)
    centres = rng.standard_normal((10, d)) * 3
    data = [(int(i), [float(x) for x in np.float32(centres[i % 10] + rng.standard_normal(d))]) for i in range(700)]
    data += [(1000 + i, data[i][1]) for i in range(40)]  # copies: ties go to the smaller id
    rows = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = [tuple(r) for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, block=block).collect()]
    want = brute.nearest(data, {i for i, _ in data if i % 20 == 0})
    assert recall(got, want) >= 0.98
    exact = {(q, i): s for q, _, i, s in want}
    assert all(abs(s - exact[q, i]) < 1e-9 for q, _, i, s in got if (q, i) in exact)
    for q in {r[0] for r in got}:
        own = sorted((r for r in got if r[0] == q), key=lambda r: r[1])
        assert [r[1] for r in own] == list(range(1, 11)) and [(r[3], r[2]) for r in own] == sorted((r[3], r[2]) for r in own)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (8, [1.0, 3.0]), (8, [1.0, 3.0]),
            (100, [1.0, 3.0]), (200, None)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    rows = rows.unionByName(spark.createDataFrame([(9, None)], "vec_id long, embedding array<double>")).withColumn("embedding", F.when(F.col("vec_id") == 9, F.array(F.lit(1.0), F.lit(None))).otherwise(F.col("embedding")))
    rows = rows.withColumns({"v": F.lit("clash"), "bits": F.lit(1), "label": F.lit(0), "norm": F.lit("x")})
    got = sorted(tuple(r) for r in ann.nearest(rows, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 8, 1.0), (0, 4, 100, 1.0), (100, 1, 1, 0.0), (100, 2, 8, 0.0), (100, 3, 8, 0.0), (100, 4, 0, 1.0)]
    assert ann.nearest(rows.limit(0), F.col("vec_id") % 100 == 0).isEmpty()


def test_query_recall(spark, large):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{large}/embeddings.parquet").collect()]
    got = [tuple(r) for r in ann.op7_ann(spark, large).collect()]
    want = brute.nearest(data, {i for i, _ in data if i is not None and i % 100 == 0})
    assert len(got) == len(want) and recall(got, want) >= 0.97


def test_few_vectors_are_reranked(spark):
    """On 2,000 vectors of 64 dimensions: a tenth at most is fetched, and codes without vectors are what is scanned."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.index(rows)
    asked = found.vectors.where("vec_id % 100 = 0").toPandas()
    pairs, _ = ann.candidates(found, asked, 10)
    assert pairs.count() <= 0.1 * len(asked) * found.codes.count()
    assert found.codes.columns == ["vec_id", "bits", "norm", "inner"] and len(found.codes.first()["bits"]) == 64
    data = [(r.vec_id, r.embedding) for r in rows.collect()]
    got = [tuple(r) for r in ann.nearest(rows, F.col("vec_id") % 100 == 0).collect()]
    assert recall(got, brute.nearest(data, set(asked["vec_id"]))) >= 0.98


def test_very_long_vectors(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.standard_normal(3000)]) for i in range(30)]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") == 0).collect()]
    assert recall(got, brute.nearest([(i, [float(np.float32(x)) for x in v]) for i, v in data], {0})) >= 0.8
