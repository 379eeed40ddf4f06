"""Mixing against a loop that deals out the excess, and the SQL of the query."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def made(sizes: dict[str | None, int], seed: int = 0):
    rng, out = random.Random(seed), []
    for source, n in sizes.items():
        while n > 0:
            k = min(n, rng.randint(1, 30))
            out.append((len(out), " ".join(["w"] * k), source))
            n -= k
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 1000, "b": 1000, "c": 1000}, {"a": 10, "b": 2000, "c": 300, "d": 4000}, {"a": 5000, "b": 5, "c": 5, None: 40}, {"only": 100}, {"B": 100, "a": 100, "Z": 500, "é": 70},
])
def test_targets_and_what_is_taken(spark, sizes):
    docs = made(sizes)
    _, total, goal = brute.mix(docs)
    rows = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == len(docs)
    for source in total:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == total[source] and own[0].target == pytest.approx(goal[source])
        assert abs(sum(r.taken for r in own) - goal[source]) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(total.values()))


def test_boundary_buckets_are_refined(spark):
    rows = spark.createDataFrame([("+a", h, 10) for h in [*range(0, 4096 * 5, 4096), *((1 << 48) + i for i in range(40))]], "key string, h long, size long")
    edge = mixing._thresholds(rows, spark.createDataFrame([("+a", 123)], "key string, rest long")).collect()
    below = sorted(r.h for r in rows.collect())
    assert [(r.h, r.below, r.within) for r in edge] == [(below[12], 120, 10)]


def test_very_long_texts(spark):
    docs = [(1, "w " * 400_000, "a"), (2, "x" * 1_000_000, "a"), (3, "v " * 1000, "b")]
    rows = spark.createDataFrame(docs, SCHEMA)
    sizes, _, goal = brute.mix(docs)
    got = {r.doc_id: r for r in mixing.mix(rows).collect()}
    assert [got[i].size for i in (1, 2, 3)] == sizes and abs(got[1].taken + got[2].taken - goal["a"]) <= 1
    taken = {}
    for r in mixing.apply_mix(rows).select("doc_id", mixing.words(F.col("text")).alias("n")).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.n
    assert taken == {i: r.taken for i, r in got.items() if r.taken}


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "p q r", "a"), (4, " \t ", "empty")], SCHEMA)
    docs = docs.withColumns({"size": F.lit("clash"), "target": F.lit(1), "key": F.lit(2), "h": F.lit(3)})
    rows = mixing.mix(docs).collect()
    assert len(rows) == 6 and {r.doc_id: r.size for r in rows} == {1: 0, 2: 0, 3: 2, None: 3, 4: 0}
    assert all(r.taken == 0 for r in rows if r.size == 0) and next(r.target for r in rows if r.source == "empty") == 0
    twice = [r.taken for r in rows if r.doc_id == 3]
    assert twice[0] == twice[1]
    assert mixing.mix(docs.limit(0)).isEmpty() and mixing.apply_mix(docs.limit(0)).isEmpty()


def test_applying_the_mix(spark):
    docs = spark.createDataFrame(made({"a": 300, "b": 900, "c": 2000}, 4), SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got: dict[int, int] = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {i: n for i, n in taken.items() if n}


def test_reruns_agree(spark):
    docs = made({"a": 500, "b": 700, "c": 100}, 3)
    first = sorted(map(tuple, mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()))
    random.Random(1).shuffle(docs)
    assert sorted(map(tuple, mixing.mix(spark.createDataFrame(docs, SCHEMA).repartition(7)).collect())) == first


@pytest.mark.parametrize("which", ["sf", "large"])
def test_query_gives_what_its_sql_gives(spark, request, which):
    path = request.getfixturevalue(which)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    want = con.execute(mixing.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, mixing.op5_mixing(spark, path).collect())) == sorted(want)


def test_no_python_on_the_main_path(spark, sf):
    plan = mixing.op5_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
