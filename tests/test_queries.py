"""The registered core queries against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import series
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return found


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v != v:
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, con, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) > 0
    assert rows(got) == rows(want)


def test_every_core_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_a_range_read_pushes_its_bounds_into_the_scan(spark, tmp_path):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1997-03-10 00:00:00", "1998-02-20 00:00:00"))
    plan = series.slice_closed(catalogue.ld(spark, SF), low, high)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "l_extendedprice" not in scan


def test_the_core_does_not_import_the_corpus_operators():
    for folder, _, names in os.walk(os.path.dirname(catalogue.__file__).rsplit("/", 1)[0]):
        if "/llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(f"{folder}/{n}") as f:
                        assert "tidemark.llm" not in f.read()
