"""The driver queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: module of this package that has a function of that name.
_HOMES = {
    "op1_simhash": "simhash",
    "op2_urlrules": "urlrules",
    "op3_toxicity": "toxicity",
    "op4_fingerprints": "fingerprints",
    "op5_mixing": "mixing",
    "op6_quality": "quality",
    "op7_ann": "ann",
    "op8_warc": "warc",
    "op9_htmltext": "htmltext",
    "op10_packing": "packing",
}


def _lazy(name: str, home: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"tidemark.llm.{home}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazy(name, home) for name, home in _HOMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, home in _HOMES.items():
        sql = getattr(import_module(f"tidemark.llm.{home}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
