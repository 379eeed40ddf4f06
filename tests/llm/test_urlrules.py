"""URL rules against a rule-by-rule scan."""

from __future__ import annotations

import random

import duckdb
import pytest

from tests.llm import brute
from tidemark.llm import urlrules

SCHEMA = "page_id long, url string"


def check(spark, urls, rules, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, urlrules.rule_table(spark, rules), **options).collect()}
    want = {i: brute.url_verdict(u, rules, **options) for i, u in enumerate(urls)}
    assert got == want


def test_the_rules_of_the_query(spark):
    check(spark, [
        "http://example.org/es/1", "https://WWW.Example.ORG/en/123?x=/es/", "http://example.org", "http://notexample.org/es/", "http://a.com/fr/x#y", "http://com/de/",
        "http://b.com/de/", "http://comx/de/", "ftp://x.net/", None, "", "no scheme", "http://", "http:///path", "http://a.com?/fr/", "http://a.com/FR/x", "x://y://z.org/a",
        "http://user@example.org/es/", "http://example.org./es/", "http://example.org:80/es/", "http://.org/x", "http://ÉXAMPLE.org/es/", "http://example.org/es", "http://example.org/es/\u00e9",
    ], urlrules.RULES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_nested_rules(spark, seed):
    rng = random.Random(seed)
    labels, parts = ["a", "b", "ab", "é", "a-b", "", "-"], ["", "/", "/a", "/a/", "/ab/", "/a/b", "/é"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))

    rules = list({(h, p): (h, p, rng.choice(("allow", "block"))) for h, p in ((host().lower(), rng.choice(parts)) for _ in range(40))}.values())
    urls = [f"http://{host()}{rng.choice(parts)}{rng.choice(['', 'x', '/b', '?q', '#f'])}" for _ in range(300)]
    check(spark, urls, rules, default=rng.choice(("allow", "block")))


def test_equal_rules_block_and_bad_rules_are_ignored(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a"), (1, "http://x.org/a"), (None, "http://y.net/")], SCHEMA).selectExpr("*", "'c' as host", "'c' as rule", "1 as k")
    rules = urlrules.rule_table(spark, [("x.org", "/", "allow"), ("X.org", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("net", "/", None)])
    got = sorted(map(tuple, urlrules.judge(pages, rules).collect()), key=str)
    assert got == [(1, "x.org", "/a", "x.org/", "block")] * 2 + [(None, "y.net", "/", None, "allow")]


def test_only_latin_letters_are_lowered(spark):
    pages = spark.createDataFrame([(1, "http://É.ORG/a"), (2, "http://é.org/a")], SCHEMA)
    rules = urlrules.rule_table(spark, [("É.Org", "/", "block")])
    assert sorted((r.page_id, r.host, r.rule, r.verdict) for r in urlrules.judge(pages, rules).collect()) == [(1, "É.org", "É.org/", "block"), (2, "é.org", None, "allow")]


def test_very_long_urls_and_clashing_columns(spark):
    long = "http://" + "a." * 2000 + "example.org/es/" + "x" * 500_000
    pages = spark.createDataFrame([(1, long), (2, "http://" + "y" * 300_000), (3, "http://b.com/de/" + "/" * 100_000)], SCHEMA)
    pages = pages.selectExpr("*", *(f"'clash' as {c}" for c in ("host", "path", "rule", "verdict", "k", "lo", "bin", "salt", "stack")))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, urlrules.rule_table(spark, urlrules.RULES)).collect()}
    assert got == {r.page_id: brute.url_verdict(r.url, urlrules.RULES) for r in pages.collect()}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a")], SCHEMA)
    rules = urlrules.rule_table(spark, urlrules.RULES)
    assert urlrules.judge(pages.limit(0), rules).isEmpty()
    assert [r.verdict for r in urlrules.judge(pages, rules.limit(0)).collect()] == ["allow"]


def test_no_python_on_the_main_path(spark, sf):
    plan = urlrules.op2_urlrules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_query_gives_what_its_sql_gives(spark, large):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{large}/pages.parquet'")
    want = con.execute(urlrules.ORACLE_SQL).fetchall()
    got = urlrules.op2_urlrules(spark, large)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    rows = spark.read.parquet(f"{large}/pages.parquet").collect()
    assert sorted(want, key=str) == sorted(((r.page_id, *brute.url_verdict(r.url, urlrules.RULES)) for r in rows), key=str)
