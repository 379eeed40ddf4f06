"""The pipeline's stages, each against what its operator decides, and the registered queries."""

from __future__ import annotations

import importlib

import pytest

import __spark_entry__ as entry
from tests.llm.test_nearcopies import expected
from tidemark.llm import mixing, quality, queries, simhash, toxicity

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, large, tmp_path_factory):
    """What each stage keeps, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{large}/documents.parquet"), []
    out.append(docs)
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, large).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_filters_drop_what_their_classifiers_reject(spark, large, stages):
    labels = spark.read.parquet(f"{large}/labels.parquet")
    assert ids(stages[1]) == ids(toxicity.classify(stages[0], labels).where("predicted = 0"))
    assert ids(stages[2]) == ids(quality.classify(stages[1], labels).where("predicted = 1"))
    held = stages[0].join(labels, "doc_id").where("toxic = 0 and quality = 1")
    kept = stages[2].join(labels, "doc_id").where("toxic = 0 and quality = 1")
    assert kept.count() > 0.97 * held.count()


def test_one_of_each_group_stays(stages):
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = expected(docs)
    assert ids(stages[3]) == want


def test_the_mix_takes_its_targets(stages):
    want = {r.doc_id: r.taken for r in mixing.mix(stages[3]).collect()}
    got: dict[int, int] = {}
    for r in stages[4].select("doc_id", mixing.words(stages[4]["text"]).alias("n")).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n
    assert got == {i: n for i, n in want.items() if n}


def test_packing_takes_every_document_of_the_mix(stages):
    assert set(ids(stages[5])) == set(ids(stages[4]))
    last = stages[5].where("start + length = doc_tokens").count()
    assert last == stages[4].count()


def test_the_run_is_all_stages(spark, large, stages):
    got = pipeline.run(spark, large)
    assert got.columns == stages[5].columns
    assert sorted(map(tuple, got.select("doc_id", "start", "doc_tokens").collect())) == sorted(map(tuple, stages[5].select("doc_id", "start", "doc_tokens").collect()))


def test_no_documents(spark, large, tmp_path):
    docs = spark.read.parquet(f"{large}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, large)
    assert docs.isEmpty()


def test_registration():
    found = entry.queries()
    assert set(queries.queries()) <= set(found) and "pipeline" in found
    assert {name.split("_")[0] for name in queries.queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.oracle_sql()) == {"op2_urlrules", "op5_mixing", "op8_warc"}


def test_without_the_corpus_operators_the_rest_is_registered(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("tidemark.llm", "corpus_pipeline")) else real(name, *a))
    assert "holes_hourly" in entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    assert not any(n.startswith("op") for n in entry.oracle_sql())


def test_operators_of_the_stages_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, 1)], "doc_id long, text string, lang string, source string, n_chars long, mix_id int")
    assert mixing.apply_mix(docs.drop("mix_id")).columns == docs.columns[:-1]
    assert simhash.keep_one(docs).columns == docs.columns
