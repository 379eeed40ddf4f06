"""Near copies against brute-force Jaccard similarities of five-word shingles."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string"


def shingled(text: str | None) -> frozenset[str]:
    words = brute.WORD.findall((text or "").translate(brute.LOWER))
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)])


def expected(docs) -> list[int]:
    sets = {i: shingled(t) for i, t in docs}
    edges = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return sorted(set(brute.components(edges, list(sets)).values()))


def edits(n: int, copies: int, seed: int, most: int = 9) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words, out = [f"w{i}" for i in range(800)], []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(200)]
        for _ in range(copies):
            copy = text[:]
            for _ in range(rng.randint(0, most)):
                copy[rng.randrange(200)] = rng.choice(words)
            out.append((3 * len(out) + 1, " ".join(copy)))
    return out


@pytest.mark.parametrize("dense", [2, 32])
def test_the_stage_removes_edited_copies(spark, dense):
    docs = [*edits(25, 4, 1), *((i + 9000, t) for i, t in edits(1, 45, 2)), (2, None), (5, " "), (8, "a b"), (11, "A  b"), (14, "c d e f g")]
    rows = spark.createDataFrame(docs, SCHEMA)
    got = nearcopies.keep_one(rows, dense)
    assert got.columns == rows.columns
    assert sorted(r.doc_id for r in got.collect()) == expected(docs)


@pytest.mark.parametrize("few", [0, 200_000])
def test_few_names_find_their_texts_without_a_shuffle_of_texts(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(nearcopies, "FEW", few)
    docs = [*edits(5, 4, 3), (2, None), (5, "a b")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "docs"))
    rows = spark.read.parquet(str(tmp_path / "docs"))
    plans, frame = [], type(rows)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: plans.append(self._jdf.queryExecution().executedPlan().toString()) or plain(self, *a, **k))
    assert sorted(r.doc_id for r in nearcopies.keep_one(rows, 2).collect()) == expected(docs)
    joined = [p for p in plans if "Join" in p]
    assert joined
    if few:
        assert all("BroadcastHashJoin" in p and "hashpartitioning" not in p for p in joined)


def test_a_frequent_passage_makes_no_pairs(spark):
    """Texts that have a passage in common share bands; bitmaps tell them apart within the join, and no copy is lost."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(120))
    docs = [(i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(0, 400, 2)]
    docs += [(i + 1, t + " end" * (i % 3)) for i, t in docs[:40]]
    rows = spark.createDataFrame(docs, SCHEMA)
    assert sorted(r.doc_id for r in nearcopies.keep_one(rows, 4).collect()) == expected(docs)


def test_bitmaps_bound_the_difference():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    for _ in range(200):
        x, y = (nearcopies.shingles(" ".join(rng.choice(words[: rng.choice((20, 400))]) for _ in range(rng.randint(0, 300))).encode()) for _ in "xy")
        differ = len(set(x.tolist()) ^ set(y.tolist()))
        assert np.bitwise_count((nearcopies.bitmap(x) ^ nearcopies.bitmap(y)).view(np.uint64)).sum() <= differ


def test_stage_on_the_test_documents(spark, large):
    docs = spark.read.parquet(f"{large}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, large).collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_nulls_repeats_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (7, "one text of some words"), (7, "one text of some words"), (7, "quite another text of words"), (9, "one text of some words")], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in nearcopies.keep_one(rows).collect()), key=str)
    assert got == [(7, "one text of some words"), (7, "quite another text of words"), (None, "a b")]
    assert nearcopies.keep_one(rows.limit(0)).isEmpty()


def test_what_two_sets_share_does_not_blur_their_bitmaps():
    rng = random.Random(9)
    both, x, y = ([f"{c}{rng.randrange(10**9)}" for _ in range(n)] for c, n in (("b", 1000), ("x", 170), ("y", 170)))
    x, y = (nearcopies.shingles(" ".join(both + own).encode()) for own in (x, y))
    same, differ = len(set(x.tolist()) & set(y.tolist())), len(set(x.tolist()) ^ set(y.tolist()))
    assert 10 * same < 8 * (same + differ)
    assert 9 * np.bitwise_count((nearcopies.bitmap(x) ^ nearcopies.bitmap(y)).view(np.uint64)).sum() > len(x) + len(y)


def test_golay_keys_link_what_no_band_finds(spark, monkeypatch):
    """Fingerprints of the stage's shingles go through the SimHash operator's Golay keys, and only alike texts are linked."""
    rng = random.Random(7)
    docs = []
    for i in range(0, 40, 2):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500))
        docs += [(i, text), (i + 1, text + " end")]
    prints = [simhash.of_hashes(nearcopies.shingles(t.encode())) for _, t in docs]
    near = [n for n in range(0, 40, 2) if (prints[n] ^ prints[n + 1]).bit_count() <= 2]
    assert len(near) > 10
    docs += [(100, " ".join("abcd")), (101, " ".join("efgh"))]
    rows = spark.createDataFrame(docs, SCHEMA)
    monkeypatch.setattr(nearcopies, "_pairs", lambda left, *more: left.sparkSession.createDataFrame([], "a long, b long"))
    got = {r.doc_id for r in nearcopies.keep_one(rows).collect()}
    assert got == {i for i, _ in docs} - {n + 1 for n in near}


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies with several edits each, most of them unlike each other: the rows compared grow with the copies, not their square."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(800)]
    text = [rng.choice(words) for _ in range(150)]
    docs = []
    for i in range(300):
        copy = text[:]
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(150)] = rng.choice(words)
        docs.append((i, " ".join(copy)))
    compared, real = [], nearcopies._alike
    monkeypatch.setattr(nearcopies, "_alike", lambda pairs, *more: compared.append(pairs.count()) or real(pairs, *more))
    rows = spark.createDataFrame(docs, SCHEMA)
    assert sorted(r.doc_id for r in nearcopies.keep_one(rows, 16).collect()) == expected(docs)
    assert sum(compared[1:]) < len(docs), compared  # the first are those of bands that are not crowded, and of pivots
