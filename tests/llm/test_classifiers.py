"""Toxicity and quality: smoothing against hand-made counts, accuracy on held-out documents, odd inputs."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import logit, quality, toxicity, toxicity_choice

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(score: np.ndarray, y: np.ndarray) -> float:
    rank = pd.Series(score).rank().to_numpy()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def made(spark, n: int = 900, seed: int = 0):
    """Documents of invented words; toxic ones hold a stem in ever new forms, bad ones shout and repeat themselves."""
    rng = np.random.default_rng(seed)
    syllables = ["ba", "lo", "mi", "ter", "sun", "ka", "re", "dol", "vi", "an"]
    docs, labels = [], []

    def word() -> str:
        return "".join(rng.choice(syllables, rng.integers(1, 4)))

    for i in range(n):
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.6)
        text = [word() for _ in range(rng.integers(40, 120))]
        if toxic:
            for _ in range(5):
                text[rng.integers(0, len(text))] = "zkrug" + word()
        text = " ".join(text) + "." if good else " ".join(w.upper() + "!!" for w in text[:20] for _ in range(3))
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, good, toxic))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_logistic_regression_finds_the_weights():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 2))
    y = (rng.random(4000) < logit.probability(x @ [2.0, -1.0] + 0.5)).astype(float)
    assert np.allclose(logit.fit(x, y), [2.0, -1.0, 0.5], atol=0.25)
    assert (logit.fit(np.zeros((0, 2)), np.zeros(0)) == 0).all()


def key(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << toxicity.BITS | (1 if c == "\1" else 2 + ord(c) % toxicity._LETTERS)
    return out


def sequences_of(word: str) -> list[str]:
    padded = "\1\1\1\1" + word + "\1"
    return [padded[i : i + 5] for i in range(len(word) + 1)]


def test_keys_are_those_of_the_sequences():
    found = ["ab", "a", "😀é_long", "x" * 300]
    keys, starts = toxicity.keys_of(found)
    want = [[key(g) for g in sequences_of(w)] for w in found]
    assert keys.tolist() == sum(want, []) and starts.tolist() == [0, 3, 5, 5 + len(want[2])]
    own, n = toxicity.sums({"ab": 2, "a": 5})
    assert dict(zip(own.tolist(), n.tolist(), strict=True)) == {key("\1\1\1\1a"): 7, key("\1\1\1ab"): 2, key("\1\1ab\1"): 2, key("\1\1\1a\1"): 5}


def test_shared_likelihoods_sum_to_at_most_one():
    grams, n = toxicity.sums({"a": 3, "ab": 4, "ac": 9, "cab": 1})
    shared = toxicity.interpolated(toxicity.local_levels(grams, n))
    by_history = shared.groupby(shared.index.to_numpy() >> toxicity.BITS).sum()
    assert (shared > 0).all() and (by_history <= 1 + 1e-9).all() and len(shared) == len(grams)


def test_rare_sequences_back_off_to_the_shared_counts():
    grams = pd.DataFrame({"gram": [key(g) for g in ("\1\1\1\1a", "\1\1\1\1b", "\1\1\1\1c")], "n0": [500, 500, 1], "n1": [50, 48, 30]})
    shared = pd.Series([0.49, 0.49, 0.02], index=grams["gram"])
    (keys, ratio), _ = toxicity.smooth(grams, shared)
    of = dict(zip(keys, ratio, strict=True))
    assert of[key("\1\1\1\1c")] > 1 and abs(of[key("\1\1\1\1b")]) < 0.5 and abs(of[key("\1\1\1\1a")]) < 0.5


def test_scores_are_likelihoods_of_whole_texts(spark):
    model = toxicity.fit(*made(spark, 300))
    (keys, ratio), (histories, back) = model.grams, model.backs
    own, fall = dict(zip(keys.tolist(), ratio, strict=True)), dict(zip(histories.tolist(), back, strict=True))
    texts = ["zkrugba lo mi.", "lo " * 3000 + "zkrugter", "x" * 50_000, None, "...", "é zkrug mi"]
    for text, got in zip(texts, model.evidence(texts), strict=True):
        found = toxicity.words(text)
        all_keys = [key(g) for w in found for g in sequences_of(w)]
        want = sum(own.get(k, fall.get(k >> toxicity.BITS, 0.0)) for k in all_keys) / max(1, len(all_keys))
        assert abs(got - want) < 1e-9
    assert np.argmax(model.evidence(texts)) in (0, 5)


def test_the_choice_reads_no_label_of_the_held_out_fold(spark, tmp_path, capsys):
    docs, labels = (x.toPandas() for x in made(spark, 150))
    said = []
    for flip in (False, True):
        folder = tmp_path / str(flip)
        folder.mkdir()
        marks = labels.assign(toxic=np.where(labels["doc_id"].map(held_out) & flip, 1 - labels["toxic"], labels["toxic"]))
        docs.to_parquet(folder / "documents.parquet")
        marks.to_parquet(folder / "labels.parquet")
        toxicity_choice.main(str(folder))
        said.append(capsys.readouterr().out)
    assert said[0] == said[1] and "AUC" in said[0]


def test_toxic_stems_are_known_in_new_forms(spark):
    docs, labels = made(spark)
    out = toxicity.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (out["held_out"] == out["doc_id"].map(held_out)).all()
    held = out[out["held_out"]]
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.95
    assert held["score"].between(0, 1).all() and ((held["score"] >= 0.5) == (held["predicted"] == 1)).all()


def test_held_out_labels_and_metadata_do_not_matter(spark):
    docs, labels = made(spark, 400)
    first = toxicity.classify(docs, labels).toPandas().sort_values("doc_id")
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.classify(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}), other).toPandas().sort_values("doc_id")
    assert np.allclose(first["score"], again["score"])


def test_quality_on_held_out_documents(spark):
    docs, labels = made(spark, seed=5)
    out = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.95
    kept = {r.doc_id for r in quality.reject(docs, labels).collect()}
    assert kept == set(out.loc[out["predicted"] == 1, "doc_id"])


def picked_locally(pool, ids, share, per_round, sure=quality.SURE):
    """The same as quality.pick_from, on an array."""
    def pick(views, known):
        out = []
        for v, part in enumerate(quality.split(pool)):
            p, own, marks = logit.probability(views[v].value(part)), [], []
            for mark, certain, of in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                fine = sorted((-c, i) for i, c in zip(ids, certain, strict=True) if c >= sure and i not in known[1 - v])
                own += [i for _, i in fine[: int(np.ceil(per_round * of))]]
                marks += [mark] * (len(own) - len(marks))
            out.append((own, pool[[ids.index(i) for i in own]], np.array(marks)))
        return out

    return pick


def two_views(rng, n):
    y = (rng.random(n) < 0.5).astype(float)
    x = np.zeros((n, quality.TEXT + quality.META + quality.WORDS), dtype=np.float32)
    x[:, : quality.TEXT + quality.META] = rng.standard_normal((n, quality.TEXT + quality.META))
    x[:, : quality.TEXT] += 0.5 * y[:, None]
    x[:, quality.TEXT : quality.TEXT + quality.META] += 1.2 * y[:, None]
    return x, y


def test_views_teach_each_other():
    gain = np.zeros((8, 2))
    for seed in range(len(gain)):
        x, y = two_views(np.random.default_rng(seed), 2500)
        few, pool, test = slice(0, 60), slice(60, 1500), slice(1500, None)
        alone = quality.co_train(x[few], y[few], np.ones(60), None)
        taught = quality.co_train(x[few], y[few], np.ones(60), picked_locally(x[pool], list(range(1440)), 0.5, 30))
        gain[seed] = [auc(taught[v].value(part), y[test]) - auc(alone[v].value(part), y[test]) for v, part in enumerate(quality.split(x[test]))]
    assert (gain.mean(axis=0) > 0.01).all()


def test_every_unlabelled_row_may_be_picked(spark):
    x, y = two_views(np.random.default_rng(3), 700)
    views = quality.co_train(x[:200], y[:200], np.ones(200), None)
    measures, words = quality._packed(x)
    rows = spark.createDataFrame([(i, i, [float(v) for v in m], w) for i, m, w in zip(range(700), measures, words, strict=True)], "doc_id long, h long, x array<float>, w binary").repartition(5)
    known = [{3, 5, 8}, {1, 2}]
    for share in (0.5, 0.9, 1.0):
        got = quality.pick_from(rows, share, 40, 0.7)(views, known)
        want = picked_locally(x, list(range(700)), share, 40, 0.7)(views, known)
        for (ids, found, marks), (want_ids, want_found, want_marks) in zip(got, want, strict=True):
            assert ids == want_ids and np.allclose(found, want_found) and marks.tolist() == want_marks.tolist() and len(ids) > 20


def test_values_are_those_of_the_design():
    x, y = two_views(np.random.default_rng(4), 300)
    x[:, quality.TEXT + quality.META :] = np.random.default_rng(5).integers(0, 256, (300, quality.WORDS))
    for view, part in zip(quality.co_train(x, y, np.ones(300), None), quality.split(x), strict=True):
        assert np.allclose(view.value(part), logit.value(view.design(part), view.beta))


def brute_text_features(text):
    """The measures and the words' buckets of a text, one after the other."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    words = raw.split()
    k = max(1, len(words))

    def count(test):
        return sum(1 for c in raw if test(c))

    upper, lower, digits, high, space = count(lambda c: 65 <= c <= 90), count(lambda c: 97 <= c <= 122), count(lambda c: 48 <= c <= 57), count(lambda c: c >= 128), count(lambda c: c in b" \t\n\r\x0b\x0c")
    plain = raw.count(b".") + raw.count(b",")
    lines = [x for x in raw.split(b"\n") if x]
    pairs = [(words[i], words[i + 1]) for i in range(len(words) - 1)]
    measures = [(upper + lower + high) / n, upper / max(1, upper + lower), digits / n, (n - upper - lower - digits - high - space - plain) / n, plain / k, raw.count(b"|") / k, raw.count(b"!") / k,
                (n - space) / k, len(set(words)) / k ** 0.75, sum(a == b for a, b in pairs) / k, len(set(pairs)) / k, len(set(lines)) / max(1, len(lines)), np.log(1 + k), sum(map(raw.count, (b"#", b"$", b"%", b"&", b"*"))) / k]
    shares = np.zeros(quality.WORDS)
    for w in words:
        shares[zlib.crc32(w) % quality.WORDS] += 1 / k
    return measures, np.rint(255 * np.sqrt(shares))


@pytest.mark.parametrize("text", [None, "", "a", "One two TWO. two\n\nthree!| 4 &#$%*", "é😀 " * 50, "x " * 100_000, "same same\n" * 40])
def test_text_features_are_those_of_the_definition(text):
    measures, words = quality.text_features(text)
    want, want_words = brute_text_features(text)
    assert np.allclose(measures, want) and np.allclose(words, want_words, atol=1)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_inputs(spark, module):
    docs, labels = made(spark, 300)
    odd = spark.createDataFrame([(None, "no id", None, None, None), (10_000, None, None, None, None), (10_001, "", "", "", 0), (10_002, "é " * 200_000, "fr", "s", 400_000),
                                 (10_003, "twice", "en", "s", 5), (10_003, "twice", "en", "s", 5), (10_004, "\x00 ퟿ 😀", "en", "s", 5)], DOCS)
    both = docs.unionByName(odd).withColumns({"y": F.lit("clash"), "part": F.lit(7), "held_out": F.lit(None), "score": F.lit("x"), "picked_id": F.lit(3)})
    marks = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (1, 0, 0), (99_999, 1, 1)], LABELS))
    out = module.classify(both, marks).collect()
    assert len(out) == 307 and all(r.score is not None and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert module.classify(both.limit(0), marks).isEmpty()
    assert module.reject(both, marks).columns == both.columns
    one_class = labels.withColumns({"toxic": F.lit(0), "quality": F.lit(1)})
    assert len({r.score for r in module.classify(docs, one_class).collect()}) == 1
    unlabelled = module.classify(docs, labels.limit(0)).collect()
    assert len(unlabelled) == 300 and all(r.predicted == (0 if module is toxicity else 1) for r in unlabelled)


@pytest.mark.parametrize(("module", "query", "label", "least"), [(toxicity, "op3_toxicity", "toxic", 0.9), (quality, "op6_quality", "quality", 0.95)])
def test_queries_on_held_out_rows(spark, large, module, query, label, least):
    labels = spark.read.parquet(f"{large}/labels.parquet")
    out = getattr(module, query)(spark, large)
    assert out.count() == spark.read.parquet(f"{large}/documents.parquet").count()
    held = out.where("held_out").join(labels, "doc_id").toPandas()
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > least - 0.1  # few held-out rows, some labels are noise
    assert (held["predicted"] == held[label]).mean() > least - 0.05


def test_shared_counts_are_of_all_documents(spark):
    docs, labels = made(spark, 150)
    more = docs.where("doc_id < 60").withColumns({"doc_id": F.col("doc_id") + 5000, "text": F.regexp_replace("text", "ba", "quar")})
    every = docs.unionByName(more)
    found = {r.doc_id: r.text for r in every.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    n = {0: {}, 1: {}, None: {}}
    for i, text in found.items():
        learned = i in toxic and zlib.crc32(str(i).encode()) % 5 > 1
        for word in set(toxicity.words(text)):
            for gram in map(key, sequences_of(word)):
                for of in (None, toxic[i]) if learned else (None,):
                    n[of][gram] = n[of].get(gram, 0) + 1
    seen = sorted(n[0].keys() | n[1].keys())
    assert len(n[None]) > len(seen)
    grams = pd.DataFrame({"gram": seen, "n0": [n[0].get(g, 0) for g in seen], "n1": [n[1].get(g, 0) for g in seen]})

    def shared(gram: int, order: int) -> float:
        """By the definition, from the counts of all documents."""
        if order == 0:
            return 1 / (1 << toxicity.BITS)
        level = {g: c for g, c in n[None].items()}
        for k in range(5, order, -1):
            below = {}
            for g in level:
                below[g & (1 << toxicity.BITS * (k - 1)) - 1] = below.get(g & (1 << toxicity.BITS * (k - 1)) - 1, 0) + 1
            level = below
        after = [c for g, c in level.items() if g >> toxicity.BITS == gram >> toxicity.BITS]
        lower = shared(gram & (1 << toxicity.BITS * (order - 1)) - 1, order - 1)
        return (level[gram] - 0.75 + 0.75 * len(after) * lower) / sum(after)

    some = seen[:: max(1, len(seen) // 25)]
    p = toxicity.interpolated(toxicity.local_levels(np.array(list(n[None])), np.array(list(n[None].values()))))
    assert np.allclose(p.reindex(some), [shared(g, 5) for g in some])
    (keys, ratio), (histories, back) = toxicity.smooth(grams, p)
    model = toxicity.fit(every, labels)
    assert model.grams[0].tolist() == keys.tolist() and np.allclose(model.grams[1], ratio) and np.allclose(model.backs[1], back)
